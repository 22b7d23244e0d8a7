"""Incremental form of the daily event aggregate (A1) for event files that
keep arriving: Structured Streaming over a Parquet folder, event-time
watermark so late rows within ``lateness`` still update their day, and the
same per-(unit, day) aggregate expressions as the batch operator.

The reference itself is batch-only; this is the same operator fed
incrementally, not a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def daily_treatment_stream(events: DataFrame, actors, ts: str = "ts", unit: str = "unit", actor: str = "actor",
                           size: str = "size", lateness: str = "2 days") -> DataFrame:
    """Streaming A1: per (unit, 1-day window) any-event flags per actor, size
    sums and counts.  State per key is a handful of numbers, bounded by the
    watermark."""
    w = F.window(F.col(ts), "1 day")
    aggs = [F.max(F.when(F.col(actor).contains(a), 1).otherwise(0)).alias(f"occ_{a}") for a in actors]
    aggs += [F.sum(F.when(F.col(actor) == a, F.col(size)).otherwise(F.lit(0.0))).alias(f"size_{a}") for a in actors]
    aggs += [F.sum(F.coalesce(F.col(size), F.lit(0.0))).alias("size_protest"), F.count(F.lit(1)).alias("n_events")]
    g = events.withWatermark(ts, lateness).groupBy(F.col(unit), w.alias("w")).agg(*aggs)
    return g.select(unit, F.to_date(F.col("w.start")).alias("day"), F.lit(1).alias("occ_protest"),
                    *[c for c in g.columns if c not in (unit, "w")])


def start_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger_once: bool = False):
    """Write finalised days (append after the watermark passes) to Parquet;
    the checkpoint folder must be on shared storage."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
