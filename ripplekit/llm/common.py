"""Shared helpers of the training-data operators: shared-folder tables, table scans, components."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table

__all__ = ["table", "work_dir", "stored", "text_batches", "handed_back", "columns_of", "smallest", "components"]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: evaluated once, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts pass to Python in Arrow batches of at most ``rows`` rows from here on (Spark's default is 10,000, tens
    of MB of texts or sets on both sides of every task); a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def handed_back(run):
    """A function for mapInArrow that gives the memory which Arrow keeps for reuse back to the system when its task ends:
    Python workers live on from query to query, two or more of them beside an executor's heap."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return tidy


def columns_of(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names (other columns of any name are ignored)."""
    return df.select(*[df[c].alias(new) for new, c in cols.items()])


def text_hash(text: str = "text"):
    """With the id, tells rows apart whose decisions may differ; null for a null text."""
    return F.sha2(F.col(text).cast("binary"), 256)


def smallest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows with the smallest hash of the ``by`` columns: a sample that is the same on every run.

    Rows that cannot be among them are filtered out by a bound on the hash first, so that about 2 n rows, not n of
    each task, meet for the ordering.
    """
    total = df.count()
    h = F.xxhash64(*by)
    if total > 4 * n:
        low = df.where(h < int(-(1 << 63) + (1 << 64) * (2 * n / total)))
        if n >= 200 or low.count() >= n:  # with 200 expected twice over, fewer than n has a chance below 1e-20
            df = low
    return df.orderBy(h, *by).limit(n)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, comp) per node, comp the smallest reachable node.

    Minimum-label propagation with pointer jumping; every round is an equi-join and a partial aggregate over
    tables in the shared folder, and only the number of changed labels reaches the driver.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  f"{name}-edges")
    lab = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")),
                 f"{name}-0")
    for i in range(1, 200):
        seen = (both.join(lab.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = (lab.join(seen, "node")
                .select("node", F.least("comp", "near").alias("hop"), F.col("comp").alias("old")))
        up = lab.select(F.col("node").alias("hop"), F.col("comp").alias("up"))
        nxt = stored(step.join(up, "hop", "left")
                     .select("node", F.least("hop", "up").alias("comp"), "old"), f"{name}-{i}")
        moved = nxt.where("comp <> old").limit(1).count()
        lab = nxt.select("node", "comp")
        if not moved:
            return lab
    raise RuntimeError("component labels did not settle")
