"""File sources and sinks.

Readers declare schemas (no inference pass), keep path-derived columns via
the ``_metadata`` file path, and leave filtering/projection to Catalyst so
it reaches the scan.  Sinks write partitioned output; the metrics sink
reloads a stored result when it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# S1-S3, S15 -----------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", partition_by=()) -> None:
    w = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


# S4 -------------------------------------------------------------------------
def scan_with_path_keys(spark: SparkSession, pattern: str, schema, keys: dict[str, str], sep: str = ",") -> DataFrame:
    """Scan many same-shaped files; ``keys`` maps a column name to a regex with
    one group applied to the file path (e.g. corpus/sigle/query directories)."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(pattern)
    fp = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(fp, rx, 1).alias(k) for k, rx in keys.items()])


# S5 / S6 / S16 --------------------------------------------------------------
def read_json(spark: SparkSession, path: str, schema, multiline: bool = False, recursive: bool = False) -> DataFrame:
    r = spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE")
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.json(path)


def write_jsonl(df: DataFrame, path: str, partition_by=()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


# S7 -------------------------------------------------------------------------
def union_files(frames: dict[str, DataFrame], name_col: str = "city") -> DataFrame:
    """Differently shaped per-file tables -> one table; 'Unnamed' columns dropped."""
    out = None
    for name, df in frames.items():
        df = df.select(*[c for c in df.columns if not c.startswith("Unnamed")]).withColumn(name_col, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# S8 -------------------------------------------------------------------------
def indicator_matrix(spark: SparkSession, folder: str, sep: str = ";", regions=None) -> DataFrame:
    """Single-indicator text files (line 1 = indicator title, then a header
    'key;region;value' and data rows) -> indicator × region matrix.  Pass the
    region list (a dimension) to get every region column even when a file
    lacks it (and to skip pivot's extra distinct-values job)."""
    files = spark.read.text(folder, wholetext=True)
    lines = files.select(F.split(F.col("value"), "\r?\n").alias("l"))
    rows = lines.select(F.element_at("l", 1).alias("indicator"), F.explode(F.slice("l", 3, 1 << 30)).alias("line"))
    parts = F.split("line", sep)
    data = rows.where(F.size(parts) >= 3).select(
        "indicator", F.element_at(parts, 2).alias("region"),
        F.regexp_replace(F.element_at(parts, 3), ",", ".").try_cast("double").alias("value"))
    if regions is not None:
        return data.groupBy("indicator").pivot("region", list(regions)).agg(F.first("value"))
    return data.groupBy("indicator").pivot("region").agg(F.first("value"))


# S10 ------------------------------------------------------------------------
COUNTS_SCHEMA = "struct<counts: array<struct<date: string, count: bigint>>>"


def service_counts(df: DataFrame, col: str, keys=()) -> DataFrame:
    """Count-service JSON payload -> (keys, day, count), duplicate days summed."""
    p = df.select(*keys, F.from_json(F.col(col), COUNTS_SCHEMA).alias("_p"))
    e = p.select(*keys, F.explode("_p.counts").alias("c"))
    return e.groupBy(*keys, F.to_date(F.col("c.date")).alias("day")).agg(F.sum("c.count").alias("count"))


# S13 ------------------------------------------------------------------------
def wire_fields(text: Column) -> Column:
    """Wire-report plaintext -> struct(title, date, location, summary, text) by
    ordered splits: first line title, second line 'date', then 'LOCATION
    (agency) - summary' lead line, rest body.  Records starting 'Job Number'
    yield null (quarantine with ``where(col.isNull())``)."""
    lines = F.split(text, "\n")
    lead = F.element_at(lines, 3)
    return F.when(~text.startswith("Job Number"), F.struct(
        F.trim(F.element_at(lines, 1)).alias("title"),
        F.try_to_date(F.trim(F.element_at(lines, 2)), "yyyy-MM-dd").alias("date"),
        F.trim(F.regexp_extract(lead, r"^([^(\-]+)", 1)).alias("location"),
        F.trim(F.regexp_extract(lead, r"-\s*(.*)$", 1)).alias("summary"),
        F.array_join(F.slice(lines, 4, 1 << 30), "\n").alias("text")))


# S14 ------------------------------------------------------------------------
STORY_SCHEMA = "array<struct<stories_id: bigint, url: string, title: string, publish_date: string>>"


def story_rows(df: DataFrame, col: str) -> DataFrame:
    s = df.select(F.explode(F.from_json(F.col(col), STORY_SCHEMA)).alias("s")).select("s.*")
    return s.where(F.col("publish_date").isNotNull()).distinct()


# S17 ------------------------------------------------------------------------
def stored_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """Reload a stored small result if present, else compute and store it."""
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - absent path
        df = compute()
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


DOC_META = T.StructType([T.StructField("text", T.StringType()),
                         T.StructField("meta", T.StructType([T.StructField("doc_id", T.LongType()),
                                                             T.StructField("source", T.StringType()),
                                                             T.StructField("n_chars", T.LongType())])),
                         T.StructField("lang", T.StringType())])
