"""Scans of the given Parquet tables.

Every reader returns a lazy DataFrame; Catalyst pushes filters and column
pruning into the Parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Dimension tables whose row count is fixed by the schema definition
# (TPC-H: 5 regions, 25 nations) and therefore safe to broadcast at any scale.
FIXED_SIZE_DIMS = {"region": 5, "nation": 25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dim(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixed-size dimension, marked for broadcast."""
    if name not in FIXED_SIZE_DIMS:
        raise ValueError(f"{name} has no fixed size bound; let the planner decide")
    return F.broadcast(table(spark, sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every given table as a temp view (for ``spark.sql`` users)."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
