"""Reshaping and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_known(df: DataFrame, keys, pivot_col: str, values, value: str, agg=F.sum) -> DataFrame:
    """Pivot with the value list given (no extra distinct job)."""
    return df.groupBy(*keys).pivot(pivot_col, list(values)).agg(agg(value))


def to_long(df: DataFrame, ids, cols, var: str = "variable", val: str = "value") -> DataFrame:
    """T4."""
    return df.unpivot(list(ids), list(cols), var, val)


def one_hot_drop_first(col: str, values, prefix: str) -> list[Column]:
    """T5: 0/1 dummies for sorted(values)[1:] (pandas get_dummies drop_first)."""
    vs = sorted(values)[1:]
    return [F.when(F.col(col) == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in vs]


def explode_split(df: DataFrame, col: str, pattern: str, pos: str = "pos", out: str = "part") -> DataFrame:
    """One row per part of a split cell, with its position."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(F.split(F.col(col), pattern)).alias(pos, out))


def flatten(df: DataFrame, struct_col: str) -> DataFrame:
    """Lift the fields of a struct column to top level."""
    rest = [c for c in df.columns if c != struct_col]
    return df.select(*rest, f"{struct_col}.*")


def ragged_to_table(df: DataFrame, group: str, pos: str, value: str, groups) -> DataFrame:
    """Lists of different lengths (one row per (group, pos, value)) padded
    into one column per group, null where a list is shorter."""
    return df.groupBy(pos).pivot(group, list(groups)).agg(F.first(value))


def explode_map(df: DataFrame, map_col: str, key: str = "term_id", val: str = "n") -> DataFrame:
    """Fragment id -> count maps into (row, term, n) rows."""
    rest = [c for c in df.columns if c != map_col]
    return df.select(*rest, F.explode(F.col(map_col)).alias(key, val))
