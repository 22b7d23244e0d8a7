"""Projection and filter operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename and keep only the mapped columns (one Project node)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def drop_if_present(df: DataFrame, *cols) -> DataFrame:
    """P2."""
    return df.drop(*[c for c in cols if c in df.columns])


def affix(df: DataFrame, prefix: str = "", suffix: str = "", keep=("unit", "day")) -> DataFrame:
    """prefix/suffix every non-key column in one select."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns])


def any_cell_contains(cols, words) -> Column:
    """True when any of ``cols`` (as text) contains any of ``words``;
    null cells never match."""
    hits = [F.coalesce(F.col(c).cast("string").contains(w), F.lit(False)) for c in cols for w in words]
    return reduce(lambda a, b: a | b, hits)


def drop_marked(df: DataFrame, col: str, marker: str = "x") -> DataFrame:
    """Drop rows whose marker equals ``marker`` (nulls kept), then the marker."""
    return df.where(~F.col(col).eqNullSafe(marker)).drop(col)


def blocklist_pattern(substrings) -> str:
    return "|".join(re.escape(s) for s in substrings)


def not_blocked(col: str, substrings) -> Column:
    """P10: URL does not contain any blocked substring (one regex, JVM side)."""
    return ~F.col(col).rlike(blocklist_pattern(substrings))


def outlier_bounds(df: DataFrame, col: str, k: float) -> tuple[float, float]:
    """P11 bounds: mean ± k·sd (sample).  One global aggregate; only two
    scalars reach the driver."""
    r = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    return r["m"] - k * r["s"], r["m"] + k * r["s"]


def remove_outliers(df: DataFrame, col: str, k: float) -> DataFrame:
    lo, hi = outlier_bounds(df, col, k)
    return df.where(F.col(col).between(lo, hi))


def clip(c, lo=None, hi=None) -> Column:
    """P16."""
    c = F.col(c) if isinstance(c, str) else c
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def finite_or_null(c) -> Column:
    """NaN and ±inf become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def _count_column(medium: str, what: str) -> str:
    return f"media_{medium}_{what}"


def total_counts(df: DataFrame, media, part: str = "protest", rest: str = "not_protest", total: str = "all") -> DataFrame:
    """Per medium the total replaces the rest: total = part + rest."""
    sums = {_count_column(m, total): F.col(_count_column(m, part)) + F.col(_count_column(m, rest)) for m in media}
    return df.withColumns(sums).drop(*(_count_column(m, rest) for m in media))


def rest_counts(df: DataFrame, media, part: str = "protest", rest: str = "not_protest", total: str = "all") -> DataFrame:
    """Inverse of P19: rest = total - part."""
    return df.withColumns({_count_column(m, rest): F.col(_count_column(m, total)) - F.col(_count_column(m, part))
                           for m in media})


def merge_media(df: DataFrame, dims, first: str = "online", second: str = "print", merged: str = "combined") -> DataFrame:
    """P20: per dimension that both media have, merged = first + second; the second's column goes."""
    pairs = [(_count_column(first, x), _count_column(second, x), _count_column(merged, x)) for x in dims]
    pairs = [p for p in pairs if {p[0], p[1]} <= set(df.columns)]
    return df.withColumns({m: F.col(a) + F.col(b) for a, b, m in pairs}).drop(*(b for _, b, _ in pairs))


def cutover(old: DataFrame, new: DataFrame, cut: str, day: str = "day") -> DataFrame:
    """Old source strictly before ``cut``, new source from ``cut`` on."""
    c = F.to_date(F.lit(cut))
    return old.where(F.col(day) < c).unionByName(new.where(F.col(day) >= c), allowMissingColumns=True)


def column_report(frames: dict[str, DataFrame], required, optional=()) -> DataFrame:
    """Per source and wanted column, whether it is there and in how many
    of the rows it is filled; ``ok`` is false for a required column that is
    absent or null somewhere.  One aggregate per source; an absent column
    counts as filled nowhere, an empty source has nothing missing but absent columns."""
    def one(name, df):
        wanted = [(c, c in required) for c in dict.fromkeys([*required, *optional])]
        there = set(df.columns)
        counts = df.agg(F.count("*").alias("n_rows"), F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(must).alias("required"), F.lit(c in there).alias("present"),
                     (F.count(df[c]) if c in there else F.lit(0)).cast("long").alias("n_filled"))
            for c, must in wanted]).alias("told"))
        return (counts.select(F.lit(name).alias("source"), "n_rows", F.inline("told"))
                .withColumn("ok", ~F.col("required") | (F.col("present") & (F.col("n_filled") == F.col("n_rows")))))
    return reduce(DataFrame.unionByName, [one(name, df) for name, df in frames.items()])
