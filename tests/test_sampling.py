"""Global positions and resampling over many partitions."""
from pyspark.sql import functions as F

from ripplekit.operators import sampling as L

N = 500_000


def _table(spark):
    """Shuffled unique ids with a payload that names the id, half of the rows in one group."""
    return spark.range(0, N, 1, 16).select(
        (F.pmod(F.col("id") * 7919, F.lit(N))).alias("id"), F.when(F.col("id") % 2 == 0, "hot")
        .otherwise((F.col("id") % 97).cast("string")).alias("g")).withColumn("payload", F.concat(F.lit("p"), "id"))


def test_positions_pair_two_tables(spark):
    a = L._global_index(_table(spark), ["id"])
    b = L._global_index(_table(spark).select("id", F.col("payload").alias("other")), ["id"]).withColumnRenamed("id", "id_b")
    j = a.join(b, "_idx")
    r = j.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_idx").alias("d"), F.min("_idx").alias("lo"),
              F.max("_idx").alias("hi"), F.sum((F.col("payload") != F.col("other")).cast("int")).alias("wrong")).first()
    assert (r.n, r.d, r.lo, r.hi, r.wrong) == (N, N, 1, N, 0)


def test_resample_keeps_rows(spark):
    for replace in (True, False):
        r = L.resample_global(_table(spark).drop("g"), ["id"], ["payload"], 3, replace).agg(
            F.count(F.lit(1)).alias("n"), F.count("payload").alias("v"), F.countDistinct("payload").alias("d")).first()
        assert (r.n, r.v) == (N, N)
        assert (r.d == N) is (not replace)


def test_group_positions_with_a_hot_group(spark):
    p = L.index_within_group(_table(spark), "g", ["id"])
    bad = p.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"),
                             F.max("pos").alias("hi")).where("n != d OR lo != 1 OR hi != n")
    assert p.count() == N and bad.count() == 0


def test_positions_of_an_empty_table(spark):
    assert L._global_index(_table(spark).limit(0), ["id"]).count() == 0
