"""Classifiers and clusters of texts share one table of term counts."""
from pyspark.sql import functions as F

from ripplekit.estimators import ml as M
from ripplekit.estimators.stacked import small_batches


def test_term_counts_by_fold(spark):
    df = spark.createDataFrame([(0, "b b a"), (1, "a c c"), (2, "d c"), (None, "e e e e")], "fold int, text string")
    d, tops = M.term_counts(df, "text", 2, 1, "fold", 3, keep=["fold"])
    # rows outside the fold; equal counts by term; a row without a fold trains nothing
    assert [t for _, t in tops] == [["c", "a"], ["b", "a"], ["a", "b"]]
    terms = {i: t for at, ts in tops for i, t in zip(at, ts)}
    got = {r["fold"]: {terms[i]: v for i, v in zip(r["_all"].indices.tolist(), r["_all"].values.tolist())} for r in d.collect()}
    assert got == {0: {"b": 2.0, "a": 1.0}, 1: {"a": 1.0, "c": 2.0}, 2: {"c": 1.0}, None: {}}


def test_models_together_as_alone(spark):
    words = "red green blue cold warm hot".split()
    rows = [(i % 3, float(i % 2), " ".join(words[(i * j + j) % 6] for j in range(1, 5)) + (" good" if i % 2 else " bad")) for i in range(30)]
    df = spark.createDataFrame(rows, "fold int, label double, text string")
    kinds = ("logistic", "complement_nb", "random_forest")
    both = M.cv_classifiers(df, "text", "label", "fold", 3, kinds).collect()
    alone = [r for m in kinds for r in M.cv_classifier(df, "text", "label", "fold", 3, m).collect()]
    assert sorted(both) == sorted(alone) and len(both) == 9
    assert all(r["tp"] + r["tn"] == 10 for r in both if r["model"] == "logistic")


def test_small_batches_end(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 2):
        df = spark.range(10).coalesce(1).mapInPandas(lambda bs: (b.assign(id=len(b)) for b in bs), "id long")
        assert df.agg(F.max("id")).first()[0] == 2
    assert spark.conf.get(key) == before
