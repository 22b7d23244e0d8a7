"""Classifiers on series, text, both, and series with a cross-fitted text probability.

Folds are blocks of time; fold f is predicted by models of the folds before it, and everything a model of fold f uses
(vocabulary, inverse document frequencies, text probabilities) comes from those folds alone.  The text probability of a
training row comes from a model that has not seen its inner fold, that of a test row from all training rows.

Text arrives as counts (row key, term, n): a day's text is never put together, however long.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import confusion
from .multi import newton_models
from .passes import array_sums

SETS = ("series", "text", "combined", "stacked")


def vocabularies(terms: DataFrame, rows: DataFrame, keys, folds: int, size: int = 1000, least: int = 5, most: float = 0.8):
    """{fold: [(term, idf)]}: for each predicted fold the ``size`` most frequent terms of the folds before it that occur
    in ``least`` rows and at most a share ``most`` of them; idf = ln((1 + rows) / (1 + rows with the term)) + 1."""
    n = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    df = terms.join(rows.select(*keys, "fold"), list(keys)).groupBy("fold", "term").agg(F.count(F.lit(1)).alias("df"))
    out = {}
    for f in range(1, folds):
        total = sum(v for g, v in n.items() if g < f)
        top = (df.where(F.col("fold") < f).groupBy("term").agg(F.sum("df").alias("df"))
               .where((F.col("df") >= least) & (F.col("df") <= most * total)).orderBy(F.desc("df"), "term").limit(size))
        out[f] = [(r["term"], float(np.log((1 + total) / (1 + r["df"])) + 1)) for r in top.collect()]
    return out


def with_text(rows: DataFrame, terms: DataFrame, keys, vocabulary: dict) -> DataFrame:
    """rows with ``terms``: for each row its counts of the terms in any fold's vocabulary (id, n)."""
    ids = {t: i for i, t in enumerate(sorted({t for v in vocabulary.values() for t, _ in v}))}
    if not ids:
        return rows.withColumn("terms", F.lit(None).cast("array<struct<id:int,n:double>>"))
    known = rows.sparkSession.createDataFrame(list(ids.items()), "term string, id int")  # at most folds * size rows
    own = (terms.join(F.broadcast(known), "term").groupBy(*keys)
           .agg(F.collect_list(F.struct("id", F.col("n").cast("double").alias("n"))).alias("terms")))
    return rows.join(own, list(keys), "left")


@contextmanager
def small_batches(spark, rows: int = 200):
    """Rows with their terms pass to Python at most ``rows`` at a time inside (a row may hold folds * size terms, each a
    Python object there); afterwards the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key, "10000")
    if not 0 < int(own) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def _tfidf(lists, idf: np.ndarray):
    """(row, id, value) of the rows' vectors: counts times idf, of length 1; ids with idf 0 are not in the vocabulary."""
    size = np.array([0 if x is None else len(x) for x in lists])
    row = np.repeat(np.arange(len(size)), size)
    pairs = [(e["id"], e["n"]) for x in lists if x is not None for e in x]
    ids, n = (np.array([p[i] for p in pairs], t) for i, t in ((0, np.int64), (1, float)))
    v = n * idf[ids]
    row, ids, v = row[v > 0], ids[v > 0], v[v > 0]
    norm = np.sqrt(np.bincount(row, v * v, minlength=len(size)))
    return row, ids, v / norm[row]


def complement_weights(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Complement naive Bayes: log weights (class x term) from the class x term sums of the features."""
    other = counts.sum(axis=0) + alpha - counts
    return -np.log(other / other.sum(axis=1, keepdims=True))


def text_probabilities(d: DataFrame, label: str, idf: dict, inner: int) -> DataFrame:
    """d with ``p1`` .. : for each predicted fold the cross-fitted text probability of its training and test rows (null
    for later ones), all models from one pass of class sums by inner fold."""
    size = len(next(iter(idf.values())))

    def sums(pdf):
        out, fold, y, part = {}, pdf["fold"].to_numpy(), pdf[label].to_numpy(int), pdf["inner"].to_numpy(int)
        for f in idf:
            row, ids, v = _tfidf(pdf["terms"], idf[f])
            train = fold[row] < f
            at = (part[row] * 2 + y[row])[train] * size + ids[train]
            out[str(f)] = np.bincount(at, v[train], minlength=inner * 2 * size).reshape(inner, 2, size)
        return out

    got = array_sums(d, sums)
    # the last model of a fold is that of all its training rows
    weights = {f: [complement_weights(got[str(f)].sum(axis=0) - own) for own in [*got[str(f)], 0.0]] for f in idf} if got else {}

    def scored(batches):
        for pdf in batches:
            fold, part = pdf["fold"].to_numpy(), pdf["inner"].to_numpy(int)
            for f in idf:
                row, ids, v = _tfidf(pdf["terms"], idf[f])
                model = np.where(fold < f, part, inner)
                W = np.stack([w[1] - w[0] for w in weights[f]])
                z = np.bincount(row, v * W[model[row], ids], minlength=len(pdf))
                pdf[f"p{f}"] = np.where(fold <= f, 0.5 * (1 + np.tanh(z / 2)), np.nan)
            yield pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + "".join(f", p{f} double" for f in idf)
    return d.mapInPandas(scored, schema) if weights else d.select("*", *[F.lit(None).cast("double").alias(f"p{f}") for f in idf])


def _vector(size: int, dense):
    """terms (and the dense columns before them) as one sparse vector."""
    @F.udf(VectorUDT())
    def make(terms, idf, *values):
        pairs = [(e["id"], e["n"] * idf[e["id"]]) for e in terms or () if idf[e["id"]] > 0]
        norm = sum(v * v for _, v in pairs) ** 0.5
        own = [(i, v) for i, v in enumerate(values) if v]
        return Vectors.sparse(len(values) + size, own + sorted((len(values) + i, v / norm) for i, v in pairs))
    return make


def stacked_scores(rows: DataFrame, terms: DataFrame, keys, label: str, series, folds: int, inner: int = 3, c: float = 1.0,
                   store=lambda d: d, **vocabulary) -> DataFrame:
    """One row for each set of features and row of folds 1 ..: keys, fold, label, ``features``, ``score`` (probability).

    ``rows``: keys, label (0/1), fold, inner (a fold id for the text models) and the complete ``series`` columns;
    ``terms``: keys, term, n.  ``store`` writes a table that several passes read.
    """
    keys, series = list(keys), list(series)
    words = vocabularies(terms, rows, keys, folds, **vocabulary)
    ids = {t: i for i, t in enumerate(sorted({t for v in words.values() for t, _ in v}))}
    idf = {f: np.zeros(max(len(ids), 1)) for f in words}
    for f, v in words.items():
        for t, x in v:
            idf[f][ids[t]] = x
    base = rows.select(*keys, "fold", F.col("inner").cast("int").alias("inner"), F.col(label).cast("double").alias(label),
                       *[F.col(x).cast("double").alias(x) for x in series])
    with small_batches(rows.sparkSession):
        d = store(text_probabilities(store(with_text(base, terms, keys, words)), label, idf, inner))
    models = {}
    for f in words:
        models["series", f] = (label, series, list(range(f)))
    filled = d.fillna(0.5, subset=[f"p{f}" for f in words])  # only rows that no model of the column uses
    for f in words:
        models["stacked", f] = (label, [*series, f"p{f}"], list(range(f)))
    fits = newton_models(filled.drop("terms"), models, c)
    seen = {r["fold"]: (r["n"], r["n1"]) for r in base.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n1")).collect()}
    parts = []
    for f in words:
        n, n1 = (sum(v[i] for g, v in seen.items() if g < f) for i in (0, 1))
        test = filled.where(F.col("fold") == f)
        for name in ("series", "stacked"):
            b, cols = fits[name, f][0], models[name, f][1]
            z = F.lit(float(b[0]))
            for x, v in zip(cols, b[1:]):
                z = z + F.col(x) * F.lit(float(v))
            parts.append(test.select(*keys, "fold", label, F.lit(name).alias("features"), (1 / (1 + F.exp(-z))).alias("score")))
        size, weights = len(idf[f]), F.array(*[F.lit(float(x)) for x in idf[f]])
        for name, dense in (("text", []), ("combined", series)):
            v = d.withColumn("v", _vector(size, dense)("terms", weights, *dense)).select(*keys, "fold", label, "v")
            train = v.where(F.col("fold") < f)
            if not n or n1 in (0, n):  # one class: its share is the score
                parts.append(v.where(F.col("fold") == f).select(*keys, "fold", label, F.lit(name).alias("features"),
                                                                F.lit(float(n1 / n if n else 0.0)).alias("score")))
                continue
            m = LogisticRegression(featuresCol="v", labelCol=label, regParam=1.0 / (c * n), standardization=False, maxIter=100).fit(train)
            parts.append(m.transform(v.where(F.col("fold") == f)).select(*keys, "fold", label, F.lit(name).alias("features"),
                                                                         vector_to_array("probability").getItem(1).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_metrics(scores: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion, precision, recall and F1 by feature set and fold, and the F1 of calling every row positive."""
    s = scores.withColumn("pred", (F.col("score") >= threshold).cast("int"))
    rate = F.avg(label)
    return s.groupBy("features", "fold").agg(*confusion(label, "pred"), (2 * rate / (1 + rate)).alias("f1_all_positive"),
                                             F.count(F.lit(1)).alias("n"))
