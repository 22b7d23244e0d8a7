"""The stacked classifier against plain NumPy on small rows."""
import numpy as np
import pandas as pd
import pytest

from ripplekit.estimators import stacked as K


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(6)
    n = 480
    label = (rng.random(n) < 0.4).astype(int)
    rows = pd.DataFrame({"unit": "u", "day": np.arange(n), "fold": np.arange(n) // 120, "inner": rng.integers(0, 3, n), "label": label,
                         "x1": rng.normal(size=n) + label, "x2": rng.normal(size=n)})
    terms = []
    for i in range(n):
        words = rng.choice(["march", "crowd", "rain", "bank", "chair", "tea"], 6,
                           p=[.3, .3, .1, .1, .1, .1] if label[i] else [.1, .1, .2, .2, .2, .2])
        terms += [("u", i, w, int((words == w).sum())) for w in set(words)]
        terms += [("u", i, "everywhere", 1)] + ([("u", i, f"late{i % 2}", 1)] if i >= 360 else []) + [("u", i, f"once{i}", 1)]
    terms = [t for t in terms if t[1] != 5]  # a day without text
    return rows, pd.DataFrame(terms, columns=["unit", "day", "term", "n"])


def plain(rows, terms, vocabulary, f):
    """Text probabilities of the rows of folds up to f, by the definition."""
    names = [t for t, _ in vocabulary]
    X = np.zeros((len(rows), len(names)))
    for r in terms.itertuples():
        if r.term in names:
            X[r.day, names.index(r.term)] = r.n * dict(vocabulary)[r.term]
    norm = np.linalg.norm(X, axis=1, keepdims=True)
    X = X / np.where(norm == 0, 1, norm)
    y, fold, inner = (rows[c].to_numpy() for c in ("label", "fold", "inner"))
    out = np.full(len(rows), np.nan)
    for i in np.flatnonzero(fold <= f):
        tr = (fold < f) & ((inner != inner[i]) | (fold[i] == f))
        count = np.stack([X[tr & (y != c)].sum(axis=0) + 1 for c in (0, 1)])
        w = -np.log(count / count.sum(axis=1, keepdims=True))
        z = X[i] @ w.T
        out[i] = np.exp(z[1]) / np.exp(z).sum()
    return X, out


def test_text_probabilities_and_scores(spark, small):
    rows, terms = small
    r, t = spark.createDataFrame(rows).repartition(3), spark.createDataFrame(terms).repartition(3)
    words = K.vocabularies(t, r, ["unit", "day"], 4)
    assert set(words) == {1, 2, 3}
    for f, v in words.items():
        train = terms[terms.day < 120 * f]
        df = train.groupby("term").size()
        want = {w for w, c in df.items() if 5 <= c <= 0.8 * 120 * f}
        assert {w for w, _ in v} == want and "late0" not in want and "everywhere" not in want
        assert all(x == pytest.approx(np.log((1 + 120 * f) / (1 + df[w])) + 1) for w, x in v)
    assert len(K.vocabularies(t, r, ["unit", "day"], 4, size=2)[3]) == 2
    got = K.stacked_scores(r, t, ["unit", "day"], "label", ["x1", "x2"], 4).toPandas()
    assert len(got) == 4 * 360 and set(got.features) == set(K.SETS)
    table = got.pivot(index="day", columns="features", values="score")
    for f in (1, 3):
        X, p = plain(rows, terms, words[f], f)
        test, tr = (rows.fold == f).to_numpy(), (rows.fold < f).to_numpy()
        for name, cols in (("series", rows[["x1", "x2"]].to_numpy()), ("stacked", np.column_stack([rows[["x1", "x2"]], p]))):
            A = np.column_stack([np.ones(len(rows)), cols])
            b = np.zeros(A.shape[1])
            for _ in range(40):
                q = 1 / (1 + np.exp(-A[tr] @ b))
                b -= np.linalg.solve((A[tr] * (q * (1 - q))[:, None]).T @ A[tr] + np.eye(len(b)), A[tr].T @ (q - rows.label[tr]) + b)
            assert np.allclose(table[name][rows.day[test]], 1 / (1 + np.exp(-A[test] @ b)), atol=1e-6)
    m = K.fold_metrics(spark.createDataFrame(got), "label").toPandas()
    assert len(m) == 12 and (m.n == 120).all()
    f1 = m.groupby("features").f1.mean()
    assert f1["series"] < min(f1["combined"], f1["stacked"], f1["text"])
    one = m[(m.features == "text") & (m.fold == 2)].iloc[0]
    own = got[(got.features == "text") & (got.fold == 2)]
    assert one.tp == ((own.score >= 0.5) & (own.label == 1)).sum() and one.fn == ((own.score < 0.5) & (own.label == 1)).sum()


def test_without_text_and_with_one_class(spark, small):
    rows, terms = small
    r = spark.createDataFrame(rows.assign(label=0)).limit(480)
    t = spark.createDataFrame(terms).limit(0)
    got = K.stacked_scores(r, t, ["unit", "day"], "label", ["x1"], 2).toPandas()
    assert len(got) == 4 * 120 and (got[got.features.isin(["text", "combined"])].score == 0).all() and (got.score < 0.2).all()
