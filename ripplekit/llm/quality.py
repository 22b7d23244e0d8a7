"""Quality rules with an isolation forest on rule statistics.

``statistics`` counts, for every whole text, words, characters, symbols, repeated lines and repeated 5-word
windows (words are maximal runs of characters other than space and \\t..\\r). Two base rules fail a text outright:
fewer than 10 words, or more than a fifth of the words inside repeated windows. For the rest an isolation forest
for each rule statistic gives an anomaly score from the path lengths over random splits. For each statistic the
threshold above which a text is dropped is calibrated on the labelled rows; a statistic whose anomalies are mostly
good texts (digits, say) thereby gets a threshold that drops nothing.

The forest is fitted on a bounded sample (``SAMPLE_ROWS`` rows with the smallest hash of id and statistics; each
tree takes ``TREE_ROWS`` of them) and every row is scored. Calibration counts scores of all labelled rows in
``GRID`` score bins, so the driver holds that many rows.

Defined results: null or empty text has all counts 0 and fails the base rules. Repeated rows are judged each.
Rows with a null id are judged but not used for calibration. Without labelled rows of both classes all
thresholds are ``DEFAULT_THRESHOLD``. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import columns_of, smallest, stored

SAMPLE_ROWS = 20_000
TREE_ROWS = 256
TREES = 64
GRID = 2000
DEFAULT_THRESHOLD = 0.75
#: A dropped good text costs as much as this many kept bad ones.
GOOD_COST = 20.0
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
# fixed values: the symbols that the base statistics count
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_digits", "n_marks", "n_doubled"]
FEATURES = ["symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "digit_rate", "mark_rate",
            "doubled_rate"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER, _LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT | _SYMBOL)


def block_statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of every text of a block."""
    n = len(off) - 1
    s, e, doc = T.words(data, off)
    roll = T.Rolling(data)
    firsts = T.first_bytes(data)
    c = {"n_words": np.bincount(doc, minlength=n),
         "word_chars": T.count_where(firsts & ~T._SPACE[data], off)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT),
                        ("n_marks", _MARK)):
        c[name] = T.count_where(table[data], off)
    # lines: cut at \n; those with a word count as repeated when an equal one came before in the text
    nl = np.flatnonzero(data == 10)
    ls = np.concatenate([off[:-1], nl + 1])
    le = np.concatenate([nl, off[1:]])
    ls.sort()
    le.sort()
    has = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[has], le[has]
    ld = np.searchsorted(off, ls, "right") - 1
    c["n_lines"] = np.bincount(ld, minlength=n)
    c["n_dup_lines"] = c["n_lines"] - np.bincount(T.distinct(ld, roll.of(ls, le))[0], minlength=n)
    wh = roll.of(s, e)
    twice = np.zeros(len(s), bool)
    twice[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    c["n_doubled"] = np.bincount(doc[twice], minlength=n)
    # words that some 5-word window found twice or more in the text covers
    at, h = T.windows(doc, wh, WINDOW)
    o = T.by_doc(doc[at], h)
    same = (h[o][1:] == h[o][:-1]) & (doc[at][o][1:] == doc[at][o][:-1])
    again = np.zeros(len(o), bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(len(s) + WINDOW + 1, np.int64)
    hit = at[o[again]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    inside = np.cumsum(cover)[:len(s)] > 0
    c["n_repeat_words"] = np.bincount(doc[inside], minlength=n)
    return c


def _statistics(batches):
    for b in batches:
        for i, data, off in T.blocks(b.column(1)):
            c = block_statistics(data, off)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, len(off) - 1)] + [pa.array(c[k].astype(np.int64)) for k in COUNTS],
                names=["doc_id", *COUNTS])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every row."""
    return (columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_statistics, STATS_SCHEMA))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["word_chars"] / words, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / chars, c["n_marks"] / chars,
        c["n_doubled"] / words])


class IsolationForest:
    """Random-split trees over a sample; short mean path lengths mark anomalies (scores near 1)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.rows = max(2, min(rows, len(x)))
        self.depth = int(np.ceil(np.log2(self.rows)))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, np.int16)
        self.split = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 0, x[rng.permutation(len(x))[:self.rows]] if len(x) else x, 0, rng)

    @staticmethod
    def mean_path(n):
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                        np.where(n == 2, 1.0, 0.0))

    def _grow(self, t, node, x, depth, rng):
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else ()
        if depth >= self.depth or not len(spread):
            self.length[t, node] = depth + float(self.mean_path(len(x)))
            return
        f = rng.choice(spread)
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        self.feature[t, node], self.split[t, node] = f, cut
        left = x[:, f] <= cut
        self._grow(t, 2 * node + 1, x[left], depth + 1, rng)
        self._grow(t, 2 * node + 2, x[~left], depth + 1, rng)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, s, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = f[node]
                node = np.where(k < 0, node, 2 * node + 1 + (x[rows, np.maximum(k, 0)] > s[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(float(self.mean_path(self.rows)), 1e-9))


def score_steps(forest: IsolationForest) -> tuple[np.ndarray, np.ndarray]:
    """A one-statistic forest's score as a step function: cut points and the score up to each cut (and beyond)."""
    cuts = np.unique(forest.split[forest.feature >= 0])
    return cuts, forest.scores(np.append(cuts, np.inf)[:, None])


def _scorer(forests: list[IsolationForest]):
    steps = [score_steps(f) for f in forests]

    def scored(batches):
        for b in batches:
            if len(b):
                x = features({k: b.column(k).to_numpy() for k in COUNTS})
                got = np.column_stack([v[np.searchsorted(cuts, x[:, j])] for j, (cuts, v) in enumerate(steps)])
                at = np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, got.reshape(-1))],
                                                 names=[*b.schema.names, "anomaly"])
    return scored


def base_failed():
    """The base rules as a column over COUNTS."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def calibrate(scored: DataFrame, labels: DataFrame) -> list[float]:
    """Thresholds of the statistics' scores, chosen one statistic at a time: the next is the one that takes most off
    the cost (share of bad rows kept plus GOOD_COST times the share of good rows dropped) among the rows that the
    earlier ones keep. A statistic that does not pay gets a threshold above all scores."""
    marked = stored(scored.join(columns_of(labels, doc_id="doc_id", good="quality").where("good is not null"), "doc_id")
                    .select(F.col("good").cast("boolean").alias("good"), "anomaly"), "quality-labelled")
    limits, total = [2.0] * len(FEATURES), None
    while True:
        left = marked.where(~_any_over(limits))
        rows = (left.select("good", F.posexplode("anomaly").alias("stat", "score"))
                .groupBy("stat", F.floor(F.col("score") * GRID).cast("int").alias("bin"), "good").count().collect())
        n = np.zeros((2, len(FEATURES), GRID + 1))
        for r in rows:
            n[int(r["good"]), r["stat"], min(r["bin"], GRID)] += r["count"]
        if total is None:
            total = n.sum(2).max(1)
            if not total.all():
                return [DEFAULT_THRESHOLD] * len(FEATURES)
        bad, good = (np.cumsum(n[k][:, ::-1], 1)[:, ::-1] / total[k] for k in (0, 1))  # shares at or above each bin
        gain = bad - GOOD_COST * good
        j, at = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, at] <= 1e-3 or limits[j] < 2.0:
            return limits
        ties = np.flatnonzero(gain[j] >= gain[j, at] - 1e-12)
        limits[j] = float(ties[len(ties) // 2]) / GRID


def _any_over(limits: list[float]):
    return F.greatest(F.lit(False), *[F.col("anomaly")[j] >= t for j, t in enumerate(limits)])


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed, the statistics' anomaly scores, the failing statistics and kept for every row."""
    stats = stored(statistics(df, id_col, text_col).withColumn("base_failed", base_failed()), "quality-stats")
    rows = smallest(stats.where("not base_failed").select("doc_id", *COUNTS), sample_rows, "doc_id", *COUNTS).toPandas()
    x = features({k: rows[k].to_numpy() for k in COUNTS})
    forests = [IsolationForest(x[:, [j]], seed=17 + j) for j in range(len(FEATURES))]
    names = ", ".join(f"{c} long" for c in COUNTS)
    scored = stats.mapInArrow(_scorer(forests), f"doc_id long, {names}, base_failed boolean, anomaly array<double>")
    limits = calibrate(scored.where("not base_failed"), labels)
    failing = F.filter(F.array(*[F.when(F.col("anomaly")[j] >= t, F.lit(name))
                                 for j, (name, t) in enumerate(zip(FEATURES, limits))]), lambda v: v.isNotNull())
    return (scored.withColumn("failing", failing)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failing") == 0)))
