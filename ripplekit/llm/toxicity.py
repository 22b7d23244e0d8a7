"""Toxicity by a convolutional text classifier trained in numpy.

Every word (lower-cased A-Z) is the sum of hashed embeddings of itself and of its first bytes (``PREFIXES``).
Filters of ``WIDTHS`` words slide over the whole text, each filter's largest response in the text is kept (0 if
the text has no window of that width or no positive response), and a logistic unit reads these maxima.

Training takes a bounded sample of labelled rows outside the held-out fold: the rows of each class with the smallest
hash of their id, at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` and never more than all but one in ``SPARED`` of the class.
Of rows that share a sampled id one is taken (the smallest hash of its text); in the order of the ids' hashes, documents
whose words no longer fit into the class's half of ``WORDS`` are passed over and calibrate instead.
Scores of all other labelled rows outside the fold then calibrate, at every size of the input: each class's rows are
weighted to the count that the class has outside the fold, sample included. They give one threshold for all (it becomes
score 0.5) and one for each language with ``LANG_ROWS`` or more such rows of each class. With fewer than ``LEAST_ROWS``
of either class in all, score 0.5 is the network's own even odds. Labels, language, source and id are never inputs of a
score; the language only selects the threshold of ``rejected``.

Defined results: null or empty text has no windows and gets the score of the bias. Repeated rows get equal scores.
Rows with a null id are scored and not held out. Null labels are left out of training. With no labelled row of one
class every score is 0 and nothing is rejected. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import columns_of, handed_back, smallest, stored, text_hash, text_batches

BUCKETS, DIM, FILTERS = 1 << 15, 16, 12
WIDTHS = (1, 2, 3)
PREFIXES = (5, 7)
TOXIC_ROWS, CLEAN_ROWS = 2500, 3500
SPARED = 5
WORDS = 10_000_000
LEAST_ROWS, LANG_ROWS = 5, 50
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.08, 5
DROP = 0.5
FOLDS = 5
BINS, RANGE = 800, 40.0
STEP = 2 * RANGE / BINS
BLOCK = 1 << 20


def word_ids(data: np.ndarray, off: np.ndarray):
    """(text number, bucket ids: one column for the word and one for each prefix) of every word of a block."""
    s, e, doc = T.words(data, off)
    roll = T.Rolling(data, lower=True)
    ids = [roll.of(s, e)] + [T.mix(roll.of(s, np.minimum(e, s + n)) ^ np.uint64(n)) for n in PREFIXES]
    return doc, np.column_stack([x % np.uint64(BUCKETS) for x in ids]).astype(np.int32)


class ConvNet:
    """Hashed embeddings, filters of several widths, max pooling, one logistic unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(f)
        self.filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(f) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, f) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f)
        self.shift = np.zeros(1, f)

    def _responses(self, x: np.ndarray, doc: np.ndarray):
        """For each width the first word of every window and the filters' responses there."""
        for w, k, b in zip(WIDTHS, self.filters, self.bias):
            m = len(x) - w + 1
            if m <= 0:
                yield np.zeros(0, np.int64), np.zeros((0, FILTERS), np.float32)
                continue
            y = x[:m] @ k[0]
            for j in range(1, w):
                y += x[j:j + m] @ k[j]
            at = np.flatnonzero(doc[:m] == doc[w - 1:])
            yield at, (y if len(at) == m else y[at]) + b

    def _embedded(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids[:, 0]]
        for c in range(1, ids.shape[1]):
            x = x + self.emb[ids[:, c]]
        return x

    def logits(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        for i, (at, y) in enumerate(self._responses(self._embedded(ids), doc)):
            if len(at):
                d = doc[at]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                pooled[d[first], i * FILTERS:(i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, first), 0)
        return pooled @ self.out + self.shift[0]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adagrad on the logistic loss; only the windows that win the pooling get a gradient. Every step leaves out
        a random share ``DROP`` of the words, so that no text is told by one of its words alone."""
        rng = np.random.default_rng(seed)
        dense = [*self.filters, *self.bias, self.out, self.shift]
        memory = [np.full_like(p, 1e-4) for p in dense]
        emb_memory = np.full(BUCKETS, 1e-4, np.float32)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
                kept = [texts[i][rng.random(len(texts[i])) >= DROP] for i in batch]
                ids = np.concatenate(kept)
                doc = np.repeat(np.arange(len(batch)), [len(x) for x in kept])
                x = self._embedded(ids)
                best, tops = [], np.zeros((len(batch), len(WIDTHS) * FILTERS), np.float32)
                for i, (at, y) in enumerate(self._responses(x, doc)):
                    win = np.zeros((len(batch), FILTERS), np.int64)
                    cut = np.searchsorted(doc[at], np.arange(len(batch) + 1))
                    for n in range(len(batch)):
                        if cut[n + 1] > cut[n]:
                            part = y[cut[n]:cut[n + 1]]
                            t = part.argmax(0)
                            win[n] = at[cut[n] + t]
                            tops[n, i * FILTERS:(i + 1) * FILTERS] = part[t, np.arange(FILTERS)]
                    best.append(win)
                pooled = np.maximum(tops, 0)
                p = 1 / (1 + np.exp(-(pooled @ self.out + self.shift[0])))
                err = ((p - labels[batch]) / len(batch)).astype(np.float32)
                grads = [np.zeros_like(a) for a in dense]
                grads[-2][:], grads[-1][:] = pooled.T @ err, err.sum()
                back = err[:, None] * self.out[None, :] * (tops > 0)
                rows, moves = [], []
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS:(i + 1) * FILTERS]
                    grads[len(WIDTHS) + i][:] = g.sum(0)
                    n, f = np.nonzero(g)
                    at = best[i][n, f]
                    for j in range(w):
                        np.add.at(grads[i][j].T, f, x[at + j] * g[n, f][:, None])
                        move = self.filters[i][j][:, f].T * g[n, f][:, None]
                        for c in range(ids.shape[1]):
                            rows.append(ids[at + j, c])
                            moves.append(move)
                rows = np.concatenate(rows)
                if len(rows):
                    touched, back_at = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(touched), DIM), np.float32)
                    np.add.at(total, back_at, np.concatenate(moves))
                    emb_memory[touched] += (total ** 2).mean(1)
                    self.emb[touched] -= RATE * total / np.sqrt(emb_memory[touched])[:, None]
                for a, g, m in zip(dense, grads, memory):
                    m += g * g
                    a -= RATE * g / np.sqrt(m)


def _word_lists(batches):
    for b in batches:
        for i, data, off in T.blocks(b.column(2), BLOCK):
            n = len(off) - 1
            doc, ids = word_ids(data, off)
            at = np.searchsorted(doc, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, n), b.column(1).slice(i, n),
                 pa.array([ids[at[j]:at[j + 1]].tobytes() for j in range(n)], pa.binary())],
                names=["doc_id", "toxic", "ids"])


def _scored(net: ConvNet | None):
    def run(batches):
        for b in batches:
            for i, data, off in T.blocks(b.column(1), BLOCK):
                n = len(off) - 1
                logit = net.logits(*word_ids(data, off), n).astype(np.float64) if net else np.full(n, -np.inf)
                names = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, n) for c in names), pa.array(logit)],
                                                 names=[*names, "logit"])
    return run


def held_out(doc_id):
    """The fold that neither training nor calibration sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, words: int = WORDS):
    """Word lists and labels of the bounded sample; at most toxic_rows + clean_rows ids are broadcast, and as many word
    lists of at most ``words`` words in all reach the driver."""
    marked = (columns_of(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null")
              .where(~held_out(F.col("doc_id"))).withColumn("toxic", F.col("toxic").cast("int")).distinct())
    there = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    few = {y: max(1, min(n, there.get(y, 0) * (SPARED - 1) // SPARED)) for y, n in ((1, toxic_rows), (0, clean_rows))}
    sample = (smallest(marked.where("toxic = 1"), few[1], "doc_id")
              .union(smallest(marked.where("toxic = 0"), few[0], "doc_id")))
    one = (docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic")
           .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
           .select("doc_id", "toxic", "first.text").mapInArrow(handed_back(_word_lists), "doc_id long, toxic int, ids binary"))
    one = stored(one, "toxic-words")
    sizes = one.select("doc_id", "toxic", (F.octet_length("ids") / (4 + 4 * len(PREFIXES))).cast("long").alias("words"))
    room, taken = {0: words // 2, 1: words // 2}, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["words"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["words"]
            taken.append((r["doc_id"], r["toxic"]))
    sample = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    rows = one.join(F.broadcast(sample), ["doc_id", "toxic"]).orderBy("doc_id").toPandas()
    texts = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows["ids"]]
    return texts, rows["toxic"].to_numpy().astype(np.float32), sample


def best_cut(toxic: np.ndarray, clean: np.ndarray) -> int:
    """The bin from which on rows count as toxic: the best F1, in the middle of its ties."""
    tp, fp = np.cumsum(toxic[::-1])[::-1], np.cumsum(clean[::-1])[::-1]
    f1 = 2 * tp / np.maximum(tp + fp + toxic.sum(), 1e-9)
    ties = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return int(ties[(len(ties)) // 2])


def thresholds(cells) -> tuple[float, dict[str, float]]:
    """The logit of score 0.5, and languages' own limits, from counts by (lang, toxic, trained, bin)."""
    left: dict = {}
    full: dict = {}
    for r in cells:
        lang, y = r["lang"], int(r["toxic"] != 0)
        full.setdefault(lang, np.zeros(2))[y] += r["count"]
        left.setdefault(lang, np.zeros((2, BINS)))
        if not r["trained"]:
            left[lang][y, r["bin"]] += r["count"]

    def limit(n: np.ndarray, whole: np.ndarray) -> float:
        toxic, clean = n[1] * (whole[1] / n[1].sum()), n[0] * (whole[0] / n[0].sum())
        return best_cut(toxic, clean) * STEP - RANGE

    def enough(n: np.ndarray, rows: int) -> bool:
        return n.sum(1).min() >= rows

    total = sum(left.values(), np.zeros((2, BINS)))
    cut = limit(total, sum(full.values())) if enough(total, LEAST_ROWS) else 0.0
    return cut, {lang: limit(n, full[lang]) for lang, n in left.items() if lang is not None and enough(n, LANG_ROWS)}


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, row_keys: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected (by the language's threshold) for every row; with ``row_keys`` also
    lang and text_hash, which with the id determine the decision."""
    docs = (columns_of(df, doc_id=id_col, text=text_col, lang=lang_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .withColumn("lang", F.col("lang").cast("string")))
    text_batches(df.sparkSession)
    texts, y, sample = training_rows(docs, labels, toxic_rows, clean_rows)
    net = None
    if len(set(y.tolist())) == 2:
        net = ConvNet()
        net.fit(texts, y)
    keys = ["lang", "text_hash"] if row_keys else []
    rows = docs.select("doc_id", "text", "lang", *[text_hash().alias(c) for c in keys[1:]])
    rows = rows.mapInArrow(handed_back(_scored(net)), f"doc_id long, lang string, {'text_hash string, ' if row_keys else ''}logit double")
    out = rows.withColumn("held_out", held_out(F.col("doc_id")))
    if net is None:
        return out.select("doc_id", *keys, "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                          F.lit(False).alias("rejected"))
    out = stored(out, "toxic-logits")
    place = F.least(F.greatest(F.floor((F.col("logit") + RANGE) / STEP), F.lit(0)), F.lit(BINS - 1)).cast("int")
    seen = (out.where("not held_out and doc_id is not null")
            .join(columns_of(labels, doc_id="doc_id", toxic="toxic").where("toxic is not null"), "doc_id")
            .join(F.broadcast(sample.select("doc_id", F.lit(True).alias("in_sample")).distinct()), "doc_id", "left"))
    cut, own = thresholds(seen.groupBy("lang", F.col("toxic").cast("int").alias("toxic"), F.col("in_sample").isNotNull().alias("trained"),
                                       place.alias("bin")).count().collect())
    limit = F.lit(cut)
    if own:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col("lang")], limit)
    score = 1 / (1 + F.exp(F.lit(cut) - F.col("logit")))
    return (out.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .withColumn("rejected", F.col("logit") >= limit)
            .select("doc_id", *keys, "held_out", "score", "predicted", "rejected"))
