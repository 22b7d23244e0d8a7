"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct 5-word shingle hash below 2^64 / SCALE, whatever the text's length, so sketches of
very unequal texts estimate containment, and the sketch of a union is the union of the sketches. The smallest
hash is always kept as well, so that a short text with no hash below the threshold still has a sketch; a union's
smallest hash is the smaller of the two, so merging stays exact.

A fingerprint is the ascending list of the kept hashes, each as 16 hex digits, joined by ``.``; a text without
words has the empty fingerprint. ``likeness`` estimates the Jaccard similarity of two shingle sets from two
fingerprints (two empty fingerprints: 1; one empty: 0).

``edited_pairs`` puts each text beside its successor by descending id. Texts are dealt once to id ranges, the
head of each range is also sent to the range before it, and every range is read in order by one task, so no window
spans the table. Null text counts as empty; rows with a null id come last; equal ids are ordered by text;
repeated rows are rows of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import columns_of

SCALE = 4
_U = np.uint64
_LIMIT = _U((1 << 64) // SCALE - 1)


def sketch_lists(col) -> list:
    """The kept hashes of every text of an Arrow string column, ascending uint64 arrays."""
    out = []
    for _, data, off in T.blocks(col):
        n = len(off) - 1
        doc, h = T.shingle_sets(data, off)
        keep = h <= _LIMIT
        keep[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[:len(h)]] = True  # each text's smallest
        doc, h = doc[keep], h[keep]
        at = np.searchsorted(doc, np.arange(n + 1))
        out += [h[at[j]:at[j + 1]] for j in range(n)]
    return out


def to_string(sketch: np.ndarray) -> str:
    hexa = sketch.astype(">u8").tobytes().hex()
    return ".".join(hexa[i:i + 16] for i in range(0, len(hexa), 16))


def from_string(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp.replace(".", "")), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two texts' shingle sets."""
    u = np.union1d(a, b)
    return np.r_[u[:1], u[1:][u[1:] <= _LIMIT]]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; empty a: 1."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def _fingerprints(batches):
    for b in batches:
        if len(b):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([to_string(s) for s in sketch_lists(b.column(1))], pa.string())],
                names=["doc_id", "fingerprint"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    return (columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_fingerprints, "doc_id long, fingerprint string"))


def _pairs(batches):
    """Rows (bucket, doc_id, guest, text) of ordered id ranges -> result rows; the last row of a range waits for
    the guest, which is the head of the next range."""
    held = None  # the last row of what came before: bucket, doc_id, guest, text, its sketch
    for b in batches:
        if not len(b):
            continue
        for lo in range(0, len(b), 2000):
            part = b.slice(lo, 2000)
            texts = pc.fill_null(part.column(3), "").to_pylist()
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts,
                            sketch_lists(part.column(3))))
            if held is not None:
                rows.insert(0, held)
            held = rows.pop()
            yield _edited(rows, [*rows[1:], held])
    if held is not None:
        yield _edited([held], [held])


def _edited(rows, nexts):
    ids, n_chars, sha, fps, efps, near_e, near_n, edits, keep = [], [], [], [], [], [], [], [], []
    for (bucket, doc, guest, text, sk), nx in zip(rows, nexts):
        if guest:
            continue
        third = len(text) // 3
        edited = text[:len(text) - third] + nx[3][:third]
        ids.append(doc)
        n_chars.append(len(text))
        edits.append(edited)
        sha.append(hashlib.sha256(edited.encode()).hexdigest())
        fps.append(to_string(sk))
        near_n.append(likeness(sk, nx[4]))
        keep.append(sk)
    for sk, e in zip(keep, sketch_lists(pa.array(edits, pa.string()))):
        efps.append(to_string(e))
        near_e.append(likeness(sk, e))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(sha, pa.string()), pa.array(fps, pa.string()),
         pa.array(efps, pa.string()), pa.array(near_e, pa.float64()), pa.array(near_n, pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text (the last third replaced by the head of the next text) and
    their likenesses. ``ranges``: id ranges, by default four for each shuffle partition; the driver holds one id
    for each range."""
    spark = df.sparkSession
    docs = columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))
    cuts = cuts or [0.0]  # an empty table, or one id: any place will do
    # range 0 holds the highest ids; null ids are in a last range of their own
    last = len(cuts) + 1
    deal = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_range")

    def placed(d):
        d = deal.transform(d.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        low = F.lit(len(cuts)) - F.col("_range").cast("int")
        return d.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(low)).drop("_at", "_range")

    tops = placed(docs.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    if not tops:
        return docs.limit(0).mapInArrow(_pairs_empty, _SCHEMA)
    heads = [(tops[i - 1]["bucket"], t["bucket"], t["top"]) for i, t in enumerate(tops)]  # range before, range, its highest id
    ids = [h[2] for h in heads if h[2] is not None]
    head_rows = placed(docs.where(F.col("doc_id").isin(ids) if ids else F.lit(False)))
    if any(h[2] is None for h in heads):
        head_rows = head_rows.unionByName(placed(docs.where("doc_id is null")))
    first = head_rows.groupBy("bucket", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    move = F.create_map(*[F.lit(x) for h in heads for x in (h[1], h[0])])
    guests = first.select(move[F.col("bucket")].cast("int").alias("bucket"), "doc_id", F.lit(True).alias("guest"), "text")
    own = placed(docs).select("bucket", "doc_id", F.lit(False).alias("guest"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (own.unionByName(guests).repartition(parts, "bucket")
             .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"))
    return dealt.mapInArrow(_pairs, _SCHEMA)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _pairs_empty(batches):
    return iter(())
