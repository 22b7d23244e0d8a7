"""MinHash near-deduplication by fast similarity sketching, banding and exact verification.

Sketch: ``COORDS`` coordinates are filled in rounds. In round r < COORDS every shingle goes to one hashed
bin; a bin that is still empty after the earlier rounds keeps its smallest value. Round COORDS + b puts all
shingles into bin b, so that every coordinate of a non-empty set fills, whatever its size. Equal coordinates
estimate the Jaccard similarity with the concentration of independent hashing.

Banding: ``BANDS`` keys of ``ROWS`` coordinates. Texts with equal shingle sets are one representative. In a
bucket (one band key) every representative is paired with the bucket's HUBS hubs, never with all others; pairs
whose sketches agree in less than half of the coordinates are left out (for a similarity of 0.75 the chance is
below 1e-7), all others are confirmed on the full shingle sets. Where a bucket's members then lie in several
components, its strays (not in the hub's component) are joined with the members of all such buckets on rare shingles:
with the shingles of every set ordered rarest first, two sets that overlap in o shingles share one among the first
|x| - o + 1 of the one and the first |y| - o + 1 of the other, and a similarity of 0.75 needs o >= 3/7 (|x| + |y|).
So no link that joins two components is left out, and texts that share a passage but lie below the limit meet only
where their own shingles are too few to fill those places. What meets is confirmed as above. Components come from
label propagation on the confirmed links.

Defined results: null or empty text, or one without words, has n_shingles 0, is linked with nothing and kept. A
text of 1 to 4 words has its whole word sequence as one shingle. Repeated rows and equal texts share a component;
ties go to the smallest doc_id. Different texts under one doc_id are looked up under that id (one node). A null doc_id is linked with nothing, has a null component and is kept. Only the
id and text columns are read; extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import columns_of, components, handed_back, stored, text_batches, text_hash

COORDS, BANDS, ROWS = 128, 32, 4
HUBS = 3
CLASS = 1.1  # sets whose sizes differ by less than this factor share a size class
HOT = 10_000  # shingles that make up more than 1/HOT of all occurrences, so at most HOT of them, are broadcast
_U = np.uint64

SKETCH_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def similarity_sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, t: int = COORDS) -> np.ndarray:
    """Sketches (n_docs x t) of the sets given as (text number, element hash) pairs; all ones for an empty set."""
    empty = ~_U(0)
    out = np.full((n_docs, t), empty, np.uint64)
    flat = out.reshape(-1)
    salt = T.seeds(2 * t, 23)
    size = np.bincount(doc, minlength=n_docs)
    todo = size > 0
    d, x = doc.astype(np.int64), h
    for r in range(t):
        v = T.mix(x ^ salt[r])
        slot = d * t + (v >> _U(57)).astype(np.int64) % t
        free = flat[slot] == empty
        low = np.full(n_docs * t, empty, np.uint64) if r < 2 else None
        slot, v = slot[free], v[free] & _U((1 << 57) - 1)
        if low is not None:
            np.minimum.at(low, slot, v)
            hit = low != empty
            flat[hit] = low[hit]
        else:
            o = np.lexsort((v, slot))
            slot, v = slot[o], v[o]
            new = np.ones(len(slot), bool)
            new[1:] = slot[1:] != slot[:-1]
            flat[slot[new]] = v[new]
        if r % 4 == 3 or r < 2:
            todo &= (out == empty).any(1)
            keep = todo[d]
            d, x = d[keep], x[keep]
            if not len(d):
                return out
    for b in range(t):
        v = T.mix(x ^ salt[t + b]) & _U((1 << 57) - 1)
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        low = np.minimum.reduceat(v, first)
        who = d[first]
        gap = out[who, b] == empty
        out[who[gap], b] = low[gap]
    return out


def sketch_block(data: np.ndarray, off: np.ndarray):
    """n_shingles, two set keys, band keys and one byte per coordinate, for each text of a block."""
    n = len(off) - 1
    doc, h = T.shingle_sets(data, off)
    size = np.bincount(doc, minlength=n)
    sk = similarity_sketch(doc, h, n)
    c1 = np.zeros(len(h) + 1, np.uint64)
    c2 = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(T.mix(h ^ _U(0xA5A5A5A5)), out=c1[1:])
    np.cumsum(T.mix(h ^ _U(0x5A5A5A5A5A)), out=c2[1:])
    end = np.cumsum(size)
    keys = [T.mix(c[end] - c[end - size] + size.astype(np.uint64)).view(np.int64) for c in (c1, c2)]
    band = np.zeros((n, BANDS), np.uint64)
    mult = T.seeds(ROWS, 31) | _U(1)
    for j in range(ROWS):
        band += T.mix(sk[:, j::ROWS][:, :BANDS]) * mult[j]
    band = T.mix(band ^ T.seeds(BANDS, 37)[None, :]).view(np.int64)
    return size, keys, band, (T.mix(sk) >> _U(56)).astype(np.uint8)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end in ``data``, cut at the byte offsets ``at``, without a copy."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _sketches(batches):
    for b in batches:
        ids = b.column(0)
        for i, data, off in T.blocks(b.column(1)):
            size, keys, band, sk = sketch_block(data, off)
            n = len(size)
            yield pa.RecordBatch.from_arrays([
                ids.slice(i, n), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]),
                pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), band.reshape(-1)),
                _binary(sk.reshape(-1), np.arange(0, n * COORDS + 1, COORDS)),
                *(c.slice(i, n) for c in b.columns[2:]),
            ], names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch", *b.schema.names[2:]])


def _sets(batches):
    for b in batches:
        for i, data, off in T.blocks(b.column(1)):
            n = len(off) - 1
            doc, h = T.shingle_sets(data, off)
            at = np.searchsorted(doc, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, n), _binary(h, at * h.itemsize)],
                names=["doc_id", "elements"])


def _occurrences(batches):
    """One row for each shingle of a set."""
    for b in batches:
        end = np.cumsum(np.asarray(pc.binary_length(b.column(2)), np.int64) // 8)
        lo = 0
        while lo < len(b):
            before = end[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, before + (1 << 16), "right")))
            n = np.diff(end[lo:hi], prepend=before)
            h = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in b.column(2).slice(lo, hi - lo)])
            row = pa.array(np.repeat(np.arange(lo, hi), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.repeat(n, n)), pa.array(h)],
                                             names=["doc_id", "set", "n", "h"])
            lo = hi


def _likely(batches):
    """Pairs whose sizes and sketches allow a similarity of 0.75."""
    for b in batches:
        n = len(b)
        if not n:
            continue
        na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
        sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(n, COORDS) for c in (4, 5))
        ok = (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb)) & ((sa == sb).sum(1) >= COORDS // 2)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _linked(batches):
    """Exact check on the full sets: 100 * intersection >= 75 * union."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):  # views of the batch: sets of long texts are not copied
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Links:
    """Confirmed links between representatives; full sets are made once for each text that a pair names."""

    def __init__(self, docs: DataFrame, reps: DataFrame):
        self.docs, self.reps, self.sets, self.links = docs, reps, None, None

    def add(self, pairs: DataFrame, also: DataFrame | None = None) -> bool:
        """Confirm ``pairs(a, b)``; tells whether there are links, which are then in ``links``. ``also`` names texts whose
        sets later pairs will need."""
        r = self.reps.select("doc_id", "n_shingles", "sketch")
        pairs = (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                 .join(r.toDF("a", "na", "sa"), "a").join(r.toDF("b", "nb", "sb"), "b")
                 .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(handed_back(_likely), "a long, b long"))
        pairs = stored(pairs, "near-pairs")
        if pairs.isEmpty() and also is None:
            return False
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
        ids = (ids if also is None else ids.union(also)).distinct()
        if self.sets is None:
            self._make_sets(ids)
        else:
            ids = stored(ids.join(self.sets, "doc_id", "left_anti"), "near-new")
            if not ids.isEmpty():
                self._make_sets(ids)
        s = self.sets
        got = (pairs.join(s.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a")
               .join(s.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
               .select("a", "b", "x", "y").mapInArrow(handed_back(_linked), "a long, b long"))
        got = stored(got, "near-links")
        self.links = got
        return not got.isEmpty()

    def _make_sets(self, ids: DataFrame) -> None:
        found = (self.docs.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
                 .dropDuplicates(["doc_id", "h"]).select("doc_id", "text")
                 .mapInArrow(handed_back(_sets), "doc_id long, elements binary"))
        new = stored(found, "near-sets")
        self.sets = new if self.sets is None else self.sets.union(new)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row (see the module's text for the defined cases); with
    ``row_keys`` also text_hash, which with the id determines the decision."""
    docs = columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = df.sparkSession
    keys = ["text_hash"] if row_keys else []
    text_batches(spark)
    all_rows = stored(docs.select("doc_id", "text", *[text_hash().alias(c) for c in keys])
                      .mapInArrow(handed_back(_sketches), SKETCH_SCHEMA + "".join(f", {c} string" for c in keys)), "near-sketch")
    full = all_rows.drop(*keys).where("n_shingles > 0 and doc_id is not null")
    # one representative for each set; node = a doc_id, so rows that share a doc_id are one node
    rep = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    rep = stored(rep, "near-reps")
    reps = (full.join(rep.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"])
            .dropDuplicates(["doc_id", "k1", "k2"]))
    reps = stored(reps, "near-rep-sketch")
    entries = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    # hubs of a bucket: the smallest id and, for each seed, the id with the smallest hash; the same ids are hubs of
    # many buckets, so that few different pairs arise
    hubs = [F.min("rep").alias("hub")] + [F.min_by("rep", F.xxhash64("rep", F.lit(i))).alias(f"hub{i}") for i in range(1, HUBS)]
    shared = stored(entries.groupBy("key").agg(*hubs, F.max("rep").alias("top"), F.count("*").alias("n")).where("hub < top"),
                    "near-buckets")
    links = _Links(docs, reps)
    member = stored(entries.join(shared.drop("top"), "key"), "near-members")
    pairs = member.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array(
        "hub", *[f"hub{i}" for i in range(1, HUBS)]))).alias("b")).where("a <> b")
    comp = None
    if links.add(pairs, also=member.where("n > 2").select(F.col("rep").alias("doc_id"))):
        comp = components(links.links, "near-cc")
    # buckets of three or more whose members are still apart: strays (not in the hub's component) against members
    # of other components
    wide = _with_comp(_with_comp(member.where("n > 2").select("key", "rep", "hub"), comp, "rep", "comp"), comp, "hub", "hub_comp")
    wide = stored(wide.select("key", "rep", "comp", (F.col("comp") != F.col("hub_comp")).alias("stray")), "near-wide")
    apart = wide.where("stray").select("key").distinct()
    wide = stored(wide.join(apart, "key", "left_semi").groupBy(F.col("rep").alias("doc_id"), "comp")
                  .agg(F.max("stray").alias("stray")), "near-apart")
    if not wide.isEmpty() and links.add(_rare_pairs(links.sets, wide)):
        comp = _merged(comp, links.links)
    rep = rep.select("k1", "k2", F.col("rep").alias("node"))
    if comp is not None:
        rep = rep.join(comp, "node", "left").select("k1", "k2", F.coalesce("comp", "node").alias("node"))
    rep = rep.withColumn("linked", F.lit(True))
    out = all_rows.select("doc_id", *keys, "n_shingles", "k1", "k2").join(rep, ["k1", "k2"], "left")
    comp_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id"))
    return (out.select("doc_id", *keys, "n_shingles", comp_id.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _rare_pairs(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a stray and a text of another component that can be linked: some shingle lies, rarest first, so
    early in both sets that enough others may follow. ``texts`` has doc_id, comp, stray; ``sets`` their full sets."""
    own = (sets.join(texts.select("doc_id"), "doc_id", "left_semi").where(F.length("elements") > 0)
           .select("doc_id", F.xxhash64("elements").alias("set"), "elements").dropDuplicates(["doc_id", "set"]))
    occ = stored(own.mapInArrow(handed_back(_occurrences), "doc_id long, set long, n long, h long"), "near-occurrences")
    count = stored(occ.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-shared")
    total = count.agg(F.sum("df")).first()[0] or 0
    hot = count.where(F.col("df") * HOT > total)  # fewer than HOT rows, as their df add up to total at most
    marked = occ.join(F.broadcast(hot), "h", "left")
    cold = marked.where("df is null").drop("df").join(count.where(F.col("df") * HOT <= total), "h")
    # shingles of one text only come first and can't meet another: they only take up places
    ranked = (marked.where("df is not null").unionByName(cold).groupBy("doc_id", "set", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
              .join(texts, "doc_id")
              .withColumn("alone", F.col("n") - F.size("shared"))
              .withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(CLASS))).cast("int")))
    # for every size class of the other set, the places that may hold the first common shingle
    reach = int(np.ceil(np.log(4 / 3) / np.log(CLASS)))
    least = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("other"))) - 1, F.expr("(3 * n + 3) div 4"))
    places = (ranked.withColumn("other", F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach)))
              .where(F.pow(F.lit(CLASS), F.col("other") + 1) + 1 >= 0.75 * F.col("n"))
              .withColumn("least", least).where("3 * least <= 4 * n")
              .withColumn("last", F.expr("n - (3 * (n + least) + 6) div 7")).where("last >= alone")
              .select("doc_id", "comp", "stray", "n", "size", "other", "alone",
                      F.posexplode(F.expr("slice(shared, 1, cast(last - alone + 1 as int))")).alias("at", "x"))
              .select("doc_id", "comp", "stray", "n", "size", "other", (F.col("alone") + F.col("at")).alias("at"), "x.h"))
    places = stored(places, "near-places")
    s, m = places.where("stray").alias("s"), places.alias("m")
    need = F.expr("(3 * (s.n + m.n) + 6) div 7")
    met = s.join(m, [F.col("s.h") == F.col("m.h"), F.col("s.size") == F.col("m.other"), F.col("s.other") == F.col("m.size"),
                     F.col("s.comp") != F.col("m.comp"), ~F.col("m.stray") | (F.col("s.doc_id") < F.col("m.doc_id")),
                     4 * F.least("s.n", "m.n") >= 3 * F.greatest("s.n", "m.n"),
                     F.col("s.at") + need <= F.col("s.n"), F.col("m.at") + need <= F.col("m.n")])
    return met.select(F.least("s.doc_id", "m.doc_id").alias("a"), F.greatest("s.doc_id", "m.doc_id").alias("b"))


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new ``links``: only those links are followed, between the components there were."""
    if comp is None:
        return components(links, "near-cc")
    ends = _with_comp(_with_comp(links, comp, "a", "ca"), comp, "b", "cb")
    up = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-up")
    old = comp.join(up.toDF("comp", "_up"), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"))
    return stored(old.union(up.join(comp, "node", "left_anti").select("node", "comp")), "near-cc")


def _with_comp(df: DataFrame, comp: DataFrame | None, node: str, name: str) -> DataFrame:
    if comp is None:
        return df.withColumn(name, F.col(node))
    return (df.join(comp.toDF(node, "_c"), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c"))
