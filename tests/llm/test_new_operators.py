"""Fill-in-middle, periodic runs and exact top-k against brute force, with the special cases of conftest.py."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplekit.llm import fim, maxscore, periodic
from ripplekit.llm.queries import QUERIES

from .conftest import prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 fill-in-middle -------------------------------------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(rows):
    out = []
    for i, t in rows:
        n, form, p, m, output = plain_fim(i, t)
        out.append((i, n, form, p, m, sha(output), sha(t or ""), output))
    return sorted(out, key=repr)


@pytest.mark.parametrize("units", [1, 7, 4096])
def test_fim_equals_plain_version(spark, docs, no_docs, monkeypatch, units):
    monkeypatch.setattr(fim, "UNITS", units)
    odd = ["<P>", "a<S>b", "<", "<<P", "S><M", "a1b2<c", "é<P >x", "\x00 \n\r", "文" * 9000 + "ab" * 9000, " ", "<M", "P>"]
    rows = [(1000 + i, t) for i, t in enumerate(odd * 6)] + [(-5, "neg ative"), (None, "no id"), (None, None), (3, "x y")]
    rows += [(3, "x y")] * 40
    more = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, form string").repartition(3)
    if units == 4096:
        more = more.select("doc_id", "text").union(docs.select("doc_id", "text"))
        rows = rows + [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in fim.transformed(more).collect()), key=repr)
    want = fim_rows(rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    bare = fim.transformed(more, texts=False)
    assert sorted((tuple(r) for r in bare.collect()), key=repr) == sorted((r[:-1] for r in want), key=repr)
    assert fim.transformed(no_docs).count() == 0


def test_fim_sections_over_any_chunks():
    rng = random.Random(5)
    for _ in range(300):
        p, s, m = ("".join(rng.choice("<>PSM a") for _ in range(rng.randrange(6))).encode() for _ in range(3))
        if any(x in p + s + m for x in fim.ORDER["psm"]) or any(x in t for t in (p, s, m) for x in fim.ORDER["psm"]):
            continue
        for form, order in (("psm", (p, s, m)), ("spm", (s, p, m))):
            whole = b"".join(tag + x for tag, x in zip(fim.ORDER[form], order))
            cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(rng.randrange(5)))
            parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
            back = dict.fromkeys(fim.ORDER[form], b"")
            for tag, data in fim.sections(form, parts):
                back[tag] += data
            assert (back[b"<P>"], back[b"<S>"], back[b"<M>"]) == (p, s, m)


# --- 12 periodic runs --------------------------------------------------------------------------------------------

def plain_runs(w):
    """Every maximal stretch by its definition, smallest period first."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_periodic(doc_id, text, tails=False):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tails and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(2)
    for letters, n in ((1, 300), (2, 500), (3, 400), (40, 600)):
        ids = rng.integers(0, letters, n)
        ids[n // 3:n // 3 + 200] = ids[n // 3]
        ids = np.append(ids, 99)
        for r in (2, 3, 8):
            ext = periodic.Extensions(ids, r)
            order = sorted((p for p in range(len(ids)) if periodic.cover(r)[p % (r * r)]), key=lambda p: ids[p:].tolist())
            assert np.array_equal(ext.places[np.argsort(ext.rank)], order)
            a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
            a, b = a[a != b], b[a != b]
            for x, y, got in zip(a, b, ext.of(a, b)):
                k = 0
                while max(x, y) + k < len(ids) and ids[x + k] == ids[y + k]:
                    k += 1
                assert got == k


def test_runs_equal_plain_version(spark, docs, no_docs):
    rng = random.Random(11)
    texts = ["a " * n for n in (5, 6, 7, 700)] + ["a b " * 3, "a b " * 4, "a b a b a b a", "x " + "a b c " * 9 + "a b y", "a b c d " * 300]
    for _ in range(150):
        out = []
        for _ in range(rng.randrange(1, 12)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            out += unit * rng.randrange(1, 7)
        texts.append(rng.choice(" \t").join(out))
    texts.append(" ".join(["é 文"] * 5000) + "\n" + prose(rng, 3000))
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b")]
    rows += [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, runs string").repartition(3)
    for tails in (False, True):
        got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                      for r in periodic.periodic_runs(df, tails=tails).collect()), key=repr)
        assert got == sorted(((i, *plain_periodic(i, t, tails)) for i, t in rows), key=repr)
    assert periodic.periodic_runs(no_docs).count() == 0


def test_runs_in_small_grid_steps(monkeypatch, spark):
    monkeypatch.setattr(periodic, "POINTS", 50)
    ids = np.array([9, *[1, 2, 3] * 40, 10, *[4] * 30, 5, *[4, 5] * 9, 11])
    got = [x.tolist() for x in periodic.runs(ids, np.array([1, 122]), np.array([120, 49]))]
    want = sorted([(1 + s, 1 + s + n, q) for s, n, q in plain_runs(ids[1:121].tolist())]
                  + [(122 + s, 122 + s + n, q) for s, n, q in plain_runs(ids[122:171].tolist())])
    assert list(zip(*got)) == want


def test_runs_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        _, runs, collapsed = plain_periodic(i, t, True)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (
            len(runs), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed))
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert sum(bool(r.n_runs) for r in got.values()) > 10


# --- 13 exact top-k ----------------------------------------------------------------------------------------------

def plain_top(rows, k, every):
    v = [(i, np.floor(256 * np.array(x, float)).astype(np.int64)) for i, x in rows
         if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (i, x) in enumerate(v):
        if i is None or i % every:
            continue
        scored = [(-int(x[:min(len(x), len(y))] @ y[:min(len(x), len(y))]), j is None, j) for b, (j, y) in enumerate(v) if b != a]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block", [(4096, 4096), (7, 3)])
def test_top_k_equals_plain_version(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(-60, 240)]
    rows += [(int(i), [float(x) for x in rng.choice([0, 0, 0, 0, 0.5, -0.5], 12)]) for i in range(240, 420)]
    rows += [(500, None), (501, [0.1, None]), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (550, []),
             (600, [0.0] * 12), (601, [0.3] * 3), (650, [-0.2] * 20), (None, [0.25] * 12), (None, [0.25] * 12), (700, [0.25] * 12)]
    rows += [rows[60 + 50]] * 9 + [rows[10]] * 3  # repeated rows, queries among them
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    got = sorted((tuple(r) for r in maxscore.top_k(df.repartition(3)).collect()), key=repr)
    assert got == plain_top(rows, 5, 50)
    few = df.where("vec_id in (100, 101)").dropDuplicates(["vec_id"])
    assert maxscore.top_k(few).count() == 1
    assert maxscore.top_k(few.where("vec_id = 100")).count() == 0
    assert maxscore.top_k(df.limit(0)).count() == 0


def test_top_k_skips_and_stays_exact():
    rng = np.random.default_rng(9)
    data = np.floor(rng.normal(0, 30, (5000, 32)) * np.geomspace(8, 0.1, 32)).astype(np.int64)
    best = maxscore.Best(data[0], 5, (0, 0))
    for s in range(5):
        best.search(maxscore.Shard(np.arange(1000) + 1000 * s, np.ones(1000, bool), data[1000 * s:1000 * s + 1000], s))
    want = sorted((-int(data[0] @ y), i) for i, y in enumerate(data) if i)[:5]
    assert list(zip((-best.score).tolist(), best.id.tolist())) == want
    with pytest.raises(ValueError):
        best.search(maxscore.Shard(np.arange(1), np.ones(1, bool), np.full((1, 32), 2 ** 61), 9))
