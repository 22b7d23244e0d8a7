"""Different texts that hash equal modulo a power of two, whatever the base: Thue-Morse words and their complements."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplekit.llm import chat, fingerprint, neardup, quality, repeats
from ripplekit.llm import textops as T


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(a, b) for a, b in itertools.combinations("abceqz{~", 2)]


def test_hashes_of_recursive_words_differ():
    words = [w for a, b in PAIRS for w in (thue_morse(2048, a, b), thue_morse(2048, b, a))]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    for lower in (False, True):
        roll = T.Rolling(data, lower)
        for n in (512, 1024, 2048):
            start = np.arange(len(words)) * 2048
            assert len(np.unique(roll.of(start, start + n))) == len(words)


def test_hash_of_a_range_does_not_depend_on_its_place():
    data = np.frombuffer(b"abc" * 400 + b"x" + b"abc" * 400, np.uint8)
    roll = T.Rolling(data)
    a, b = roll.of(np.array([0, 3, 1201]), np.array([300, 303, 1501])), roll.of(np.array([0, 1]), np.array([4, 5]))
    assert len(set(a.tolist())) == 1 and b[0] != b[1]
    assert roll.of(np.array([5]), np.array([5])) == roll.of(np.array([9]), np.array([9]))


def test_operators_tell_them_apart(spark):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, x), (2, y), (3, x + "\n" + y)], "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert got[1].component_id == 1 and got[2].component_id == 2 and got[2].kept
    sketch = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert sketch[1] != sketch[2]
    assert {r.doc_id: r.n_dup_lines for r in quality.statistics(docs).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("letters", [("ab", "ce"), ("qz", "be"), ("ac", "bq")])
def test_contexts_of_one_anchor_are_told_apart(spark, letters):
    (a, b), (c, e) = letters
    gap = "".join(chr(33 + (i * i * 7 + 3 * i) % 90) for i in range(128))
    one = thue_morse(256, a, b) + gap + thue_morse(256, c, e)
    two = thue_morse(256, b, a) + gap + thue_morse(256, e, c)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r.n_removed for r in repeats.without_repeats(docs).collect()] == [0, 0]


def test_no_path_ends_in_a_cycle(spark):
    rows = [("c", 1, 2), ("c", 2, 1), ("c", 3, 1), ("ok", 1, None), ("ok", 2, 1), ("ok", 3, 1), ("gap", 5, 4), ("self", 1, 1), ("self", 2, 1)]
    m = spark.createDataFrame([(*r, "user", "t", 0.0) for r in rows], "tree string, msg long, parent long, role string, text string, score double")
    got = sorted((r.tree, r.leaf, r.msg, r.up) for r in chat.paths(m).collect())
    assert got == [("gap", 5, 5, 0), ("ok", 2, 1, 1), ("ok", 2, 2, 0), ("ok", 3, 1, 1), ("ok", 3, 3, 0)]
    assert {(r.tree, r.n_turns) for r in chat.conversations(m).collect()} == {("gap", 1), ("ok", 2)}
