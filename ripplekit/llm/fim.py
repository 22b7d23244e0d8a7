"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a run of ASCII letters, or any other single character). Two hash draws choose where its
prefix and its middle end, two more the form: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) or ``spm``
(suffix, prefix, middle), each section behind its sentinel.

One shuffle carries the work. Tasks emit pieces of at most UNITS units keyed by row and position in the output;
``repartitionAndSortWithinPartitions`` brings each row's pieces together in that order, and a task streams them into
the digest of the output without joining them. The same stream is taken apart again by form and sentinels alone; its
sections are keyed by their place in the text and sorted once more within the partition (no second shuffle, as the
partitioner is the same) and stream into the digest of the restored text. A first pass measures the texts, so that a
sort has about SORT_BYTES however well they compress; the sorts spill to disk beyond Spark's Python memory limit, and
a task otherwise holds one piece at a time.

A row's key is the hash of its id and text with the number of its input partition, so that repeated rows, were they a
third of all, spread like their input; pieces that arrive several times count copies. The key does not depend on the
order of rows: tasks that run again after a lost executor emit the same keys.

Defined results: a null or empty text is ``plain`` with n = 0 and the digest of no bytes. A text that holds one of
the sentinels is ``plain``. A null id draws from the hash of the empty id. Repeated rows each have their row. Extra
columns are ignored; an empty table gives an empty result. Only a text's own row needs memory in proportion to the
text (once, where it is cut).
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of

UNITS = 4096
SORT_BYTES = 16 << 20  # text in one task's sort
#: The sentinels, and the percentages of the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SPM = 90, 20
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text start, and its end."""
    data = np.frombuffer(raw, np.uint8)
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(start), len(data))


def draws(doc_id) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def cut(doc_id, raw: bytes):
    """Unit offsets, form and the two cuts (in units) of a text."""
    units = unit_starts(raw)
    n = len(units) - 1
    h1, h2, h3, h4 = draws(doc_id)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not raw or any(s in raw for s in _PLACE) or h3 % 100 >= TRANSFORMED:
        return units, "plain", lo, hi
    return units, "spm" if h4 % 100 < SPM else "psm", lo, hi


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _pieces(part: int, rows):
    """((row key, output position), piece); position 0 holds what is known of the row."""
    for doc_id, text in rows:
        raw = b"" if text is None else bytes(text)
        units, form, lo, hi = cut(doc_id, raw)
        n = len(units) - 1
        key = hashlib.sha256(b"%s:" % str(doc_id).encode() + raw).digest()[:16] + part.to_bytes(4, "big")
        spans = {PREFIX: (0, lo), MIDDLE: (lo, hi), SUFFIX: (hi, n)}
        chars = (None, None)
        if form != "plain":
            chars = tuple(_chars(raw[units[a]:units[b]]) for a, b in (spans[PREFIX], spans[MIDDLE]))
        yield (key, 0), (doc_id, n, form, *chars)
        at = 0
        for tag, (a, b) in [(s, spans[s]) for s in ORDER[form]] or [(b"", (0, n))]:
            for u in range(a, max(b, a + 1), UNITS):
                at += 1
                yield (key, at), (tag if u == a else b"") + raw[units[u]:units[min(u + UNITS, b)]]


def sections(form: str, chunks):
    """(section, bytes) of an output that arrives in chunks, by its sentinels; these may lie across chunks."""
    order, at, left = ORDER[form], -1, b""
    for chunk in chunks:
        left += chunk
        while at + 1 < len(order) and (end := left.find(order[at + 1])) >= 0:
            if end:
                yield order[at], left[:end]
            left, at = left[end + len(order[at + 1]):], at + 1
        ready = len(left) - (2 if at + 1 < len(order) else 0)
        if ready > 0:
            yield order[at] if order else PREFIX, left[:ready]
            left = left[ready:]
    if left:
        yield order[at] if order else PREFIX, left


def _first_of_each(pieces, counts: list):
    """Pieces of one row without repeats (equal rows of one input partition); counts[0] becomes their number."""
    last = None
    for (_, at), piece in pieces:
        counts[0] += at == 0
        if at != last:
            yield piece
        last = at


def _assembled(texts: bool):
    """Pieces in output order -> what is known of each row with its output digest, and its sections keyed by their
    place in the text."""
    def run(pieces):
        for key, own in groupby(pieces, lambda p: p[0][0]):
            copies = [0]
            stream = _first_of_each(own, copies)
            head, digest, output = next(stream), hashlib.sha256(), []

            def hashed():
                for piece in stream:
                    digest.update(piece)
                    if texts:
                        output.append(piece)
                    yield piece

            for i, (section, data) in enumerate(sections(head[2], hashed())):
                yield (key, _PLACE[section], i), data
            yield (key, -1, 0), (copies[0], head, digest.hexdigest(), b"".join(output) if texts else None)
    return run


def _restored(texts: bool):
    """Sections in text order -> result rows."""
    def run(pieces):
        for _, own in groupby(pieces, lambda p: p[0][0]):
            copies, head, output_sha, output = next(own)[1]
            digest = hashlib.sha256()
            for _, data in own:
                digest.update(data)
            row = (*head, output_sha, digest.hexdigest())
            for _ in range(copies):
                yield (*row, output.decode()) if texts else row
    return run


def _by_row(key) -> int:
    return zlib.crc32(key[0])


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``texts``, the output."""
    spark = df.sparkSession
    docs = columns_of(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SORT_BYTES)
    rows = docs.rdd
    out = (rows.mapPartitionsWithIndex(_pieces)
           .repartitionAndSortWithinPartitions(parts, _by_row).mapPartitions(_assembled(texts), True)
           .repartitionAndSortWithinPartitions(parts, _by_row).mapPartitions(_restored(texts), True))
    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
              "restored_sha256 string" + (", output string" if texts else ""))
    return spark.createDataFrame(out, schema, verifySchema=False)
