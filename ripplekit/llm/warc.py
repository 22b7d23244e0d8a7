"""WARC archives: a writer with digest-based revisit records and a sequential reader.

Writer: every row is one record in a gzip member of its own; a task writes one archive after the other into the
shared folder, starting a new one after ``ROLL_BYTES``. An archive gets a name of its own attempt and is listed
only by the rows that the task returns, so a repeated or lost attempt leaves nothing that is read. Rows whose
payload digest (SHA-1) and size equal those of another row become ``revisit`` records of the row with the smallest
id; payloads below ``min_bytes`` are always ``response``.

Reader: one task reads an archive sequentially in ``CHUNK`` pieces; each gzip member is decompressed incrementally,
a record's block is framed by its Content-Length, and block and payload digests are verified. Memory holds one
record. Wrong framing or a wrong digest raises ``WarcError``.

Defined results: null payload counts as empty; null ids write no page id and read back as null, and they only
stand as referred record when no id is there (then all copies are responses). Rows that repeat the smallest id
are responses all of them. Any bytes may stand in the payload; url may be null. Extra columns are ignored; an
empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, stored, work_dir

CHUNK = 1 << 18
ROLL_BYTES = 256 << 20
SALTS = 16
# fixed values: WARC 1.1 header names
VERSION = b"WARC/1.1"
PAGE_URN = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "url string, payload binary")


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind),
            ("WARC-Record-ID", f"<{PAGE_URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", "".join((url or "about:blank").split())),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)),
            ("WARC-Block-Digest", "sha1:" + digest(block)),
            ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def _members(stream):
    """The decompressed pieces of each gzip member, as one iterator a member."""
    pending = [b""]

    def member():
        z = zlib.decompressobj(31)
        while not z.eof:
            if not pending[0]:
                pending[0] = stream.read(CHUNK)
                if not pending[0]:
                    raise WarcError("the archive ends inside a gzip member")
            out = z.decompress(pending[0], CHUNK)
            pending[0] = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out

    while True:
        if not pending[0]:
            pending[0] = stream.read(CHUNK)
            if not pending[0]:
                return
        yield member()


class _Framed:
    """Reads lines and byte counts from the pieces of one member."""

    def __init__(self, pieces):
        self.pieces, self.buf = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buf += piece
        return True

    def line(self) -> bytes:
        while (at := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                raise WarcError("a record's header does not end")
        out = bytes(self.buf[:at])
        del self.buf[:at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.buf)


def _headers(framed: _Framed) -> dict[str, str]:
    out = {}
    while line := framed.line():
        k, sep, v = line.partition(b":")
        if not sep:
            raise WarcError(f"no header line: {line[:60]!r}")
        out[k.decode().strip().lower()] = v.decode().strip()
    return out


def _page(urn: str | None):
    value = (urn or "").strip("<>")
    return int(value[len(PAGE_URN):]) if value.startswith(PAGE_URN) else None


def read_records(stream):
    """Verified records of an archive, in order: dicts with the READ_SCHEMA's keys."""
    for pieces in _members(stream):
        framed = _Framed(pieces)
        if framed.line() != VERSION:
            raise WarcError("a member does not begin with a WARC version line")
        head = _headers(framed)
        block = framed.take(int(head["content-length"]))
        if framed.rest() != b"\r\n\r\n":
            raise WarcError("a record does not end with two line ends")
        if head["warc-block-digest"] != "sha1:" + digest(block):
            raise WarcError(f"block digest of {head['warc-record-id']}")
        inner = _Framed(iter([block]))
        inner.line()
        http = _headers(inner)
        payload, size = inner.rest(), int(http["content-length"])
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != size or head["warc-payload-digest"] != "sha1:" + digest(payload)):
            raise WarcError(f"payload digest of {head['warc-record-id']}")
        url = head["warc-target-uri"]
        yield {"page_id": _page(head["warc-record-id"]), "payload_bytes": size,
               "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind,
               "refers_to": _page(head.get("warc-refers-to")), "url": None if url == "about:blank" else url,
               "payload": payload if kind == "response" else None}


def _store(folder: str):
    """File system and path of a folder's URI (plain paths are local or shared mounts)."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _writer(folder: str, roll: int):
    def write(batches):
        fs, base = _store(folder)
        out, path, count = None, None, 0
        for b in batches:
            for page, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out, count = fs.open_output_stream(path, compression=None), 0
                payload = (html or "").encode()
                kind = "response" if first is None or first == page else "revisit"
                out.write(record(kind, page, url, payload, first))
                count += 1
                if out.tell() >= roll:
                    size = out.tell()
                    out.close()
                    out = None
                    yield _listed(path, count, size)
        if out is not None:
            size = out.tell()
            out.close()
            yield _listed(path, count, size)
    return write


def _listed(path, count, size):
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                                      names=["path", "records", "bytes"])


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row below ``folder``; returns the list of archives (path, records, bytes).

    The list is stored, so the archives are written once. The join on the digest is salted, as one payload may
    be a third of all rows; only digests of two or more rows take part in it.
    """
    pages = columns_of(df, page_id=id_col, url=url_col, html=payload_col)
    pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    key = pages.withColumn("size", size).withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    firsts = (key.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where(f"n > 1 and first is not null and size >= {int(min_bytes)}")
              .select("sha", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = key.withColumn("salt", salt).join(firsts, ["sha", "size", "salt"], "left")
    listed = rows.select("page_id", "url", "html", "first").mapInArrow(
        _writer(folder, roll_bytes), "path string, records long, bytes long")
    return stored(listed, "warc-list")


def _reader(folder: str):
    def read(batches):
        fs, _ = _store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        held += len(r["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The verified records (READ_SCHEMA) of the listed archives."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts, "path").mapInArrow(_reader(folder), READ_SCHEMA)


def archive_round_trip(spark: SparkSession, df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``df`` as archives in the shared folder and read them back."""
    folder = work_dir(spark, "warc")
    return read_archives(write_archives(df, folder, min_bytes=min_bytes), folder)
