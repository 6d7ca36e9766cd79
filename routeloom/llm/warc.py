"""WARC archives written and read back, records found by boundary-chain verification.

Writing: a payload's digest decides its group. The row with the smallest id is the
response, the others are revisits that name it; groups meet as small rows (id and
digest) under a partial aggregate, and page bodies are shuffled once, by digest, in
a join that adaptive execution can split. Record text goes through Spark's own
writer with the record terminator as its line separator, so any file system works.

Reading: each task scans archive bytes for the record magic, in windows, and emits a
candidate for every hit: its offset and the offset its length field leads to. A
payload may hold the magic, or a whole forged record, so a hit proves nothing; only
offsets that the chain from the start of the file reaches are records. The chain is
resolved over the small candidate rows by pointer jumping: the jump of every
candidate doubles each step, so a file of n records takes log2(n) steps. Headers may
have any length; a file whose chain does not end at its last byte is an error.

Payload digests are taken only of records that the chain reaches, so forged heads
inside a payload cost their own bytes and no more.

Files are compressed as one stream each; offsets count its uncompressed bytes. Pages
are written by classes of size, and an archive file holds so few records that its
payloads stay within ``file_bytes``, or one record where a page alone is larger: that
bounds a task's bytes and a file's chain. Null html: an empty payload. Rows that repeat
both id and payload of a response are responses too. A null id sorts last; its page is
a response where no other page has the payload. Empty table: no records. Columns other
than id, url and html are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch, small_batches

MAGIC = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b"
END = "\r\n\r\n"
WINDOW = 1 << 20
#: Upper bounds of the size classes of payloads, in bytes; the last class has none.
CLASSES = [1 << 14, 1 << 18, 1 << 22]


def _base32(hex_digest):
    """A 40-digit hex column in upper-case base32."""
    eights = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, digest, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.encode("html", "UTF-8")
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1(payload)})
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest", "left").withColumns(
        {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))}
    )


def write_archives(
    pages: DataFrame, path: str, *, min_bytes: int = 0, max_records: int = 10_000, file_bytes: int = 160_000_000, compression: str = "gzip", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """One record per row, in files of at most ``max_records`` whose payloads fit ``file_bytes``."""
    n = F.coalesce(F.octet_length("html"), F.lit(0))
    number = sum((n > top).cast("int") for top in CLASSES)
    present = {r["c"]: r["top"] for r in pages.select(number.alias("c"), n.alias("n")).groupBy("c").agg(F.max("n").alias("top")).collect()}
    for c, top in sorted(present.items() or [(0, 0)]):
        own = min(max_records, max(1, file_bytes // max(1, top)))
        _write_class(pages.where(number == c), f"{path}/class={c}", min_bytes, own, compression, date)


def _write_class(pages: DataFrame, path: str, min_bytes: int, max_records: int, compression: str, date: str) -> None:
    # equal payloads have one size, so a class has all rows of a digest
    rows = decide(pages, min_bytes).withColumn("b32", _base32(F.col("digest")))
    uri = F.regexp_replace(F.coalesce(F.when(F.trim("url") != "", F.col("url")), F.lit("about:blank")), r"[\x00-\x20]", "%20")
    uid = lambda c: F.regexp_replace(F.md5(F.coalesce(c.cast("string"), F.lit("-"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("html")).otherwise(""))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uid(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("b32"))), line("X-Page-Id", F.col("page_id")), line("X-Payload-Length", F.col("payload_bytes")),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uid(F.col("refers_to"))), line("X-Refers-To-Page-Id", F.col("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(F.col("block"))), F.lit("\r\n"), F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max_records).option("compression", compression).text(path)


def _parse(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def _number(x: bytes | None) -> int | None:
    return int(x) if x is not None and x.lstrip(b"-").isdigit() else None


def _find(raw: memoryview, what: bytes, at: int, upto: int) -> int:
    """The first place of ``what`` in raw[at:upto], or -1."""
    step = 8192
    while at < upto:
        found = bytes(raw[at : min(at + step + len(what) - 1, upto)]).find(what)
        if found >= 0:
            return at + found
        at, step = at + step, min(2 * step, WINDOW)
    return -1


def _hits(raw: memoryview) -> Iterator[tuple[int, int, int, dict[bytes, bytes]]]:
    """(offset, block's offset, successor's offset, fields) of every hit of the magic that heads a record."""
    size = len(raw)
    stop = _find(raw, b"\r\n\r\n", 0, size)
    for start in range(0, size, WINDOW):
        window = bytes(raw[start : start + WINDOW + len(MAGIC) - 1])
        hit = window.find(MAGIC)
        while hit >= 0:
            at, hit = start + hit, window.find(MAGIC, hit + 1)
            if 0 <= stop < at:  # else the empty line found last is the first from here too
                stop = _find(raw, b"\r\n\r\n", at, size)
            # a line of the magic inside is no header field
            if stop < 0 or _find(raw, b"\r\n" + MAGIC, at, stop + 2) >= 0:
                continue
            fields = _parse(bytes(raw[at:stop]))
            length = _number(fields.get(b"content-length"))
            if length is not None and 0 <= length <= size - stop - 8:
                yield at, stop + 4, stop + 8 + length, fields


def candidates(files: DataFrame) -> DataFrame:
    """files (path, content): a row for every hit of the magic, payload or not. Those that no chain
    of this file's offsets reaches have no digest of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "at", "next", "size", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_digest"]
        kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 2, pa.int64(), pa.string()]
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_buffer()
                if data[:2].to_pybytes() == GZIP:
                    data = gzip.decompress(data)
                raw, size = memoryview(data), len(data)
                hits = list(_hits(raw))
                if size and not (hits and hits[0][0] == 0):
                    raise ValueError(f"{path}: no record at its start")
                worth = reachable(np.array([h[0] for h in hits], np.int64), np.array([h[2] for h in hits], np.int64))
                for (at, block, following, fields), hash_it in zip(hits, worth.tolist(), strict=True):
                    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
                    stored = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("utf-8", "replace")
                    length, digest = _number(fields.get(b"x-payload-length")), stored
                    if kind == "response":
                        length = digest = None
                        if hash_it:
                            payload = bytes(raw[block : following - 4]).partition(b"\r\n\r\n")[2]
                            length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    out.append((path, at, following, size, _number(fields.get(b"x-page-id")), length, digest, kind, _number(fields.get(b"x-refers-to-page-id")), stored))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "file string, at long, next long, size long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_digest string")


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches. at: sorted offsets; following: each one's successor."""
    n = len(at)
    index = np.searchsorted(at, following)
    known = (index < n) & (at[np.minimum(index, n - 1)] == following)
    jump = np.append(np.where(known, index, n), n)
    seen = np.append(at == 0, False)
    step = 1
    while step <= n:
        seen[jump[np.flatnonzero(seen)]] = True
        seen[n] = False
        jump = jump[jump]
        step *= 2
    return seen[:n]


def chained(found: DataFrame) -> DataFrame:
    """The candidates that are records."""

    def resolve(t):
        t = t.sort_by("at")
        t = t.filter(pa.array(reachable(t.column("at").to_numpy(), t.column("next").to_numpy())))
        end, size = (t.column(c)[-1].as_py() if len(t) else 0 for c in ("next", "size"))
        if not len(t) or end != size:
            raise ValueError(f"the chain of records ends at byte {end} of {size}")
        return t

    return found.groupBy("file").applyInArrow(resolve, found.schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under a path, one row each."""
    small_batches(spark, 8)  # whole files: a few to a batch
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return chained(candidates(files))


def round_trip(pages: DataFrame, *, min_bytes: int = 0, max_records: int = 10_000) -> DataFrame:
    """Archive pages in scratch storage and read them back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, min_bytes=min_bytes, max_records=max_records)
    return read_archives(spark, path).drop("file", "at", "next", "size", "stored_digest")
