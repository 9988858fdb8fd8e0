"""WARC archives with identical-payload revisits and a two-level capture index.

Writing.  Each page becomes one record; Spark's text writer lays records one after
another, each record's last line feed being the writer's separator, so a file is a
plain WARC file.  Pages are not shuffled: only digests are, to find the first page of
each payload.  Reading goes by content length, so payloads may hold anything.

Index.  Captures are sorted by their reversed-host URL key over range partitions and
compressed in blocks of ``BLOCK`` lines; a directory keeps the first and last key of
each block.  A search sends each key to the index parts that may hold it, bisects the
directory of the part, then the lines of the block, and reads the byte ranges found, in
tasks that open the archive and seek.  A task holds one part's directory, one block or
one record at a time, however many keys or captures there are.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .shipping import ship, worker

RECORDS_PER_FILE, BLOCK = 2048, 3000
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, offset long, length long, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, key string, payload binary"
)
_CRLF = b"\r\n"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(text)
    parts = []
    for k in range(8):  # five hex digits are four base32 digits
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _uuid(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _first_pages(pages: DataFrame) -> DataFrame:
    """(page_id, sha, n, first): pages and payloads that a smaller page_id has as well."""
    seen = materialize(pages.where("page_id IS NOT NULL").select("page_id", "sha", "n"), "digests")
    groups = seen.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups.where("copies > 1").drop("copies"), "payloads")
    return materialize(seen.join(groups, ["sha", "n"]).where("page_id > first").select("page_id", "sha", "n", "first").distinct(), "revisits")


def _target() -> Column:
    """The URI a page is written under."""
    url = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    # Characters that would end or break a header line; rare, so tested once.
    clean = url
    for c in (*range(0x21), 0x7F):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(url)


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write one record per page to ``path``/archives.

    The payload is ``html`` in UTF-8, empty if null.  Of equal payloads the smallest
    ``page_id`` is a response and the others revisit it, empty ones too.  A null
    ``page_id`` is a response without a page header; rows that repeat a ``page_id`` are
    written each, as revisits only where a smaller id has the same payload.  A null ``url`` becomes ``urn:page:<id>``; blanks and control
    characters of a URL are percent-encoded.  Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "n": F.octet_length("html")})
    rows = rows.join(_first_pages(rows), ["page_id", "sha", "n"], "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    revisit, named = F.col("first").isNotNull(), F.col("page_id").isNotNull()
    url = _target()
    size = F.octet_length("html")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n")
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.coalesce(F.col("page_id").cast("string"), F.sha1("html")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        some(named, line("WARC-Page-ID", F.col("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))),
        some(revisit, line("WARC-Profile", F.lit(_PROFILE))),
        some(revisit, line("WARC-Refers-To", _uuid(F.col("first")))),
        some(revisit, line("WARC-Refers-To-Page-ID", F.col("first").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"), http, body, F.lit("\r\n\r"),
    )
    out = rows.select(record.alias("value")).write.option("lineSep", "\n")
    out.option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/archives")


def surt(url: str) -> str:
    """Reversed-host sort key of a URL."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower().rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    names = host.split(".")
    if not names[-1].isdigit():
        names = names[::-1]
    key = ",".join(names) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def parse(record: bytes, file: str, at: int, payloads: bool) -> tuple:
    """One record, which starts at byte ``at`` of a file; a payload's digest is checked."""
    if record[:10] != b"WARC/1.1\r\n":
        raise ValueError(f"{file}: no record at byte {at}")
    head = record.index(b"\r\n\r\n")
    fields = dict(x.partition(": ")[::2] for x in record[10:head].decode().split("\r\n"))
    start = head + 4
    end = start + int(fields["Content-Length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError(f"{file}: record at byte {at} does not end at byte {at + end}")
    http = record.index(b"\r\n\r\n", start, end)
    http_fields = dict(x.split(": ", 1) for x in record[start:http].decode().split("\r\n")[1:])
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    body = memoryview(record)[http + 4 : end]
    if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"{file}: the payload of the record at byte {at} has another digest")
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (
        file, at, len(record), int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], digest,
        int(http_fields["Content-Length"]), int(refers) if refers else None, surt(fields["WARC-Target-URI"]),
        bytes(body) if payloads and response else None,
    )


def records_of(stream: io.BufferedIOBase, file: str, payloads: bool) -> Iterator[tuple]:
    """Records of one archive, one after another by content length."""
    at = 0
    while line := stream.readline():
        head, size = [line], None
        while line != _CRLF:
            line = stream.readline()
            if not line:
                raise ValueError(f"{file}: the header at byte {at} does not end")
            head.append(line)
            if line.startswith(b"Content-Length: "):
                size = int(line[16:])
        if size is None:
            raise ValueError(f"{file}: no length in the header at byte {at}")
        record = b"".join(head) + stream.read(size + 4)
        yield parse(record, file, at, payloads)
        at += len(record)


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme by which tasks open it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", whole))


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
# Rows and payload bytes of one batch to Spark.
_ROWS, _BYTES = 500, 16 << 20


def _arrow(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, and of a few megabytes of payload."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _whole(folder: str, payloads: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = files.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                with system.open_input_stream(f"{root}/{name}") as raw:
                    yield from records_of(io.BufferedReader(raw, 1 << 20), name, payloads)

    return lambda batches: _arrow(rows(batches), RECORD)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records under ``path``/archives; response payloads on request.

    Files are dealt to tasks by their length and read as streams, a record at a time.
    """
    ship(spark)
    listing = spark.read.format("binaryFile").load(f"{path}/archives").select("path", "length")
    return listing.mapInArrow(worker(_whole(_uri(spark, f"{path}/archives"), payloads)), RECORD)


BLOCKS = "part int, block int, first_key string, last_key string, n int, lines binary"


def _blocks(size: int):
    def block(number: int, lines: list) -> tuple:
        data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
        return TaskContext.get().partitionId(), number, lines[0][0], lines[-1][0], len(lines), data

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, held = 0, []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
            while len(held) >= size:
                yield block(number, held[:size])
                held, number = held[size:], number + 1
        if held:
            yield block(number, held)

    return lambda batches: _arrow(rows(batches), BLOCKS)


def write_index(records: DataFrame, path: str, block: int = BLOCK) -> None:
    """Sort captures by key into compressed blocks of ``block`` lines, and keep their directory."""
    rows = materialize(records.select("key", "file", "offset", "length"), "captures")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Captures of one URL may be many: the place in the archives spreads them.
    ordered = rows.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    ordered.mapInArrow(worker(_blocks(block)), BLOCKS).write.parquet(f"{path}/index")
    directory = rows.sparkSession.read.schema(BLOCKS).parquet(f"{path}/index").drop("lines")
    directory.write.parquet(f"{path}/directory")


CAPTURE = "key string, file string, offset long, length long"
WANTED = "part int, block int, key string"


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct keys (key) under which pages are written."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return named.select(_target().alias("url")).distinct().mapInArrow(worker(run), "key string").distinct()


def _parts_of(tops: list[tuple]):
    """(part, key) for each part whose range holds a wanted key; ``tops`` are sorted."""
    firsts, lasts = [t[1] for t in tops], [t[2] for t in tops]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    yield tops[k][0], key

    return lambda batches: _arrow(rows(batches), "part int, key string")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bisect a part's directory, whose rows come before the part's wanted keys."""

    def rows() -> Iterator[tuple]:
        part, numbers, firsts, lasts = None, [], [], []
        for batch in batches:
            for p, block, first, last, key in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if p != part:
                    part, numbers, firsts, lasts = p, [], [], []
                if block is not None:
                    numbers.append(block)
                    firsts.append(first)
                    lasts.append(last)
                else:
                    for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                        yield part, numbers[k], key

    return _arrow(rows(), WANTED)


def _captures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bisect the lines of a block, which comes before the keys wanted in it."""

    def rows() -> Iterator[tuple]:
        lines: list[list] = []
        for batch in batches:
            for data, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is not None:
                    lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                    continue
                k = bisect_left(lines, [key])
                while k < len(lines) and lines[k][0] == key:
                    yield tuple(lines[k])
                    k += 1

    return _arrow(rows(), CAPTURE)


def search(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Captures (key, file, offset, length) of all wanted keys (key), which are distinct.

    The driver sees one row per part of the index, of which there are as many as shuffle
    partitions.  Keys that the index does not hold find nothing.
    """
    ship(spark)
    directory = spark.read.schema(BLOCKS).parquet(f"{path}/directory").select("part", "block", "first_key", "last_key")
    tops = directory.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    tops = sorted((tuple(r) for r in tops.collect()), key=lambda t: (t[1], t[2]))
    wanted = keys.where("key IS NOT NULL").select("key").mapInArrow(worker(_parts_of(tops)), "part int, key string")
    both = directory.unionByName(wanted, allowMissingColumns=True)
    both = both.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_last(), "key")
    found = both.mapInArrow(worker(_blocks_of), WANTED)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/index").select("part", "block", "lines")
    both = blocks.unionByName(found, allowMissingColumns=True).repartition("part", "block")
    both = both.sortWithinPartitions("part", "block", F.col("key").asc_nulls_first()).select("lines", "key")
    return both.mapInArrow(worker(_captures_of), CAPTURE)


def _ranges(folder: str, payloads: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = files.FileSystem.from_uri(folder)
        name, raw = None, None
        try:
            for batch in batches:
                for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if file != name:
                        if raw is not None:
                            raw.close()
                        name, raw = file, system.open_input_file(f"{root}/{file}")
                    yield parse(raw.read_at(length, offset), file, offset, payloads)
        finally:
            if raw is not None:
                raw.close()

    return lambda batches: _arrow(rows(batches), RECORD)


def read_ranges(spark: SparkSession, path: str, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of captures, each read by its byte range alone, in order of their place."""
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = materialize(captures.select("file", "offset", "length"), "places")
    places = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(worker(_ranges(_uri(spark, f"{path}/archives"), payloads)), RECORD)


def lookup(spark: SparkSession, path: str, urls: Sequence[str]) -> list[tuple]:
    """Captures of a few URLs: (key, file, offset, length)."""
    keys = spark.createDataFrame([(k,) for k in sorted({surt(u) for u in urls})], "key string")
    return sorted(tuple(r) for r in search(spark, path, keys).collect())


def read_captures(spark: SparkSession, path: str, captures: Sequence[tuple]) -> list[tuple]:
    """Records of a few captures, with their payloads."""
    places = spark.createDataFrame([tuple(c) for c in captures], CAPTURE)
    return [tuple(r) for r in read_ranges(spark, path, places, True).collect()]


def indexed_records(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """The records of all pages, found by their keys in the index and read by range."""
    return read_ranges(spark, path, search(spark, path, keys_of(pages)))
