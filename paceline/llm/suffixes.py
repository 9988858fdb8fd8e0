"""Exact substring deduplication by a difference cover and blockwise suffix sorting.

A suffix is removed-from where its first ``length`` bytes also start earlier: in a
smaller document, or earlier in its own.  Only equality up to ``length`` bytes matters,
so suffixes are ordered by a 64-bit name of their first ``length`` bytes.

Cover.  ``COVER`` is a perfect difference set modulo ``PERIOD``: for any two positions
there is a shift below ``PERIOD`` that brings both onto sampled positions.  Two equal
strings of ``length`` bytes therefore share a sampled string of ``length - PERIOD + 1``
bytes.  The samples (8 in 57) are ranked first, once: those that occur in one place
only are told apart from those that occur again.  A suffix none of whose samples
recurs cannot tie, and is never sorted.

Blocks.  The suffixes that may tie are sorted one block of the name space at a time, so
no more than a block's share of them is ever shuffled or stored.  A chunk of documents
sends each of its distinct names once, and gets back one bit for each: whether an
earlier chunk has it.  What is equal inside a chunk is settled there, so a text with any
number of copies costs a name per chunk.

Names travel as sorted arrays in few rows.  Texts are cut once into chunks of documents
in ``doc_id`` order, written compressed, and meet the results by chunk number.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..plans.tables import materialize
from . import vectext
from .shipping import ship, worker
from .units import spread

# A perfect difference set.
COVER, PERIOD = (0, 1, 3, 13, 32, 36, 43, 52), 57
CHUNK = 1_000_000
BLOCKS = 4
NAMES_PER_BUCKET = 2_000_000
CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, body binary, carried binary"
NAMES = "chunk long, bucket int, names binary"
BITS = "chunk long, bucket int, bits binary"
STRETCHES = "chunk long, docs array<int>, starts array<long>, windows array<long>, body binary"
SPANS = "chunk long, docs array<int>, starts array<long>, ends array<long>"
_SAMPLED = np.isin(np.arange(PERIOD), COVER)


def _pack(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def _unpack(body) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        flat, limits = vectext.flatten(batch.column(1))
        for i, j in vectext.blocks(limits, CHUNK):
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([number]),
                    "doc_ids": pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([np.diff(limits[i : j + 1])], pa.list_(pa.int64())),
                    "body": pa.array([_pack(flat[limits[i] : limits[j]])], pa.binary()),
                    "carried": pa.array([_pack_columns(batch.slice(i, j - i))], pa.binary()),
                }
            )
            number += 1


def _pack_columns(batch: pa.RecordBatch) -> bytes | None:
    if batch.num_columns < 3:
        return None
    rest = batch.select(range(2, batch.num_columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_batch(rest)
    return sink.getvalue().to_pybytes()


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array(row["sizes"].as_py(), np.int64)
    return _unpack(row["body"]), np.concatenate(([0], np.cumsum(sizes)))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _samples(data: np.ndarray, bounds: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions that some window holds, and the short names at them (bucket, 32 bits)."""
    size = np.diff(bounds)
    reach = length - PERIOD + 1
    wide = np.flatnonzero(size >= length)
    room = size[wide] - reach + 1  # places of a document where a sample fits
    at = spread(np.zeros(len(wide), np.int64), room)
    keep = _SAMPLED[at % PERIOD]
    at = at[keep] + np.repeat(bounds[wide], room)[keep]
    h = vectext.window_hash(data, at, reach)
    return at, (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _rank_samples(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, keys = _samples(*_open(row), length, buckets)
                keys = vectext.distinct(keys)
                edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                full = np.flatnonzero(np.diff(edges))
                low = keys.astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([row["chunk"].as_py()] * len(full), pa.int64()),
                        "bucket": pa.array(full, pa.int32()),
                        "names": pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                    }
                )

    return run


def _recurring(rows: pa.Table) -> pa.Table:
    """For each chunk's names in a bucket, a bit: another chunk has it too."""
    names, sizes = _names(rows, np.uint32)
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    packed = names.astype(np.uint64) << np.uint64(32)
    packed |= owner
    packed.sort()
    value = packed >> np.uint64(32)
    again = np.zeros(len(value), bool)
    same = value[1:] == value[:-1]
    again[1:] |= same
    again[:-1] |= same
    del value
    packed &= np.uint64(0xFFFFFFFF)
    # Names of a chunk are sorted, and stay so among themselves.
    back = np.argsort(packed, kind="stable")
    return _answers(rows, again[back], sizes)


def _names(rows: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All names of a bucket, chunk after chunk, and each chunk's number of them."""
    data, bounds = vectext.flatten(rows.column("names").combine_chunks())
    return np.frombuffer(data.tobytes(), kind), np.diff(bounds) // np.dtype(kind).itemsize


def _answers(rows: pa.Table, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    bits = pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": bits})


def _earlier(rows: pa.Table) -> pa.Table:
    """For each chunk's names in a bucket, a bit: an earlier chunk has it."""
    rows = rows.sort_by("chunk")
    value, sizes = _names(rows, np.uint64)
    order = np.argsort(value, kind="stable")  # chunks ascend among equals
    flags = np.zeros(len(value), bool)
    flags[order[1:]] = value[order[1:]] == value[order[:-1]]
    return _answers(rows, flags, sizes)


def _stretches(length: int, buckets: int):
    """Cut out the runs of windows that hold a recurring sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, bounds = _open(row)
                at, keys = _samples(data, bounds, length, buckets)
                kinds, where, many = np.unique(keys, return_inverse=True, return_counts=True)
                again = many > 1
                edges = np.searchsorted(kinds, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                for answer in row["answers"].as_py() or ():
                    i, j = edges[answer["bucket"]], edges[answer["bucket"] + 1]
                    again[i:j] |= np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=j - i).astype(bool)
                marks = np.zeros(len(data) + 1, np.int32)
                marks[at[again[where]] + 1] = 1
                marks = np.cumsum(marks)
                size = np.diff(bounds)
                room = np.repeat(bounds[1:], size) - np.arange(len(data)) >= length
                may = np.zeros(len(data) + 2, bool)
                n = len(data)
                may[1:-1] = room & (marks[np.minimum(np.arange(n) + PERIOD, n)] > marks[:n])
                # A run of windows ends with its document.
                edge = np.flatnonzero(may[1:] != may[:-1])
                first, last = edge[::2], edge[1::2]
                doc = np.searchsorted(bounds, first, "right") - 1
                out = data[spread(first, last - first + length - 1)] if len(first) else data[:0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([row["chunk"].as_py()]), "docs": pa.array([doc], pa.list_(pa.int32())),
                        "starts": pa.array([first - bounds[doc]], pa.list_(pa.int64())),
                        "windows": pa.array([last - first], pa.list_(pa.int64())), "body": pa.array([_pack(out)], pa.binary()),
                    }
                )

    return run


def _suffixes(row: dict, length: int) -> np.ndarray:
    """Names of all windows of a chunk's stretches, in order."""
    data, windows = _unpack(row["body"]), np.array(row["windows"].as_py(), np.int64)
    ends = np.cumsum(windows + length - 1)
    at = spread(ends - (windows + length - 1), windows)
    return vectext.window_hash(data, at, length)


def _block(names: np.ndarray, block: int, blocks: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows are of a block; their distinct names by bucket; the bucket edges."""
    mine = np.flatnonzero(names % np.uint64(blocks) == block)
    kinds = vectext.distinct(names[mine])
    bucket = _bucket(kinds, blocks, buckets)
    order = np.argsort(bucket, kind="stable")
    return mine, kinds[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _bucket(names: np.ndarray, blocks: int, buckets: int) -> np.ndarray:
    return (names // np.uint64(blocks) % np.uint64(buckets)).astype(np.int64)


def _sort_block(length: int, block: int, blocks: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, kinds, edges = _block(_suffixes(row, length), block, blocks, buckets)
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([row["chunk"].as_py()] * len(full), pa.int64()),
                        "bucket": pa.array(full, pa.int32()),
                        "names": pa.array([kinds[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                    }
                )

    return run


def _spans(length: int, blocks: int, buckets: int):
    """Removed runs of bytes of each document of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                names = _suffixes(row, length)
                again = np.ones(len(names), bool)
                again[np.unique(names, return_index=True)[1]] = False  # first in the chunk
                answers = row["answers"].as_py() or ()
                for block in range(blocks):
                    mine, kinds, edges = _block(names, block, blocks, buckets)
                    seen = np.zeros(len(kinds), bool)
                    for answer in (x for x in answers if x["block"] == block):
                        i, j = edges[answer["bucket"]], edges[answer["bucket"] + 1]
                        seen[i:j] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=j - i).astype(bool)
                    known = np.sort(kinds[seen])
                    if len(known):
                        at = np.minimum(np.searchsorted(known, names[mine]), len(known) - 1)
                        again[mine] |= known[at] == names[mine]
                windows = np.array(row["windows"].as_py(), np.int64)
                docs, starts = (np.array(row[k].as_py(), np.int64) for k in ("docs", "starts"))
                doc = np.repeat(docs, windows)[again]
                first = spread(starts, windows)[again]
                # Join windows of a document that touch or overlap.
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + length)
                begin = np.flatnonzero(fresh)
                end = first[np.append(begin[1:], len(doc)) - 1] + length if len(doc) else first
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([row["chunk"].as_py()]), "docs": pa.array([doc[begin]], pa.list_(pa.int32())),
                        "starts": pa.array([first[begin]], pa.list_(pa.int64())), "ends": pa.array([end], pa.list_(pa.int64())),
                    }
                )

    return run


def _result(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data, bounds = _open(row)
                n = len(bounds) - 1
                docs, starts, ends = (np.array(row[k].as_py() or [], np.int64) for k in ("docs", "starts", "ends"))
                keep = np.ones(len(data), bool)
                keep[spread(bounds[docs] + starts, ends - starts)] = False
                spans = np.bincount(docs, minlength=n)
                removed = np.bincount(docs, ends - starts, n).astype(np.int64)
                kept, limits = data[keep].tobytes(), bounds - np.concatenate(([0], np.cumsum(removed)))
                view = memoryview(kept)
                cuts = list(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True))
                columns = {
                    "doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()), "n_bytes": pa.array(np.diff(bounds)),
                    "n_removed": pa.array(removed), "n_spans": pa.array(spans.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in cuts], pa.string()),
                }
                if row["carried"].as_py() is not None:
                    rest = pa.ipc.open_stream(row["carried"].as_buffer()).read_all()
                    columns |= {k: rest.column(k).combine_chunks() for k in rest.schema.names}
                if with_text:
                    columns["kept"] = pa.array([kept[a:b].decode(errors="ignore") for a, b in cuts], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _let_go(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps before the next one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(
    documents: DataFrame, length: int = 100, with_text: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, carried columns][, kept]`` per document.

    Every byte covered by a string of ``length`` bytes that also starts earlier is
    removed; texts are UTF-8 bytes, strings never cross documents, and are judged on the
    input.  ``n_spans`` counts maximal removed runs.  ``kept`` is the rest as text; a
    character of which only a part is left is dropped from it (``kept_sha256`` has all
    remaining bytes).  A null text is empty, texts of fewer than ``length`` bytes lose
    nothing.  A null ``doc_id`` comes before all others; rows that share a ``doc_id`` are
    ordered by text.  Columns named in ``carry`` stay with their rows, others are
    ignored.  Runs Spark jobs when called.
    """
    if length < PERIOD + 7:
        raise ValueError(f"length must be at least {PERIOD + 7}")
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    chunks = materialize(ordered.mapInArrow(worker(_chunks), CHUNKS), "chunks")
    del ordered
    _let_go(spark)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(n, int(total * len(COVER) / PERIOD / NAMES_PER_BUCKET) + 1)
    ranked = chunks.mapInArrow(worker(_rank_samples(length, buckets)), NAMES).groupBy("bucket").applyInArrow(_recurring, BITS)
    ranked = ranked.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    ranked = materialize(ranked, "cover")
    _let_go(spark)
    met = chunks.drop("carried").join(ranked, "chunk", "left").select("chunk", "sizes", "body", "answers")
    stretches = materialize(met.mapInArrow(worker(_stretches(length, buckets)), STRETCHES), "stretches")
    del met
    _let_go(spark)
    found = None
    for block in range(BLOCKS):
        sent = stretches.mapInArrow(worker(_sort_block(length, block, BLOCKS, buckets)), NAMES)
        bits = sent.groupBy("bucket").applyInArrow(_earlier, BITS).withColumn("block", F.lit(block))
        bits = materialize(bits, "block")
        found = bits if found is None else found.union(bits)
        del sent
        _let_go(spark)
    answers = found.groupBy("chunk").agg(F.collect_list(F.struct("block", "bucket", "bits")).alias("answers"))
    spans = materialize(stretches.join(answers, "chunk", "left").mapInArrow(worker(_spans(length, BLOCKS, buckets)), SPANS), "spans")
    out = chunks.join(spans, "chunk", "left")
    schema = _parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    for name in carry:
        schema = schema.add(docs.schema[name])
    schema = schema.add("kept", "string") if with_text else schema
    return out.mapInArrow(worker(_result(with_text)), schema)
