"""Token ids as Parquet list columns, in document order.

``write_tokens`` range-partitions documents by ``doc_id``, encodes each partition in
order and writes it with Spark's Parquet writer: ids as a list column (dictionary
pages, or delta-packed ones where a dictionary would not pay), row groups and pages
of fixed size, and the column and offset indexes that let a reader skip pages.  Each
row also has its partition and the number of ids before it there, so the global start
of a document needs one number per partition, kept in a manifest table; readers of
counts and starts never touch the id pages.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext
from .shipping import ship, worker
from .units import Memo, spread

PARQUET = {
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "compression": "zstd",
}
TOKENS = "doc_id long, n_tokens long, part int, before long, ids array<int>"
_loaded: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library, asked once for each distinct unit of text.

    Runs of plain letters go to the library's BPE in lower case, which is what its
    normalizer and pre-tokenizer would hand on; any other unit is encoded as it stands.
    """

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(source)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo = Memo(self.encode)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [u.isalpha() and (u.isascii() or all(c < "\x80" or "\xc0" <= c <= "\xff" for c in u)) for u in units]
        counts, done = np.zeros(len(units), np.int64), []
        for model, pick in ((self.letters, True), (self.whole, False)):
            of = np.array([i for i, p in enumerate(plain) if p is pick], np.int64)
            for k in range(0, len(of), 20_000):
                part = of[k : k + 20_000]
                texts = [units[i].lower() if pick else units[i] for i in part.tolist()]
                if pick:  # one call, the units as its words
                    one = model.encode_batch([texts], is_pretokenized=True, add_special_tokens=False)[0]
                    ids, counts[part] = one.ids, np.bincount(one.word_ids, minlength=len(part))
                else:
                    many = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
                    ids, counts[part] = list(chain.from_iterable(many)), list(map(len, many))
                done.append((part, ids))
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for part, ids in done:
            out[spread(starts[part], counts[part])] = ids
        return out, counts


def _encode(source, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha1(source.value.encode()).hexdigest()
        if key not in _loaded:
            _loaded[key] = Encoder(source.value)
        memo, part, before = _loaded[key].memo, TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, bounds in vectext.text_blocks(batch.column(1)):
                ids, at = memo.texts(data, bounds)
                ids = np.insert(ids, at[1:], end).astype(np.int32)
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array(np.diff(at)),
                        "part": pa.array(np.full(j - i, part, np.int32)), "before": pa.array(before + at[:-1]),
                        "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                    }
                )
                before += int(at[-1])

    return run


def write_tokens(documents: DataFrame, path: str, vocabulary_path: str, end_id: int = 1) -> None:
    """Write the ids of every text, ``end_id`` after each, in ascending ``doc_id`` order.

    A null text counts as empty and is its end id alone.  A null ``doc_id`` comes
    first; rows that share a ``doc_id`` are ordered by text.  Other columns are
    ignored.  The texts are shuffled once; ``path`` gets ``tokens`` and ``manifest``.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(worker(_encode(source, end_id)), TOKENS).write.options(**PARQUET).parquet(f"{path}/tokens")
    parts = _tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    parts.select("part", first).coalesce(1).write.parquet(f"{path}/manifest")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of a few.

    ``start`` counts the ids of all documents before.  Selected documents are found by
    the row-group and page indexes of the sorted ``doc_id``; leave ``ids`` out of the
    selection to read counts and starts alone.
    """
    tokens = _tokens(spark, path)
    if doc_ids is not None:
        tokens = tokens.where(F.col("doc_id").isin(list(doc_ids)))
    first = spark.read.schema("part int, first long").parquet(f"{path}/manifest")
    start = (F.col("first") + F.col("before")).alias("start")
    return tokens.join(first, "part").select("doc_id", start, "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        values = lists.flatten().to_numpy().astype("<u4")
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the ids read back."""
    rows = tokens.select("doc_id", "start", "ids")
    return rows.mapInArrow(worker(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
