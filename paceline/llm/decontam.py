"""Benchmark passages inside documents, by a prefix-filtered set join.

Every run of ``window`` words of a benchmark item (a shorter item whole) is a set of
three-word shingles in known places.  Shingles are ordered by their number of
occurrences in the corpus, and since a window must be contained whole, the rarest
one alone is a sufficient prefix: a document that holds the window holds that
shingle.  A match of the prefix shingle fixes where the window would begin (the
positional bound) and where it would end, which must be inside the document (the
length bound); the surviving places are verified word by word.

Windows are worked on in blocks of a fixed number, so what a task keeps of the
benchmark has a size bound however large the benchmark is; each block is a pass over
the documents, and the blocks' hits are united per row, by a number given to the rows once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..plans.tables import materialize
from . import vectext
from .shipping import ship, worker

SHINGLE = 3
BLOCK_WINDOWS = 200_000  # about 30 MB in a task
_SIEVE = 22  # bits
WINDOWS = "item_id long, size int, words binary, shingles binary"


def _windows(window: int):
    """Distinct word-hash windows of each item, with their shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in vectext.text_blocks(batch.column(1)):
                h, per_doc = vectext.word_hashes(data, bounds, vectext.ALNUM_FOLDED)
                ids = batch.column(0).slice(first, last - first).to_pylist()
                out = set()
                for item, i, j in zip(ids, per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True):
                    n = min(window, j - i)
                    for p in range(i, j - n + 1) if n else ():
                        w = h[p : p + n]
                        out.add((item, n, w.tobytes(), vectext.gram_hashes(w, min(SHINGLE, n)).tobytes()))
                item, n, w, s = zip(*sorted(out, key=repr), strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(w, pa.binary()), pa.array(s, pa.binary())],
                    names=["item_id", "size", "words", "shingles"],
                )

    return run


class _Sieve:
    """Membership of 64-bit values in a sorted array, most misses by one bit table."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = np.zeros(1 << _SIEVE, bool)
        self.bits[(values >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are members, and where they are in the array."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[where] == h[at]
        return at[ok], where[ok]


def _count(source):
    """Occurrences of the benchmark's shingles in the documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {k: _Sieve(v) for k, v in source.value.items()}
        total = {k: np.zeros(len(s.values), np.int64) for k, s in by_size.items()}
        for batch in batches:
            for _, _, data, bounds in vectext.text_blocks(batch.column(1)):
                h, per_doc = vectext.word_hashes(data, bounds, vectext.ALNUM_FOLDED)
                for k, sieve in by_size.items():
                    _, where = sieve(vectext.gram_hashes(h, k))
                    total[k] += np.bincount(where, minlength=len(sieve.values))
        for k, sieve in by_size.items():
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(sieve.values[some].view(np.int64)), pa.array(total[k][some])],
                names=["k", "shingle", "n"],
            )

    return run


def _match(source, carry: tuple):
    """Word counts, hit spans and items of each document, for one block of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(n, k, at, words, owner, _Sieve(key), first) for n, k, at, key, first, words, owner in source.value]
        for batch in batches:
            for first, last, data, bounds in vectext.text_blocks(batch.column(1)):
                h, per_doc = vectext.word_hashes(data, bounds, vectext.ALNUM_FOLDED)
                start_of = np.repeat(per_doc[:-1], np.diff(per_doc))
                end_of = np.repeat(per_doc[1:], np.diff(per_doc))
                grams: dict[int, np.ndarray] = {}
                spans = [[] for _ in range(last - first)]
                items = [set() for _ in range(last - first)]
                for n, k, offset, words, owner, sieve, run_of in groups:
                    if k not in grams:
                        grams[k] = vectext.gram_hashes(h, k)
                    pos, where = sieve(grams[k])
                    # Windows that share a prefix shingle stand in one run.
                    many = run_of[where + 1] - run_of[where]
                    pos = np.repeat(pos, many)
                    inside = np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
                    w = np.repeat(run_of[where], many) + inside
                    start = pos - offset[w]
                    ok = (start >= start_of[pos]) & (start + n <= end_of[pos])
                    start, w, pos = start[ok], w[ok], pos[ok]
                    for c in range(n):
                        ok = h[start + c] == words[w, c]
                        start, w, pos = start[ok], w[ok], pos[ok]
                    doc = np.searchsorted(per_doc, pos, "right") - 1
                    for d, s, i in zip(doc.tolist(), start.tolist(), w.tolist(), strict=True):
                        spans[d].append((s - int(per_doc[d]), n))
                        items[d].update(owner[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(np.diff(per_doc), pa.int64()),
                        pa.array([np.array(sorted(set(x)), "<i8").tobytes() for x in spans], pa.binary()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                        *(batch.column(c).slice(first, last - first) for c in carry),
                    ],
                    names=["doc_id", "n_words", "spans", "items", *carry],
                )

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words and item digests from united spans and items."""
    for batch in batches:
        hit, count, sha, runs, found = [], [], [], [], []
        for n, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            covered = np.zeros(n + 1, np.int64)
            for part in spans or ():
                for s, k in np.frombuffer(part, "<i8").reshape(-1, 2).tolist():
                    covered[s] += 1
                    covered[s + k] -= 1
            inside = np.concatenate(([False], np.cumsum(covered) > 0))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            names = sorted({str(i) for part in items or () for i in part})
            hit.append(int(inside.sum()))
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            runs.append([{"first_word": a, "end_word": b} for a, b in edges.reshape(-1, 2).tolist()])
            found.append(sorted(map(int, names)))
        words = batch.column(1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), words, pa.array(hit, pa.int64()), pa.array(count, pa.int64()),
                pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64())),
                pa.array(runs, pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))),
                *batch.columns[4:],
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans", *batch.schema.names[4:]],
        )


FOUND = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "items array<long>, spans array<struct<first_word:long,end_word:long>>"
)


def _prefixes(windows: list, counts: dict) -> list:
    """Group windows by size; each group sorted by its windows' rarest shingle."""
    by_size: dict[int, dict] = {}
    for item, n, words, shingles in windows:
        by_size.setdefault(n, {}).setdefault((words, shingles), []).append(item)
    out = []
    for n, group in by_size.items():
        k, rows = min(SHINGLE, n), []
        for (words, shingles), owner in group.items():
            s = np.frombuffer(shingles, np.uint64)
            rare = min(range(len(s)), key=lambda i: (counts.get((k, int(s[i])), 0), int(s[i]), i))
            rows.append((int(s[rare]), rare, np.frombuffer(words, np.uint64), sorted(set(owner))))
        rows.sort(key=lambda r: r[0])
        keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        out.append(
            (n, k, np.array([r[1] for r in rows]), keys, np.append(first, len(rows)), np.stack([r[2] for r in rows]), [r[3] for r in rows])
        )
    return out


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, carry: Sequence[str] = ()
) -> DataFrame:
    """Words of each document inside benchmark windows, and which items they are of.

    ``doc_id, n_words, n_hit, n_items, items_sha256, items, spans, contaminated`` per
    document: contaminated if any word is hit and ``one_in * n_hit >= n_words``.  Words
    are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased.
    Null and wordless texts have no words and no hits; null, empty and wordless items
    have no windows; items with a null id are left out.  Repeated items count once,
    rows that share a ``doc_id`` are each judged, one row per input row.  Columns named in
    ``carry``, the text too, stay with their rows; others are ignored.  Several blocks of
    windows write the texts once, numbered.  Runs Spark jobs when called.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text")
    )
    schema = _parse_datatype_string("doc_id long, n_words long, spans binary, items array<long>")
    kept = tuple(carry)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL")
    made = materialize(items.mapInArrow(worker(_windows(window)), WINDOWS).distinct(), "windows")
    n_windows = made.count()
    passes = max(1, -(-n_windows // BLOCK_WINDOWS))
    found = None
    if passes > 1:
        kept = ("row",)
        docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    for name in kept:
        schema = schema.add(docs.schema[name])
    for k in range(passes):
        mine = made if passes == 1 else made.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == k)
        rows = [tuple(r) for r in mine.collect()]  # at most about BLOCK_WINDOWS rows
        kinds: dict[int, set] = {}
        for _, n, _, shingles in rows:
            kinds.setdefault(min(SHINGLE, n), set()).update(np.frombuffer(shingles, np.uint64).tolist())
        sieves = {s: np.array(sorted(v), np.uint64) for s, v in kinds.items()}
        per_task = docs.mapInArrow(worker(_count(spark.sparkContext.broadcast(sieves))), "k int, shingle long, n long")
        counts = per_task.groupBy("k", "shingle").agg(F.sum("n").alias("n")).collect() if rows else []
        order = {(r["k"], r["shingle"] & 0xFFFFFFFFFFFFFFFF): r["n"] for r in counts}
        source = spark.sparkContext.broadcast(_prefixes(rows, order))
        one = docs.mapInArrow(worker(_match(source, kept)), schema)
        found = one if found is None else found.union(one)
    if passes == 1:
        found = found.select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"), *carry)
    else:
        found = found.groupBy("doc_id", "n_words", "row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        if carry:
            found = found.join(docs.select("row", *carry), "row")
        found = found.select("doc_id", "n_words", "spans", "items", *carry)
    schema = _parse_datatype_string(FOUND)
    for name in carry:
        schema = schema.add(docs.schema[name])
    out = found.mapInArrow(worker(_finish), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
