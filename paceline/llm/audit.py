"""How document filters overlap: posting lists of failing records, merged by galloping.

Each document is judged once.  Records sorted by id are cut into id ranges, and each
range keeps, per part of the corpus, one sorted list of record numbers for every filter:
the records that fail it.  What a filter removes after others is its list less the
union of theirs.  Unions and differences of a range are merged list by list, shorter
lists galloping through longer ones; sizes of all ranges are added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .shipping import ship, worker

FILTERS = "ABCDE"
RANGE = 1 << 16  # records of one id range
_STRIDE = 64  # needles that start from one anchor
_LISTS = [*FILTERS, "good", "toxic"]
_POSTINGS = "part string, range long, weights array<long>, " + ", ".join(f"`{c}` array<int>" for c in _LISTS)
_SIZES = "part string, before int, filter int, removed long, good_lost long, toxic_lost long, failing long, total long, gone long"


def judgements() -> list[Column]:
    """Whether ``text`` fails filters A to D; E compares documents with one another."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, good, toxic, n``: documents alike in id, part and judgement, counted.

    Bit k of ``bits`` is set where filter k fails.  Copies are found by the SHA-256 of
    their texts: the smallest id of a text passes E.  The text is read once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(judgements())), F.lit(0))
    judged = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    # Rows repeated whole are counted before anything is dealt by id or digest.
    judged = materialize(judged.groupBy("doc_id", "part", "bits", "digest").agg(F.count(F.lit(1)).alias("n")), "judged")
    firsts = judged.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = judged.join(firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    bits = F.col("bits") + F.when(copy, 1 << 4).otherwise(0)
    marked = marked.withColumn("bits", bits).groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    none = F.lit(False)
    joined = marked.join(known, "doc_id", "left")
    return joined.select("doc_id", "part", "bits", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"), "n")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, RANGE):
            block = batch.slice(at, RANGE)
            bits, weights = block.column("bits").to_numpy(), block.column("n").to_numpy()
            marks = [bits >> k & 1 for k in range(len(FILTERS))]
            marks += [block.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
            coded = block.column("part").dictionary_encode()
            part = coded.indices.to_numpy()
            rows: list[list] = [[] for _ in range(3 + len(_LISTS))]
            for p, name in enumerate(coded.dictionary.to_pylist()):
                of = np.flatnonzero(part == p)
                lists = [np.flatnonzero(m[of]).astype(np.int32) for m in marks]
                for column, value in zip(rows, [name, first, weights[of], *lists], strict=True):
                    column.append(value)
            first += block.num_rows
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * len(_LISTS)]
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "range", "weights", *_LISTS])


def posting_lists(found: DataFrame) -> DataFrame:
    """Per part and id range the sorted record numbers that fail each filter.

    Records are numbered within their part and range; ``weights`` has each record's
    documents, ``good`` and ``toxic`` list labelled records.  Sorted by all that tells
    records apart, so one id with many of them spreads over ranges.
    """
    order = ["doc_id", "part", "bits"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(worker(_post), _POSTINGS), "postings")


def gallop(haystack: np.ndarray, needles: np.ndarray) -> np.ndarray:
    """Places of sorted ``needles`` in a sorted list, as ``searchsorted`` gives them.

    Every needle starts at the anchor of its stretch, doubles its step until it has
    passed its place, and bisects the last step; all needles move together.
    """
    if not len(haystack) or not len(needles):
        return np.zeros(len(needles), np.int64)
    low = np.repeat(np.searchsorted(haystack, needles[::_STRIDE]), _STRIDE)[: len(needles)] - 1
    last, step = len(haystack) - 1, np.ones(len(needles), np.int64)
    going = np.arange(len(needles))
    while len(going):
        at = low[going] + step[going]
        under = (at <= last) & (haystack[np.minimum(at, last)] < needles[going])
        going, at = going[under], at[under]
        low[going] = at
        step[going] *= 2
    high = np.minimum(low + step, last + 1)
    while True:
        open_ = np.flatnonzero(high - low > 1)
        if not len(open_):
            return high
        middle = (low[open_] + high[open_]) >> 1
        under = haystack[middle] < needles[open_]
        low[open_[under]] = middle[under]
        high[open_[~under]] = middle[~under]


def _held(haystack: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = gallop(haystack, needles)
    if not len(haystack):
        return at, np.zeros(len(needles), bool)
    return at, haystack[np.minimum(at, len(haystack) - 1)] == needles


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists: the shorter ones gallop through the longest."""
    lists = sorted(lists, key=len, reverse=True)
    out = lists[0] if lists else np.zeros(0, np.int32)
    for shorter in lists[1:]:
        at, held = _held(out, shorter)
        out = np.insert(out, at[~held], shorter[~held])
    return out


def difference(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What ``one`` holds and ``other`` doesn't; the shorter list gallops."""
    if len(one) <= len(other):
        return one[~_held(other, one)[1]]
    keep = np.ones(len(one), bool)
    at, held = _held(one, other)
    keep[at[held]] = False
    return one[keep]


def common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What both lists hold; the shorter one gallops."""
    small, large = sorted((one, other), key=len)
    return small[_held(large, small)[1]]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, names = len(FILTERS), [f.split()[0] for f in _SIZES.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy() for c in ["weights", *_LISTS]}
            weights, lists = row["weights"], [row[c] for c in FILTERS]
            size = lambda ids: int(weights[ids].sum())  # noqa: E731, B023
            unions = [union([lists[f] for f in range(k) if mask >> f & 1]) for mask in range(1 << k)]
            part, total, out = batch.column("part")[i].as_py(), int(weights.sum()), []
            for mask in range(1 << k):
                for f in range(k):
                    if not mask >> f & 1:
                        lost = difference(lists[f], unions[mask])
                        good, toxic = (size(common(lost, row[c])) for c in ("good", "toxic"))
                        out.append((part, mask, f, size(lost), good, toxic, size(lists[f]), total, size(unions[mask])))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def sizes(postings: DataFrame) -> DataFrame:
    """``part, before, filter`` and what the filter removes after the set ``before``."""
    found = postings.mapInArrow(worker(_sizes), _SIZES)
    sums = [F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "failing", "total", "gone")]
    return found.groupBy("part", "before", "filter").agg(*sums)


def interactions(found: DataFrame) -> DataFrame:
    """Rows of all orders of the filters, from the sizes that ``sizes`` gives."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before = sum(1 << g for g in order[:step])
            steps.append(("".join(FILTERS[g] for g in order), step + 1, before, f))
    table = found.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    # Some hundred rows, whatever the corpus.
    rows = found.join(F.broadcast(table), ["before", "filter"])
    same = Window.partitionBy("part", "filter")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(same).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what each step removes.

    Null and empty texts are alike: they fail A, and E after the first id.  Null ``lang``
    is the part of the empty string.  Rows with a null ``doc_id`` have no label and take
    no part in E: they neither fail it nor make others fail.  Rows that repeat an id count
    each; copies under one id don't fail E through one another.  An id labelled more than
    once is good or toxic if any of its labels says so.  Other columns are ignored; an
    empty table has no part and gives no rows.
    """
    ship(documents.sparkSession)
    return interactions(sizes(posting_lists(records(documents, labels))))
