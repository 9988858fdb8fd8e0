"""Near-duplicate documents by MinHash and an LSH forest.

Method.  A document's set is its distinct word shingles; documents with equal
sets are one class from the start.  Each class has 64 minimum hashes.  The forest
is 16 sorted orders of the classes: order ``t`` sorts by the signature rotated by
``4 t`` values, so each order begins with values of its own.  Rows that share the
first three values form a region; a region of up to ``REGION`` rows is compared as
it is, a larger one descends: it is cut where neighbours share the shortest common
prefix, so dense parts are compared at greater depth.  Inside a piece, pairs whose
signatures agree enough become candidates.

Candidates are confirmed on full sets, in rounds: each class first tries its best
partner, confirmed classes are contracted, and only pairs between different
components are tried next.  The last round takes every pair that is left in regions of
up to ``REGION`` rows, so a group of copies costs about its size, and no candidate is
dropped.

What is still in different components of a cut region is not tried pair by pair, as its
pieces hold many pairs a row and do not meet.  It is compared whole afterwards: its
classes are dealt to blocks and the blocks go pairwise to tasks, which check every pair that agrees enough on full sets.  A region
that the rounds made one component costs nothing here; one that stays apart costs the
square of its classes in signature comparisons, but only links leave a task.

Nothing is broadcast by hand; a region in one order may run over several tasks
(range partitions over the full key), a hot one too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize
from . import vectext
from .components import components
from .shipping import ship, worker

VALUES, TREES, DEPTH, REGION, OVERLAP = 64, 16, 3, 64, 8
BLOCK, _UNIT = 512, 8192  # classes of a block, and the set bytes that count as one more
_STEP = VALUES // TREES
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, block by block."""
    for first, last, data, bounds in vectext.text_blocks(column):
        h, per_doc = vectext.word_hashes(data, bounds, vectext.NOT_SPACE)
        grams = vectext.gram_hashes(h, shingle)
        out = []
        for i, j in zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True):
            if j - i >= shingle:
                out.append(vectext.distinct(grams[i : j - shingle + 1]))
            else:
                out.append(vectext.gram_hashes(h[i:j], j - i) if j > i else h[:0])
        yield first, out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, values x sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    out = np.empty((VALUES, len(sets)), np.uint32)
    for k in range(VALUES):
        out[k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], starts)
    return out


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in _sets(batch.column(1), shingle):
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                a, b, sig = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [b""] * len(n)
                if len(full):
                    kept = [sets[i] for i in full]
                    rows = np.ascontiguousarray(_signatures(kept).T).astype(">u4")
                    for i, s, row in zip(full.tolist(), kept, rows, strict=True):
                        a[i], b[i] = _fold(s)
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(n)), pa.array(n, pa.int64()),
                        pa.array(a), pa.array(b),
                        pa.array(sig, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    return run


def _fold(items: np.ndarray) -> tuple[int, int]:
    """Two sums over a set; with its size they name it."""
    return int(items.sum().view(np.int64)), int(vectext.mix(items ^ np.uint64(0x5BD1E995)).sum().view(np.int64))


def _hold(shingle: int):
    """Sets of the texts that are of the class they were looked up for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True))
            for first, sets in _sets(batch.column(1), shingle):
                mine = [i for i, s in enumerate(sets) if len(s) and (len(s), *_fold(s)) == keys[first + i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([first + i for i in mine], pa.int64())),
                        pa.array([sets[i].tobytes() for i in mine], pa.binary()),
                    ],
                    names=["doc_id", "items"],
                )

    return run


def _pieces(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut rows of one order, sorted, into pieces of at most ``REGION`` rows.

    Regions share ``DEPTH`` values.  A larger region is cut at the shallowest
    common prefix within reach; pieces of one region overlap by a few rows, so
    every row meets its longest-common-prefix neighbours on both sides.
    """
    same = x[1:] == x[:-1]
    common = np.where(same.all(1), x.shape[1], same.argmin(1))
    breaks = np.flatnonzero(common < DEPTH) + 1
    edges = [0, *breaks.tolist(), len(x)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i < 2:
            continue
        start = i
        while j - start > REGION:
            reach = common[start + REGION // 2 - 1 : start + REGION - 1]
            cut = start + REGION // 2 + int(reach.argmin())
            yield start, cut
            start = max(cut - OVERLAP, start + 1)
        yield start, j


def _pairs(agree: int, spanning: bool):
    """Candidate pairs of one sorted order; rows are (tree, doc_id, comp, key)."""

    def piece(x: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int, int]]:
        same = (x[:, None, :] == x[None, :, :]).sum(2)
        same[comp[:, None] == comp[None, :]] = -1
        if not spanning:
            a, b = np.nonzero(np.triu(same >= agree, 1))
            yield from zip(a.tolist(), b.tolist(), same[a, b].tolist(), strict=True)
            return
        left = np.arange(len(x))
        best, via = np.full(len(x), -2), np.zeros(len(x), int)
        while len(left):  # Prim's forest: n - 1 edges at most
            k = left[best[left].argmax()]
            if best[k] >= agree:
                yield int(via[k]), int(k), int(best[k])
            left = left[left != k]
            better = same[k] > best
            via[better] = k
            best = np.where(better, same[k], best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            ids, comp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            data, _ = vectext.flatten(batch.column(3))
            x = data.reshape(-1, 4 * VALUES).copy().view(">u4").astype(np.uint32)
            if held is not None:  # rows of the last region meet the next batch
                tree, ids, comp, x = (np.concatenate(p) for p in zip(held, (tree, ids, comp, x), strict=True))
            held = tuple(v[-REGION:] for v in (tree, ids, comp, x))
            out = []
            for t in np.unique(tree):
                i, j = np.searchsorted(tree, [t, t + 1])
                for p, q in _pieces(x[i:j]):
                    out += [(ids[i + p + a], ids[i + p + b], n) for a, b, n in piece(x[i + p : i + q], comp[i + p : i + q])]
            a, b, n = (np.array(v, np.int64) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n)], names=["a", "b", "agree"]
            )

    return run


def _confirm(percent: int):
    """Keep pairs with 100 * intersection >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):  # length bound
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


def _block_links(agree: int, percent: int):
    """Links between the components of two blocks of a region (or inside one block).

    A pair is looked at in the first order whose region it shares; ends that a link
    found before has joined are not tried again.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        tree, ids = int(rows["tree"][0].as_py()), rows["doc_id"].to_numpy()
        left, right = (np.flatnonzero(rows[c].to_numpy()) for c in ("is_i", "is_j"))
        data, _ = vectext.flatten(rows["key"].combine_chunks())
        x = data.reshape(-1, 4 * VALUES).copy().view(">u4").astype(np.uint32)
        items, bounds = vectext.flatten(rows["items"].combine_chunks())
        _, token = np.unique(items.copy().view(np.uint64), return_inverse=True)
        bounds = bounds // 8
        size = np.diff(bounds)
        _, label = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        met = np.zeros(len(token) + 1, bool)
        earlier = [np.arange(DEPTH) + (t - tree) * _STEP for t in range(tree)]
        out = []
        for k in left.tolist():
            same = x[right] == x[k]
            ok = (same.sum(1) >= agree) & (label[right] != label[k])
            at, same = right[ok], same[ok]
            for values in earlier:
                fresh = ~same[:, values % VALUES].all(1)
                at, same = at[fresh], same[fresh]
            at = at[100 * np.minimum(size[at], size[k]) >= percent * np.maximum(size[at], size[k])]
            if not len(at):
                continue
            own = token[bounds[k] : bounds[k + 1]]
            met[own] = True
            first = np.cumsum(size[at]) - size[at]
            every = np.arange(size[at].sum()) + np.repeat(bounds[at] - first, size[at])
            both = np.add.reduceat(met[token[every]], first, dtype=np.int64)
            met[own] = False
            for j in at[100 * both >= percent * (size[at] + size[k] - both)].tolist():
                if label[j] != label[k]:
                    out.append((ids[k], ids[j]))
                    label[label == label[j]] = label[k]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _orders(classes: DataFrame) -> DataFrame:
    """(tree, doc_id, region, n, key) of the rows that share their first values with another row."""
    prefix = lambda t: F.col("sig").substr(t * _STEP * 4 + 1, F.lit(DEPTH * 4))
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    keys = classes.select(
        "doc_id", F.posexplode(F.transform(trees, lambda t: F.xxhash64(t, prefix(t)))).alias("tree", "h")
    )
    shared = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = keys.join(shared, "h").select("doc_id", "tree", F.col("h").alias("region"), "n")
    at = F.col("tree") * _STEP * 4
    key = F.concat(F.col("sig").substr(at + 1, F.lit(4 * VALUES)), F.col("sig").substr(F.lit(1), at))
    return meeting.join(classes.select("doc_id", "sig"), "doc_id").select("tree", "doc_id", "region", "n", key.alias("key"))


def _with_components(orders: DataFrame, comps: DataFrame) -> DataFrame:
    rows = orders.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return rows.withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def _candidates(orders: DataFrame, comps: DataFrame | None, agree: int) -> DataFrame:
    rows = orders.withColumn("comp", F.col("doc_id"))
    if comps is not None:
        rows = _with_components(orders, comps)
    # A region that is not cut stays in one task.
    at = F.when(F.col("n") <= REGION, F.col("key").substr(1, 4 * DEPTH)).otherwise(F.col("key"))
    rows = rows.select("tree", "doc_id", "comp", "key", at.alias("at"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "tree", "at").sortWithinPartitions("tree", "key", "doc_id").drop("at")
    pairs = rows.mapInArrow(worker(_pairs(agree, comps is None)), "a long, b long, agree long")
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for end in ("a", "b"):
        side = comps.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(side, end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def near_duplicates(
    documents: DataFrame, shingle: int = 5, percent: int = 80, agree: int = 36
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked when their sets of distinct ``shingle``-word runs have a
    Jaccard similarity of at least ``percent`` / 100; candidates need ``agree`` of
    64 equal minimum hashes (at similarity 0.8, 51 are expected; fewer than 36 have a
    chance of 4e-6, less than the sixteen orders lose).  Words are separated by ASCII white space and A-Z is
    lower-cased.  A text with fewer words is one shingle; null, empty and blank
    texts have no shingle and stay alone.  Rows with a null ``doc_id`` stay alone
    with a null component.  A repeated ``doc_id`` is one vertex with the links of all
    its texts, each row returned.  Other columns are ignored.  Runs Spark jobs when called.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(worker(_sign(shingle)), SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "set_a", "set_b"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig"))
    # From here on ``doc_id`` is the number of a class, whose smallest id is ``first``.
    classes = materialize(classes.withColumn("doc_id", F.monotonically_increasing_id()), "classes")
    orders = materialize(_orders(classes), "orders")
    found = materialize(_candidates(orders, None, agree), "candidates")
    repeats = _repeats(signed)

    def sets(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "doc_id").select("doc_id", F.col("first").alias("_first"), *key)
        rows = texts.withColumnRenamed("doc_id", "_first").join(wanted, "_first").select("doc_id", "text", *key)
        held = materialize(rows.mapInArrow(worker(_hold(shingle)), "doc_id long, items binary"), "sets")
        return held.dropDuplicates(["doc_id"]) if repeats else held

    linked = _link(found, sets(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), orders, agree, percent)
    comps = _link_regions(linked, sets, orders, agree, percent)
    if repeats:
        comps = _link_ids(comps, full, classes, key)
    of_class = classes.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    of_class = of_class.select(*key, "first", F.coalesce("component", "doc_id").alias("component"))
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(least, "component").select(*key, "component_id")
    worded = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    out = worded.join(of_class, key).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _link_ids(comps: DataFrame, full: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """``comps`` joined further: the classes of the texts that share an id are one."""
    named = full.select(F.col("doc_id").alias("of"), *key).distinct().join(classes.select("doc_id", *key), key)
    named = materialize(named.select("of", "doc_id"), "named")
    first = named.groupBy("of").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last")
    links = named.join(first.select("of", "b"), "of").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    stars = comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return materialize(components(stars.union(links)), "comps")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with new links; the old ones stand for all links before."""
    if comps is None:
        return materialize(components(links), "comps")
    if not links.limit(1).count():
        return comps
    stars = comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return materialize(components(stars.union(links)), "comps")


def _link(found: DataFrame, held: DataFrame, orders: DataFrame, agree: int, percent: int) -> DataFrame:
    """Confirm candidates round by round; components of the confirmed links."""
    a = held.select(F.col("doc_id").alias("a"), F.col("items").alias("p"))
    b = held.select(F.col("doc_id").alias("b"), F.col("items").alias("q"))

    def confirm(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "p", "q")
        return materialize(rows.mapInArrow(worker(_confirm(percent)), "a long, b long, linked boolean"), "confirmed")

    # First each class with its best partner, then its three best, then all.
    tried, comps, left = None, None, found
    for best in (1, 3, None):
        if best is not None:
            ends = left.select("*", F.explode(F.array("a", "b")).alias("of"))
            rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("agree"), "a", "b"))
            now = ends.withColumn("r", rank).where(F.col("r") <= best).select("a", "b").distinct()
        else:
            # Regions that were cut are compared whole later on, where only links leave a task.
            extra = _candidates(orders.where(F.col("n") <= REGION), comps, agree).join(tried, ["a", "b"], "left_anti")
            now = left.select("a", "b").union(extra.select("a", "b")).distinct()
        now = confirm(now)
        tried = now if tried is None else tried.union(now)
        comps = _joined(comps, now.where("linked").select("a", "b"))
        if best is not None:
            left = materialize(_between(left.join(tried, ["a", "b"], "left_anti"), comps), "left")
    return comps


def _link_regions(comps: DataFrame, sets: Callable, orders: DataFrame, agree: int, percent: int) -> DataFrame:
    """``comps`` joined further by all links inside the regions that were cut."""
    rows = _with_components(orders.where(F.col("n") > REGION), comps)
    mixed = rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rows = rows.join(mixed.where("lo < hi").select("region"), "region", "left_semi")
    rows = materialize(rows.select("region", "tree", "doc_id", "comp", "key"), "mixed")
    if not rows.limit(1).count():
        return comps
    held = sets(rows.select("doc_id").distinct())
    rows = rows.join(held, "doc_id").withColumn("weight", 1 + F.floor(F.octet_length("items") / _UNIT))
    # A large component has blocks of its own, which need not meet; the others share blocks.
    parts = rows.groupBy("region", "comp").agg(F.sum("weight").alias("weight"))
    parts = materialize(parts.withColumn("own", F.col("weight") > BLOCK // 2), "parts")
    pools = parts.where("NOT own").groupBy("region").agg(F.ceil(F.sum("weight") / BLOCK).alias("pool"))
    parts = parts.join(pools, "region", "left").select("region", "comp", "own", F.ceil(F.col("weight") / BLOCK).alias("slots"), "pool")
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.col("pool")))
    alone = F.concat(F.lit("c"), F.col("comp"), F.lit(":"), F.pmod(F.xxhash64("doc_id"), F.col("slots")))
    rows = rows.drop("weight").join(parts, ["region", "comp"]).withColumn("block", F.when(F.col("own"), alone).otherwise(shared))
    rows = materialize(rows.drop("slots", "pool"), "dealt")
    blocks = rows.select("region", "block", F.when(F.col("own"), F.col("comp")).alias("of")).distinct()
    other = blocks.select("region", F.col("block").alias("j"), F.col("of").alias("of_j"))
    pairs = blocks.withColumnRenamed("block", "i").join(other, "region").where("i <= j AND coalesce(of <> of_j, true)")
    ends = F.array_distinct(F.array("i", "j"))
    pairs = pairs.select("region", "i", "j", F.explode(ends).alias("block"))
    dealt = rows.join(pairs, ["region", "block"]).select(
        "region", "i", "j", "tree", "doc_id", "comp", "key", "items",
        (F.col("block") == F.col("i")).alias("is_i"), (F.col("block") == F.col("j")).alias("is_j"),
    )
    links = materialize(dealt.groupBy("region", "i", "j").applyInArrow(_block_links(agree, percent), "a long, b long"), "links")
    return _joined(comps, links)
