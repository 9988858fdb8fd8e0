"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` random directions.  Two vectors at the
cosine limit differ on each by a normal amount of known spread, so they fall into each
other's window of half-width ``WIDTH`` spreads with a known chance; the number of such
collisions that a pair must reach is set from it so that ``MISS`` of the pairs at the
limit, and fewer of closer ones, are lost.

The first ``ORDERS`` projections are sorted orders: a pair is looked at in the first of
them whose window holds it, and only there, so it is counted once.  An order is cut
into cells as wide as the window; a vector meets its own cell and the next one.  Cells
are dealt in blocks of at most ``BLOCK`` vectors, and each pair of blocks is a task of
its own, so a label or a cell of any size is spread, in bounded memory.  Pairs that
pass the count are verified by cosine in double precision.  Blocks return numbers of
links and spanning edges, never pairs: dense groups cost no rows.

Equal vectors of a label are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .components import components
from .shipping import ship, worker

PROJECTIONS, ORDERS, WIDTH, MISS, BLOCK = 16, 4, 2.0, 1e-5, 1024
UNITS = "vec_id long, label int, bytes binary, unit binary, cells array<long>, dims int"


def collisions_needed(chance: float, n: int, miss: float) -> int:
    """The largest count that a pair with this chance per projection misses at most so often."""
    term, below = (1 - chance) ** n, 0.0
    for k in range(n + 1):
        below += term
        if below > miss:
            return k
        term *= (n - k) / (k + 1) * chance / (1 - chance)
    return n


def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(31).normal(size=(PROJECTIONS, dims))


def _half_width(cosine: float) -> float:
    """Window half-width: so many standard deviations of a projection at the limit."""
    return WIDTH * sqrt(max(2 - 2 * cosine, 1e-12))


def _prepare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _half_width(cosine)
        for batch in batches:
            ids, labels, rows = batch.column(0), batch.column(1), batch.column(2)
            lengths = rows.value_lengths().fill_null(0).to_numpy()
            values = rows.flatten()
            bad = values.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0.0).to_numpy().astype(np.float64)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            raw, unit, cells, dims = [], [], [], []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                v = values[i:j]
                size = np.abs(v).max() if j > i and not bad[i:j].any() and np.isfinite(v).all() else 0.0
                if size == 0.0:
                    raw.append(None), unit.append(None), cells.append(None), dims.append(None)
                    continue
                u = v / size
                u /= np.sqrt(u @ u)
                raw.append((v + 0.0).tobytes())  # one zero
                unit.append(u.tobytes())
                cells.append(np.floor(_directions(j - i)[:ORDERS] @ u / width).astype(np.int64))
                dims.append(j - i)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, labels, pa.array(raw, pa.binary()), pa.array(unit, pa.binary()),
                    pa.array(cells, pa.list_(pa.int64())), pa.array(dims, pa.int32()),
                ],
                names=["vec_id", "label", "bytes", "unit", "cells", "dims"],
            )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of a block."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            yield x, y


def _compare(cosine: float, need: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order, dims = int(key[0]), int(key[1])
        width = _half_width(cosine)
        unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
        p = unit @ _directions(dims).T
        # Sorted on this order's projection, a window is a run of rows.
        by = np.argsort(p[:, order], kind="stable")
        unit, p = unit[by], p[by]
        ids, copies = rows["vec_id"].to_numpy()[by], rows["copies"].to_numpy()[by]
        side = rows["side"].to_numpy()[by]
        last = np.searchsorted(p[:, order], p[:, order] + width, "right")
        links, held = np.zeros(len(rows), np.int64), []
        for i in range(0, len(rows), 128):
            j = min(i + 128, len(rows))
            end = int(last[j - 1])
            q, c = np.arange(i, j)[:, None], np.arange(i, end)[None]
            ok = (c > q) & (c < last[i:j, None])
            # Side 0 is compared with itself, or with side 1 where the block has one.
            if side.max() > 0:
                ok &= side[i:j, None] != side[None, i:end]
            for k in range(order):  # an earlier order has this pair
                ok &= np.abs(p[i:j, None, k] - p[None, i:end, k]) > width
            at, to = np.nonzero(ok)
            at, to = at + i, to + i
            count = np.zeros(len(at), np.int64)
            for k in range(PROJECTIONS):
                count += np.abs(p[at, k] - p[to, k]) <= width
            at, to = at[count >= need], to[count >= need]
            for s in range(0, len(at), 200_000):
                x, y = at[s : s + 200_000], to[s : s + 200_000]
                near = np.einsum("nd,nd->n", unit[x], unit[y]) >= cosine
                x, y = x[near], y[near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                held += _forest(x, y, len(rows))
        some = np.flatnonzero(links)
        a, b = (np.array([e[k] for e in held], np.int64) for k in (0, 1)) if held else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame(
            {
                "a": np.concatenate((ids[some], ids[a])),
                "b": np.concatenate((np.full(len(some), -1), ids[b])),
                "links": np.concatenate((links[some], np.zeros(len(a), np.int64))),
                "edge": np.concatenate((np.zeros(len(some), bool), np.ones(len(a), bool))),
            }
        )

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Vectors with equal, non-null labels and the same number of dimensions are linked at
    a cosine of at least ``cosine``, in double precision.  Null, empty and zero vectors,
    those with a null or non-finite component, null labels and null ids link with
    nothing.  Copies and vectors of one direction are linked; a repeated ``vec_id`` is
    one vertex whose rows all count.  Other columns are ignored.  Runs Spark jobs.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    units = materialize(rows.mapInArrow(worker(_prepare(cosine)), UNITS), "units")
    live = units.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    same = ["label", "bytes"]
    kinds = live.groupBy(*same).agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"),
        F.first("unit").alias("unit"), F.first("cells").alias("cells"), F.first("dims").alias("dims"),
    )
    kinds = materialize(kinds, "kinds")
    need = collisions_needed(erf(WIDTH / sqrt(2)), PROJECTIONS, MISS)

    placed = kinds.select("label", "dims", "vec_id", "copies", "unit", F.posexplode("cells").alias("order", "cell"))
    sizes = placed.groupBy("label", "dims", "order", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sizes = materialize(sizes, "cells")
    where = ["label", "dims", "order", "cell"]
    next_sizes = sizes.withColumn("cell", F.col("cell") - 1).withColumnRenamed("blocks", "next_blocks")
    before = sizes.withColumn("cell", F.col("cell") + 1).withColumnRenamed("blocks", "prev_blocks")
    placed = placed.join(sizes, where).join(next_sizes, where, "left").join(before, where, "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    # Own cell: block pairs (i <= j); next cell: own blocks on side 0, its blocks on side 1.
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    at = F.col("block")
    own = F.transform(
        spread(F.col("blocks")),
        lambda j: F.struct(
            F.col("cell").alias("home"), F.lit(0).alias("kind"), F.least(at, j).alias("i"), F.greatest(at, j).alias("j"),
            F.when(at > j, 1).otherwise(0).alias("side"),
        ),
    )
    ahead = F.transform(
        spread(F.col("next_blocks")),
        lambda j: F.struct(F.col("cell").alias("home"), F.lit(1).alias("kind"), at.alias("i"), j.alias("j"), F.lit(0).alias("side")),
    )
    behind = F.transform(
        spread(F.col("prev_blocks")),
        lambda i: F.struct((F.col("cell") - 1).alias("home"), F.lit(1).alias("kind"), i.alias("i"), at.alias("j"), F.lit(1).alias("side")),
    )
    none = F.array().cast(
        "array<struct<home:bigint,kind:int,i:bigint,j:bigint,side:int>>"
    )
    meets = F.concat(own, F.coalesce(ahead, none), F.coalesce(behind, none))
    dealt = placed.select("label", "dims", "order", "vec_id", "copies", "unit", F.explode(meets).alias("m")).select(
        "label", "dims", "order", "vec_id", "copies", "unit", "m.*"
    )
    found = dealt.groupBy("order", "dims", "label", "home", "kind", "i", "j").applyInPandas(
        _compare(cosine, need), "a long, b long, links long, edge boolean"
    )
    found = materialize(found, "links")
    links = found.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = components(found.where("edge").select("a", "b")).withColumnRenamed("id", "rep")
    of_kind = kinds.select(*same, F.col("vec_id").alias("rep"), "copies").join(links, "rep", "left").join(comps, "rep", "left")
    of_kind = of_kind.select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = live.select("vec_id", *same).join(of_kind, same).select("vec_id", "n_links", "component_id")
    alone = units.where("unit IS NULL OR label IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
