"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) for every end of ``edges`` (``a``, ``b``: bigint).

    The component is the smallest id reachable.  Each round hooks every node's
    larger neighbours onto its smallest one (large star), then its smaller ones
    (small star), until only stars are left: a logarithmic number of rounds.
    Smallest neighbours are partial aggregates, so a hub of any degree spreads
    over the tasks.  No edge reaches the driver.
    """
    clean = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    stars = materialize(clean.distinct(), "stars")
    before = _state(stars)
    for _ in range(ROUNDS):
        if before[0] == 0:
            break
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a")
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        )
        large = materialize(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b").distinct()
        )
        stars = materialize(small, "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
