"""Joins that stay balanced when one key holds much of the big side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Column,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join with ``small`` (one narrow row per key) repeated once per salt.

    ``spread`` is a whole-number column that varies within a hot key.  Besides
    splitting the key, the salt keeps a following aggregate on ``keys`` from
    reusing the join's partitioning: it then aggregates partially before its own
    shuffle, and AQE is free to split a skewed partition of the join further,
    which it declines where that would add a shuffle.
    """
    salted = big.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    return salted.join(small.select("*", copies), [*keys, "_salt"]).drop("_salt")
