"""Order-dependent work without one-task-per-key windows.

``row_number() OVER (PARTITION BY race ORDER BY time)`` puts a whole race into
one task.  Here the rows are range-sorted over keys *and* order columns, so a
key holding a third of the table spreads over many chunks.  The sorted rows are
written once with their chunk number, after which

* a per-chunk summary (at most chunks + keys rows) gives what earlier chunks of
  the same key contribute, and
* each row needs only its position inside its own chunk.

The order columns must be total within a key, else equal rows swap freely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

CHUNK, POS = "_chunk", "_pos"
# monotonically_increasing_id keeps the partition above bit 33.
_POS_BITS = 33


def sorted_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-sort by keys and order; add chunk number and position in the chunk."""
    row_id = F.monotonically_increasing_id()
    ordered = df.orderBy(*[F.col(k).asc() for k in keys], *order).withColumn("_id", row_id)
    tagged = ordered.withColumns(
        {
            CHUNK: F.shiftright("_id", _POS_BITS),
            POS: F.col("_id").bitwiseAND(F.lit((1 << _POS_BITS) - 1)),
        }
    ).drop("_id")
    return materialize(tagged, "sorted")


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Add ``name`` = 1..n within ``keys`` by ``order`` (bigint)."""
    rows = sorted_chunks(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(POS).alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*keys, CHUNK, (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    )
    joined = null_safe_join(rows, materialize(starts, "starts"), [*keys, CHUNK])
    return joined.withColumn(name, F.col(POS) + F.col("_shift")).drop(CHUNK, POS, "_shift")

def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add ``name`` = sum of ``value`` up to and with each row, within ``keys`` by ``order``."""
    rows = sorted_chunks(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_s"))
    sums = sums.select(*keys, CHUNK, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    local = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = null_safe_join(local, materialize(sums, "sums"), [*keys, CHUNK])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(CHUNK, POS, "_before")


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match; the key columns appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in on])


def fill_forward(
    rows: DataFrame, keys: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Last non-null value up to each row, over rows from ``sorted_chunks``.

    ``values`` maps new column names to the expressions to carry.  Rows keep
    their chunk columns, so fills may follow one another without a new sort.
    """
    rows = rows.withColumns(values)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(POS))).alias(c) for c in values]
    )
    carried = last.select(
        *keys, CHUNK, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in values]
    )
    local = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in values})
    joined = null_safe_join(local, materialize(carried, "carried"), [*keys, CHUNK], "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop(
        *[f"_{c}" for c in values]
    )


def previous(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name`` = ``value`` in the row before, within non-null ``keys``; rows from ``sorted_chunks``.

    Only a chunk's first key can go on from an earlier chunk, so what is carried has
    at most chunks rows, however many keys there are.
    """
    heads = rows.where(F.col(POS) == 0).select(*keys).distinct()
    last = rows.join(heads, [*keys], "left_semi").groupBy(*keys, CHUNK).agg(F.max_by(value, POS).alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = last.select(*keys, CHUNK, F.lag("_v").over(earlier).alias("_carried"))
    local = rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys, CHUNK).orderBy(POS)))
    first = F.lag(F.lit(1)).over(Window.partitionBy(*keys, CHUNK).orderBy(POS)).isNull()
    joined = local.withColumn("_head", first).join(materialize(carried, "carried"), [*keys, CHUNK], "left")
    joined = joined.withColumn(name, F.when(F.col("_head"), F.col("_carried")).otherwise(F.col(name)))
    return joined.drop("_head", "_carried", CHUNK, POS)


def middle_rows(n: Column) -> tuple[Column, Column]:
    """The one or two positions (from 1) whose mean is the median of ``n`` rows."""
    return F.floor((n + 1) / 2).cast("bigint"), F.floor((n + 2) / 2).cast("bigint")
