"""Ranks, places, sort orders and winner / mean / median statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, times
from ..plans.ordered import middle_rows, ordered_index
from ..plans.tables import materialize

RACE = ("race_id",)
TIME = "finish_time_ms"
INF = float("inf")


# Sort orders.  Each ends in ``seq``, the arrival order, so ties stay stable.
def finish_order() -> list[Column]:
    return [F.col(TIME).asc(), F.col("seq").asc()]


def nullzero_order() -> list[Column]:
    """Board order: a missing time counts as zero and leads."""
    return [F.coalesce(TIME, F.lit(0.0)).asc(), F.col("seq").asc()]


def late_zero(alternative: Column | None = None) -> Column:
    """Sort key in which a zero time falls back to ``alternative``, then to the end."""
    picks = [F.nullif(F.col(TIME), F.lit(0.0))]
    if alternative is not None:
        picks.append(F.nullif(alternative, F.lit(0.0)))
    return F.coalesce(*picks, F.lit(INF))


def place_order(alternative: Column | None = None) -> list[Column]:
    return [F.col(TIME).isNull().asc(), late_zero(alternative).asc(), F.col("seq").asc()]


def roster_order() -> list[Column]:
    """Finished first, then time (zero late), then numeric bib."""
    return [
        F.col(TIME).isNull().asc(),
        late_zero().asc(),
        clean.bib_sort_key(F.col("bib_number")).asc(),
        F.col("seq").asc(),
    ]


def order_finish(df: DataFrame) -> DataFrame:
    return df.orderBy(*finish_order())


def order_nullzero(df: DataFrame) -> DataFrame:
    return df.orderBy(*nullzero_order())


def order_roster(df: DataFrame) -> DataFrame:
    return df.orderBy(*roster_order())


def order_timing(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("seconds").desc(), F.col("stage").asc())


def head_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of an order; planned as a per-task top-n."""
    return df.orderBy(*order).limit(n)


def finished(df: DataFrame) -> DataFrame:
    return df.where(F.col(TIME).isNotNull())


def results_read(df: DataFrame) -> DataFrame:
    """Finished rows in finish order."""
    return order_finish(finished(df))


def rank_overall(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Set ``rank`` 1..n among finished rows; unfinished rows have none."""
    order = [F.col(TIME).isNull().asc(), *finish_order()]
    out = ordered_index(results.drop("rank"), keys, order, "rank")
    return out.withColumn("rank", F.when(F.col(TIME).isNotNull(), F.col("rank")))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1..n over the whole table, still sorted in parallel chunks."""
    return ordered_index(df, [], order, name)


def display_position(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = RACE
) -> DataFrame:
    return ordered_index(df, keys, order, "position")


def provisional_rank(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Rank a new finisher gets on arrival: finished rows so far, plus one."""
    # Finished rows count in arrival order, so position = finished before + 1.
    return ordered_index(finished(results), keys, [F.col("seq").asc()], "provisional_rank")


def place_csv(
    results: DataFrame, keys: Sequence[str] = RACE, alternative: Column | None = None
) -> DataFrame:
    """Add ``place`` over all rows: zero times after positive ones, missing last."""
    return ordered_index(results, keys, place_order(alternative), "place")


def finish_counts(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(TIME).alias("finished")
    )


def _heads(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything about a key that needs no order: one partial aggregate."""
    t = F.col(TIME)
    return placed.groupBy(*keys).agg(
        F.min(t).alias("winner_ms"),
        F.count(t).alias("finishers"),
        F.count(F.when(t < 0, t)).alias("_n_neg"),
        F.count(F.when(t > 0, t)).alias("_n_pos"),
        F.sum(F.when(t != 0, 1 / t)).alias("_inverse"),
    )


def stats_of_placed(placed: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Winner, mean and exact median of winner/time, one row per key.

    The mean is winner * mean(1/time).  The median needs no second sort: over
    rows with a non-zero time, winner/time is monotone in ``place``, except that
    with a negative winner the negative times move behind the positive ones.  So
    the counts give the one or two middle places, and an equi-join on (key,
    place) fetches just those rows; no race is gathered or broadcast.
    """
    heads = materialize(_heads(placed, keys), "heads")
    neg, pos = F.col("_n_neg"), F.col("_n_pos")
    n = neg + pos

    def place_of(nth: Column) -> Column:
        rotated = F.when(nth <= pos, nth + neg).otherwise(nth - pos)
        return F.when(F.col("winner_ms") < 0, rotated).otherwise(nth)

    lo, hi = middle_rows(n)
    wanted = heads.where(n > 0).select(
        *keys,
        "winner_ms",
        F.explode(F.array_distinct(F.array(place_of(lo), place_of(hi)))).alias("place"),
    )
    ratio = F.col("winner_ms") / F.col(TIME)
    middle = placed.select(*keys, TIME, "place").join(wanted, [*keys, "place"])
    medians = middle.groupBy(*keys).agg(F.avg(ratio).alias("median_winning"))
    return heads.join(medians, list(keys), "left").select(
        *keys,
        "winner_ms",
        "finishers",
        F.try_divide(F.col("winner_ms") * F.col("_inverse"), n).alias("mean_winning"),
        "median_winning",
    )


def finish_stats(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    return stats_of_placed(place_csv(results.select(*keys, TIME, "seq"), keys), keys)


def relative_stats(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Add place, difference to the winner and the four ratios to every row."""
    placed = place_csv(results, keys)
    stats = materialize(stats_of_placed(placed, keys), "stats")
    t = F.nullif(F.col(TIME), F.lit(0.0))
    joined = placed.join(stats, list(keys), "left")
    return joined.withColumns(
        {
            "diff_ms": F.col(TIME) - F.col("winner_ms"),
            "pct_winning": F.try_divide(F.col("winner_ms"), t),
        }
    ).withColumns(
        {
            "pct_back": F.try_divide(F.col("diff_ms"), t),
            "pct_average": F.col("pct_winning") - F.col("mean_winning"),
            "pct_median": F.col("pct_winning") - F.col("median_winning"),
        }
    )


def leaderboard(results: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """The 14 leaderboard columns (plus keys), as text where the file has text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = clean.split_name(F.col("racer_name"))
    return relative_stats(results, keys).select(
        *keys,
        F.col("place").alias("Place"),
        text("bib_number").alias("Bib"),
        text("racer_name").alias("Name"),
        name["first"].alias("First name"),
        name["last"].alias("Last name"),
        text("age").alias("Age"),
        text("gender").alias("Gender"),
        times.fmt_mmss(F.col(TIME)).alias("Time"),
        times.fmt_mmss(F.col("diff_ms")).alias("Difference"),
        times.fmt_pct(F.col("pct_back")).alias("% Back"),
        times.fmt_pct(F.col("pct_winning")).alias("% Winning"),
        times.fmt_pct(F.col("pct_average")).alias("% Average"),
        times.fmt_pct(F.col("pct_median")).alias("% Median"),
        text("team").alias("team"),
    )
