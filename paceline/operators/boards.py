"""Public boards: dedupe, category and team podiums, change-log fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, times
from ..plans.ordered import ordered_index
from .ranking import TIME, nullzero_order, order_nullzero

BIB = ["race_id", "bib_number"]
TEAM = ["race_id", "team"]


def _first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; the per-task group limit keeps hot keys to one row a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_board(results: DataFrame, policy: str = "fastest") -> DataFrame:
    """One row per bib: the fastest (missing time counts as zero) or first arrival."""
    if policy == "fastest":
        return _first_per(results, BIB, nullzero_order())
    if policy == "first_arrival":
        return first_arrival(results)
    raise ValueError(f"unknown policy {policy!r}")


def first_arrival(results: DataFrame) -> DataFrame:
    return _first_per(results, BIB, [F.col("seq").asc()])


def top_n_by(
    results: DataFrame,
    part: Sequence[str] = ("gender",),
    n: int = 3,
    values: Sequence[str] | None = ("M", "W"),
    keys: Sequence[str] = ("race_id",),
) -> DataFrame:
    """First n rows per category with ``position`` and ``medal``."""
    if values is not None:
        results = results.where(F.col(part[0]).isin(*values))
    w = Window.partitionBy(*keys, *part).orderBy(*nullzero_order())
    position = F.row_number().over(w)
    top = results.withColumn("position", position).where(F.col("position") <= n)
    return top.withColumns(
        {"position": F.col("position").cast("bigint"), "medal": clean.medal(F.col("position"))}
    )


def _with_team(results: DataFrame) -> DataFrame:
    trimmed = times.strip(F.col("team"))
    return results.withColumn("team", trimmed).where(F.col("team") != "")


def team_groups(results: DataFrame) -> DataFrame:
    """Every team member with its position in the team, as rows.

    Rows instead of one list per team: a team may hold a third of the field.
    """
    return ordered_index(_with_team(results), TEAM, nullzero_order(), "team_runner")


def team_sizes(results: DataFrame) -> DataFrame:
    """Size and first finisher of each team (partial aggregate)."""
    first = F.struct(F.coalesce(TIME, F.lit(0.0)).alias("t"), F.col("seq"))
    return _with_team(results).groupBy(*TEAM).agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("size")
    )


def first_teams(results: DataFrame, n_teams: int = 6) -> DataFrame:
    """The first n teams of a race in order of their fastest finisher."""
    w = Window.partitionBy("race_id").orderBy("first", "team")
    ranked = team_sizes(results).withColumn("team_pos", F.row_number().over(w))
    return ranked.where(F.col("team_pos") <= n_teams)


def team_overflow(results: DataFrame, n_runners: int = 3) -> DataFrame:
    """How many members a team card leaves out; only teams above the limit."""
    extra = (F.col("size") - n_runners).alias("more")
    return team_sizes(results).where(F.col("size") > n_runners).select(*TEAM, "size", extra)


def team_board(results: DataFrame, n_teams: int = 6, n_runners: int = 3) -> DataFrame:
    """First teams with their first runners.

    Both windows keep at most n rows per group and task before they shuffle.
    """
    w = Window.partitionBy(*TEAM).orderBy(*nullzero_order())
    runners = _with_team(results).withColumn("runner_pos", F.row_number().over(w))
    runners = runners.where(F.col("runner_pos") <= n_runners)
    teams = first_teams(results, n_teams)
    more = F.greatest(F.col("size") - n_runners, F.lit(0).cast("bigint"))
    return runners.join(teams, TEAM).select(
        *TEAM,
        F.col("team_pos").cast("bigint").alias("team_pos"),
        F.col("runner_pos").cast("bigint").alias("runner_pos"),
        "id",
        "bib_number",
        "racer_name",
        TIME,
        clean.medal(F.col("runner_pos")).alias("medal"),
        more.alias("more"),
    )


def fold_changes(log: DataFrame) -> DataFrame:
    """Table after an add/update log: per id the last non-null value of each field.

    ``seq`` is the change that added the row.  Partial aggregates only.
    """
    fields = log.schema["data"].dataType.fieldNames()
    rows = log.where(F.col("type").isin("add", "update")).select(
        "race_id", "id", "change_seq", "data.*"
    )
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_seq"))).alias(c) for c in fields
    ]
    return rows.groupBy("race_id", "id").agg(*last, F.min("change_seq").alias("seq"))


def live_board(log: DataFrame) -> DataFrame:
    """Folded table in board order."""
    return order_nullzero(fold_changes(log))


def public_board(results: DataFrame, policy: str = "fastest") -> dict[str, DataFrame]:
    """Deduped board with its podiums, teams and count."""
    board = dedupe_board(results, policy)
    total = board.groupBy("race_id").agg(F.count(F.lit(1)).alias("total_finishers"))
    return {
        "board": board,
        "podiums": top_n_by(board),
        "teams": team_board(board),
        "total": total,
    }


def export_rows(
    results: DataFrame, start_s: Column | None = None, offset_ms: Column | None = None
) -> DataFrame:
    """Six export columns; rank is the list position, zero and missing times are blank."""
    null = F.lit(None).cast("double")
    start = null if start_s is None else start_s
    offset = null if offset_ms is None else offset_ms
    ms = F.nullif(times.normalize_epoch(F.col(TIME), start, offset), F.lit(0.0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = ordered_index(results, ["race_id"], nullzero_order(), "_position")
    return listed.select(
        "race_id",
        F.col("_position").alias("Rank"),
        F.col("bib_number").alias("Bib Number"),
        clean.runner_name(F.col("racer_name")).alias("Racer Name"),
        F.when(ms.isNull(), F.lit("")).otherwise(times.fmt_mmss_ui(ms)).alias("Finish Time"),
        text("gender").alias("Gender"),
        text("team").alias("Team"),
    )
