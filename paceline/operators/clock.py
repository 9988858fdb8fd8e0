"""Race clock: folding the event log, and times as of the clock in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..plans.ordered import CHUNK, POS, fill_forward, sorted_chunks

RACE = ["race_id"]
STATE = ["race_start_s", "status", "offset_ms"]
# Message texts.
MSG_NO_TIME = "Time is required"
MSG_BAD_TIME = "Invalid time format. Use MM:SS.ms"


def _clock_states(rows: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """State after each row of a sorted union of clock rows and other rows.

    Start, status and offset are each "the last value set so far": starts and
    resets set the start, starts, stops and resets the status, edits and resets
    the offset.  An edit's offset needs the start in force, hence two fills.  ``others``
    are more values to fill forward with them.
    """
    action, ts = F.col("action"), F.col("ts_s")
    no_start = F.lit(None).cast("double")
    start = F.when(action == "start", F.struct(ts.alias("v"))).when(
        action == "reset", F.struct(no_start.alias("v"))
    )
    status = F.when(action == "start", F.lit("running")).when(
        action.isin("stop", "reset"), F.lit("stopped")
    )
    rows = fill_forward(rows, RACE, {"_start": start, "_status": status, **(others or {})})
    started = F.col("_start.v")
    wanted = F.col("arg_ms")
    edited = F.when(started.isNull(), wanted).otherwise(wanted - (ts - started) * 1000)
    offset = F.when(action == "edit", edited).when(action == "reset", F.lit(0.0))
    rows = fill_forward(rows, RACE, {"_offset": offset})
    return rows.withColumns(
        {
            "race_start_s": started,
            "status": F.coalesce("_status", F.lit("stopped")),
            "offset_ms": F.coalesce("_offset", F.lit(0.0)),
        }
    ).drop("_start", "_status", "_offset", CHUNK, POS)


def clock_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clock rows from commands (race_id, ts_s, seq, action, arg text), and rejected ones.

    Only edits carry an argument: plain ms, or ``MM:SS.cc``.
    """
    ms = times.parse_edit_time(F.col("arg"))
    edit = F.col("action") == "edit"
    error = F.when(edit & F.col("arg").isNull(), F.lit(MSG_NO_TIME)).when(
        edit & ms.isNull(), F.lit(MSG_BAD_TIME)
    )
    rows = raw.withColumns({"arg_ms": F.when(edit, ms), "error": error})
    good = rows.where(F.col("error").isNull())
    return (
        good.select(*RACE, "ts_s", "seq", "action", "arg_ms"),
        rows.where(F.col("error").isNotNull()).drop("arg_ms"),
    )


def fold_clock(events: DataFrame) -> DataFrame:
    """Clock state after every event of the log (race_id, ts_s, seq, action, arg_ms)."""
    order = [F.col("ts_s").asc(), F.col("seq").asc()]
    return _clock_states(sorted_chunks(events, RACE, order))


def clock_status(events: DataFrame) -> DataFrame:
    """Current state: one row per race."""
    last = F.max_by(F.struct(*STATE), F.struct("ts_s", "seq")).alias("s")
    return fold_clock(events).groupBy(*RACE).agg(last).select(*RACE, "s.*")


def apply_clock(events: DataFrame, clock: DataFrame) -> DataFrame:
    """As-of join: each event gets the state in force at its ``ts_s``.

    At equal times the clock goes first; a null time comes before all others, on
    both sides.  The clock log is folded on its own, then one sort of events and
    folded states fills the last state forward: the same plan and the same rows
    for any number of commands, in any race.
    """
    state = F.struct(*STATE).alias("_state")
    log = fold_clock(clock).select(*RACE, "ts_s", "seq", state, F.lit(0).alias("_kind"))
    rows = events.withColumn("_kind", F.lit(1)).unionByName(log, allowMissingColumns=True)
    order = [F.col("ts_s").asc(), F.col("_kind").asc(), F.col("seq").asc()]
    filled = fill_forward(sorted_chunks(rows, RACE, order), RACE, {"_now": F.col("_state")})
    return filled.where(F.col("_kind") == 1).select(
        *events.columns,
        F.col("_now.race_start_s").alias("race_start_s"),
        F.coalesce("_now.status", F.lit("stopped")).alias("status"),
        F.coalesce("_now.offset_ms", F.lit(0.0)).alias("offset_ms"),
    )
