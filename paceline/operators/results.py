"""The results table: intake, roster joins, edits, deletes and reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, times
from ..plans.ordered import ordered_index
from ..plans.tables import materialize
from ..schemas import RESULT_COLUMNS
from . import clock as clock_ops
from .ranking import TIME, rank_overall, roster_order

KEY = ["race_id", "bib_number"]
# Message texts.
MSG_NO_BIB = "bibNumber is required"
MSG_NO_TIME = "Either wallClockTime or finishTime is required"
MSG_BAD_TIME = "Invalid time format. Use MM:SS.ms"
MSG_CLOCK = "Race clock is not running. Please start the race clock first."
MSG_MISSING = "Missing bibNumber or racerName"
MSG_DONE = "Successfully processed roster: "
# New roster rows queue behind every existing row.
ROSTER_SEQ_BASE = 1 << 52
# A roster of several files: each file's number takes the bits above its rows.
FILE, FILE_BITS = ["file_no"], 32


# --- roster intake ---------------------------------------------------------


def validate_roster(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with bib and name, and the others as errors."""
    ok = clean.filled(F.col("bib_number")).isNotNull() & clean.filled(
        F.col("racer_name")
    ).isNotNull()
    at = [*[c for c in FILE if c in rows.columns], "row_num"]
    errors = rows.where(~ok).select(
        "race_id", *at, "bib_number", _row_error(F.lit(MSG_MISSING))
    )
    return rows.where(ok), errors


def _row_error(text: Column) -> Column:
    return F.concat(F.lit("Row "), F.col("row_num").cast("string"), F.lit(": "), text).alias(
        "error"
    )


def dedupe_file(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row per bib, and the later ones as errors.

    With a ``file_no`` column the rows are of several files, read one after the
    other: a bib's first row is the first in the first file that lists it.  The
    first places come from a partial aggregate; rows are then matched on their own
    place, not on the bib, so a bib that fills a third of the files never gathers
    in one task.
    """
    at = ["race_id", *[c for c in FILE if c in rows.columns], "row_num"]
    place = F.min(F.struct(*at[1:])).alias("_at") if len(at) > 2 else F.min("row_num").alias("row_num")
    firsts = rows.groupBy(*KEY).agg(place)
    firsts = firsts.select("race_id", *(["_at.*"] if len(at) > 2 else ["row_num"]))
    firsts = materialize(firsts, "first_rows").withColumn("_first", F.lit(True))
    marked = materialize(rows.join(firsts, at, "left"), "marked_rows")
    text = F.concat(F.lit("Duplicate bib number "), F.col("bib_number"), F.lit(" in CSV file"))
    errors = marked.where("_first IS NULL").select(*at, "bib_number", _row_error(text))
    return marked.where("_first").select(*rows.columns), errors


def clean_roster(rows: DataFrame) -> DataFrame:
    """Trim name, team and age; normalise gender; empty optional fields are unset."""
    trimmed = {
        c: F.when(clean.filled(F.col(c)).isNotNull(), times.strip(F.col(c)))
        for c in ("racer_name", "team", "age")
    }
    return rows.withColumns({**trimmed, "gender": clean.norm_gender(F.col("gender"))})


def roster_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows to load, and every rejected row with its message."""
    valid, missing = validate_roster(rows)
    kept, repeated = dedupe_file(valid)
    return clean_roster(kept), missing.unionByName(repeated)


def collapse_bibs(results: DataFrame) -> DataFrame:
    """One row per bib: the last row's values at the first row's position."""
    cols = [c for c in results.columns if c not in (*KEY, "seq")]
    last = F.max_by(F.struct(*cols), F.col("seq")).alias("_last")
    grouped = results.groupBy(*KEY).agg(last, F.min("seq").alias("seq"))
    return grouped.select(*KEY, "_last.*", "seq").select(*results.columns)


def merge_roster(
    results: DataFrame, roster: DataFrame, keep_duplicates: bool = False
) -> DataFrame:
    """Upsert cleaned roster rows by bib; adds ``op`` (uploaded, updated, kept).

    Times, ranks and ids of existing rows stay; the name is always replaced,
    gender, team and age only by non-empty values.  ``keep_duplicates`` leaves
    finishers that share a bib apart instead of collapsing them.
    """
    base = results if keep_duplicates else collapse_bibs(results)
    new = roster.select(
        *KEY, *[F.col(c).alias(f"_{c}") for c in ("racer_name", "gender", "team", "age")],
        "row_num",
        (F.col("file_no") if "file_no" in roster.columns else F.lit(0)).cast("bigint").alias("_file"),
    )
    base = base.withColumn("_old", F.lit(True))
    if keep_duplicates:
        # A bib may hold many rows here.  A left join can split such a bib, a
        # full outer join cannot.
        added = new.join(base.select(*KEY).distinct(), KEY, "left_anti")
        both = base.join(new, KEY, "left").unionByName(added, allowMissingColumns=True)
    else:
        both = base.join(new, KEY, "full_outer")
    old, listed = F.col("_old").isNotNull(), F.col("row_num").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    op = (
        F.when(old & listed, F.lit("updated"))
        .when(listed, F.lit("uploaded"))
        .otherwise(F.lit("kept"))
    )
    return both.select(
        "race_id",
        F.when(old, F.col("id")).otherwise(F.col("bib_number")).alias("id"),
        "bib_number",
        pick("racer_name"),
        TIME,
        "rank",
        pick("gender"),
        pick("team"),
        pick("age"),
        F.coalesce("seq", F.shiftleft("_file", FILE_BITS) + ROSTER_SEQ_BASE + F.col("row_num")).alias("seq"),
        op.alias("op"),
    )


def lookup_roster(results: DataFrame, keep_finished: bool = False) -> DataFrame:
    """Roster for later lookups: bibs that have not finished yet."""
    rows = results if keep_finished else results.where(F.col(TIME).isNull())
    return rows.select(*KEY, "racer_name", "gender", "team", "age")


def merge_report(merged: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters and message text per race."""
    ops = merged.select("race_id", "op").unionByName(
        errors.select("race_id", F.lit("error").alias("op"))
    )
    count = lambda op: F.count(F.when(F.col("op") == op, 1))
    counted = ops.groupBy("race_id").agg(
        count("uploaded").alias("uploaded"),
        count("updated").alias("updated"),
        count("error").alias("errors"),
    )
    part = lambda c, text: F.when(
        F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text))
    )
    parts = F.concat_ws(
        ", ",
        part("uploaded", " new racers added"),
        part("updated", " existing racers updated"),
    )
    return counted.select(
        "race_id",
        "uploaded",
        "updated",
        (F.col("uploaded") + F.col("updated")).alias("total"),
        "errors",
        F.concat(F.lit(MSG_DONE), parts).alias("message"),
    )


def upload_roster(
    results: DataFrame,
    rows: DataFrame,
    keep_duplicates: bool = False,
    keep_finished_in_lookup: bool = False,
) -> dict[str, DataFrame]:
    """Whole roster upload: new results, lookup roster, errors and report."""
    clean_rows, errors = roster_quarantine(rows)
    merged = materialize(merge_roster(results, clean_rows, keep_duplicates), "merged")
    ordered = ordered_index(merged, ["race_id"], roster_order(), "_position")
    table = ordered.withColumn("seq", F.col("_position")).select(*RESULT_COLUMNS)
    return {
        "results": table,
        "lookup": lookup_roster(merged, keep_finished_in_lookup),
        "errors": errors,
        "report": merge_report(merged, errors),
    }


# --- finishers -------------------------------------------------------------


def enrich(events: DataFrame, roster: DataFrame) -> DataFrame:
    """Left join by bib: roster values first, then the event's own, then defaults.

    Both sides reach the join straight from a shuffle, so AQE may split a bib
    that holds many events.
    """
    known = roster.select(
        *KEY,
        *[F.col(c).alias(f"_{c}") for c in ("racer_name", "gender", "team", "age")],
        F.lit(True).alias("_hit"),
    )
    either = lambda c: F.coalesce(
        clean.filled(F.col(f"_{c}")), clean.filled(F.col(c))
    )
    own_name = F.coalesce(F.col("racer_name"), clean.bib_name(F.col("bib_number")))
    joined = events.join(known, KEY, "left")
    return joined.withColumns(
        {
            "racer_name": F.when(F.col("_hit"), F.col("_racer_name")).otherwise(own_name),
            "gender": clean.norm_gender(either("gender")),
            "team": times.strip(either("team")),
            "age": either("age"),
        }
    ).drop("_racer_name", "_gender", "_team", "_age", "_hit")


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``finish_time_ms`` and ``error``; needs the clock columns of ``apply_clock``.

    A wall-clock time wins over a finish time, and needs a running clock.
    """
    wall, text = F.col("wall_clock_s"), F.col("finish_time_str")
    official = times.official_ms(
        wall, F.col("race_start_s"), F.col("offset_ms"), F.col("status")
    )
    parsed = times.parse_mmss(text)
    ms = (
        F.when(wall.isNotNull(), official)
        .when(text.isNotNull(), parsed)
        .otherwise(F.col(TIME))
    )
    error = (
        F.when(F.col("bib_number").isNull(), F.lit(MSG_NO_BIB))
        .when(wall.isNotNull() & official.isNull(), F.lit(MSG_CLOCK))
        .when(wall.isNull() & (parsed < 0), F.lit(MSG_BAD_TIME))
        .when(wall.isNull() & text.isNull() & F.col(TIME).isNull(), F.lit(MSG_NO_TIME))
    )
    return events.withColumns({TIME: F.when(error.isNull(), ms), "error": error})


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return events.where(F.col("error").isNull()), events.where(F.col("error").isNotNull())


def append_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """Union all: a repeated bib stays a second row."""
    return results.select(*RESULT_COLUMNS).unionByName(new.select(*RESULT_COLUMNS))


def union_events(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def add_finishers(
    results: DataFrame, events: DataFrame, clock: DataFrame, roster: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Validate, time, enrich, append and rank; rejected events come back aside.

    ``events`` carry ``ts_s`` and ``seq``, their order against the clock log.
    """
    timed = materialize(validate_events(clock_ops.apply_clock(events, clock)), "timed")
    valid, rejected = split_valid(timed)
    rows = enrich(valid, roster).withColumns(
        {
            "id": clean.finisher_id(*[F.col(c) for c in ("race_id", "event_id", "seq")]),
            "rank": F.lit(None).cast("bigint"),
        }
    )
    return rank_overall(append_results(results, rows)), rejected


def quick_add(typed: DataFrame, clock_state: DataFrame, counts: DataFrame) -> DataFrame:
    """Manual entries as finisher events.

    ``typed`` has race_id, bib_number and now_s; ``clock_state`` one row per
    race, ``counts`` the finisher count per race.
    """
    # One row per race each; written, they have a known size and split hot races.
    state, total = materialize(clock_state, "state"), materialize(counts, "counts")
    joined = typed.join(state, "race_id", "left").join(total, "race_id", "left")
    ms = times.quick_add_ms(
        F.col("now_s"), F.col("race_start_s"), F.col("offset_ms"), F.col("status")
    )
    n = F.coalesce(F.col("total"), F.lit(0))
    return joined.select(
        "race_id",
        clean.quick_bib(F.coalesce("bib_number", F.lit("")), n).alias("bib_number"),
        ms.alias(TIME),
    )


# --- edits, deletes, reorder -------------------------------------------------


def _resolve_edits(results: DataFrame, edits: DataFrame, roster: DataFrame) -> DataFrame:
    """Edits with what they do: rejected or not, the new bib, and its roster row.

    Works on as many rows as there are edits.  Edits that need no roster row get
    a key of their own that matches nothing, so they do not pile up on NULL.
    """
    fields = F.col("fields")
    time_text = _value("finishTime")
    bad = time_text.isNotNull() & times.parse_edit_time(time_text).isNull()
    old = results.select("race_id", "id", F.col("bib_number").alias("_old_bib"))
    rows = edits.select("race_id", "id", "fields").join(old, ["race_id", "id"])
    rows = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    asked_bib = F.when(~F.col("_bad") & _given("bibNumber"), _value("bibNumber"))
    rows = rows.withColumn("_new_bib", F.coalesce(asked_bib, F.col("_old_bib")))
    changed = F.col("_new_bib") != F.col("_old_bib")
    rows = rows.withColumn("_changed", F.coalesce(changed, F.col("_new_bib").isNotNull()))
    own_key = F.concat(F.lit("\u0000"), F.col("id"))
    rows = rows.withColumn("_look", F.when(F.col("_changed"), F.col("_new_bib")).otherwise(own_key))
    known = roster.select(
        "race_id",
        F.col("bib_number").alias("_look"),
        *[F.col(c).alias(f"_{c}") for c in ("racer_name", "gender", "team")],
        F.lit(True).alias("_hit"),
    )
    resolved = rows.join(known, ["race_id", "_look"], "left")
    return resolved.drop("_look", "_old_bib").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def fold_edits(edits: DataFrame) -> DataFrame:
    """One edit per id: later fields, by ``edit_seq``, replace earlier ones.

    An edit with a bad time counts only where its id has no other.  Without an
    ``edit_seq`` column edits of one id follow each other by their text.
    """
    time_text = _value("finishTime")
    bad = F.coalesce(time_text.isNotNull() & times.parse_edit_time(time_text).isNull(), F.lit(False))
    seq = F.col("edit_seq") if "edit_seq" in edits.columns else F.lit(0)
    step = F.struct(seq.alias("s"), F.to_json("fields").alias("t"), F.map_entries("fields").alias("f"))
    good = F.array_sort(F.collect_list(F.when(~bad, step))).alias("_good")
    folded = edits.groupBy("race_id", "id").agg(good, F.max_by("fields", F.when(bad, step["s"])).alias("_bad"))
    entries = F.flatten(F.transform("_good", lambda g: g["f"]))
    # map_from_entries keeps one value per key: the last one, found by key.
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    merged = F.map_from_entries(F.transform(keys, last))
    return folded.select("race_id", "id", F.when(F.size("_good") > 0, merged).otherwise(F.col("_bad")).alias("fields"))


def _given(name: str) -> Column:
    return F.array_contains(F.map_keys(F.col("fields")), name)


def _value(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))


def apply_edits(results: DataFrame, edits: DataFrame, roster: DataFrame) -> DataFrame:
    """Apply edits (a map of field name to text); adds two columns.

    Several edits of one id are folded in order, see ``fold_edits``.

    ``edit_status`` is "edited" or the rejection, ``notify`` what subscribers are
    told: an update of the row, or to reload after a roster hit.

    A changed bib found in the roster takes the roster's name, gender and team,
    then the edit's non-null fields (a name only if not blank); age is dropped.
    A changed bib not in the roster is renamed after its bib.  Without a roster
    hit, fields given as NULL are written as NULL.  A bad time rejects the edit.
    """
    what = materialize(_resolve_edits(results, fold_edits(edits), roster), "edits")
    rows = results.join(what, ["race_id", "id"], "left")
    bad = F.coalesce(F.col("_bad"), F.lit(False))
    live = F.col("_bad").isNotNull() & ~bad
    hit = live & F.col("_hit")
    team_text = _value("team")
    gender = clean.norm_gender(F.coalesce(_value("gender"), F.lit("NONE")))
    asked = {
        TIME: times.parse_edit_time(_value("finishTime")),
        "rank": _value("rank").try_cast("bigint"),
        "gender": F.coalesce(gender, F.lit("")),
        "team": F.coalesce(times.strip(clean.filled(team_text)), team_text),
        "age": _value("age"),
    }
    from_roster = {
        TIME: F.col(TIME),
        "rank": F.col("rank"),
        "gender": clean.filled(F.col("_gender")),
        "team": clean.filled(F.col("_team")),
        "age": F.lit(None).cast("string"),
    }
    key_of = {TIME: "finishTime"}

    def edited(c: str) -> Column:
        said = _given(key_of.get(c, c))
        merged = F.when(said, F.coalesce(asked[c], from_roster[c])).otherwise(from_roster[c])
        plain = F.when(said, asked[c]).otherwise(F.col(c))
        return F.when(hit, merged).when(live, plain).otherwise(F.col(c)).alias(c)

    name_text = _value("racerName")
    typed_name = F.when(times.strip(name_text) != "", name_text)
    name = (
        F.when(hit, F.coalesce(typed_name, F.col("_racer_name")))
        .when(live & F.col("_changed"), clean.bib_name(F.col("_new_bib")))
        .when(live & _given("racerName"), name_text)
        .otherwise(F.col("racer_name"))
    )
    bib = F.when(live, F.col("_new_bib")).otherwise(F.col("bib_number"))
    status = F.when(bad, F.lit(MSG_BAD_TIME)).when(live, F.lit("edited"))
    notify = F.when(hit, F.lit("reload")).when(live, F.lit("update"))
    return rows.select(
        "race_id", "id", bib.alias("bib_number"), name.alias("racer_name"),
        *[edited(c) for c in asked], "seq", status.alias("edit_status"),
        notify.alias("notify"),
    )


def unknown_ids(results: DataFrame, commands: DataFrame) -> DataFrame:
    """Edits or deletes whose id is not in the table."""
    return commands.join(results.select("race_id", "id"), ["race_id", "id"], "left_anti")


def apply_deletes(results: DataFrame, ids: DataFrame) -> DataFrame:
    return results.join(ids.select("race_id", "id"), ["race_id", "id"], "left_anti")


def reorder(results: DataFrame, order: DataFrame, keep_unlisted: bool = False) -> DataFrame:
    """Client order (id, rank, pos): listed rows take its rank and position.

    Rows that are not listed are dropped unless ``keep_unlisted``, which keeps
    them behind the list.
    """
    listed = order.select("race_id", "id", F.col("rank").alias("_rank"), F.col("pos"))
    how = "left" if keep_unlisted else "inner"
    joined = results.join(listed, ["race_id", "id"], how)
    # Larger numbers are behind every position as they are.
    behind = F.when(F.col("seq") < 1 << 62, F.lit(ROSTER_SEQ_BASE) + F.col("seq")).otherwise(F.col("seq"))
    return joined.withColumns(
        {
            "rank": F.when(F.col("pos").isNotNull(), F.col("_rank")).otherwise(F.col("rank")),
            "seq": F.coalesce(F.col("pos").cast("bigint"), behind),
        }
    ).select(*results.columns)


def flag_duplicate_bibs(results: DataFrame) -> DataFrame:
    """Add ``is_duplicate``: another row has the same bib.

    Bibs seen once are found by a partial aggregate and matched back by row id,
    so a hot bib is never gathered.
    """
    single = results.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.first("id").alias("id")
    )
    single = materialize(
        single.where("_n = 1").select("race_id", "id", F.lit(False).alias("_dup")), "single"
    )
    return results.join(single, ["race_id", "id"], "left").withColumn(
        "is_duplicate", F.coalesce("_dup", F.lit(True))
    ).drop("_dup")


def require_columns(df: DataFrame, columns: set[str]) -> None:
    """Fail at once when a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"CSV must contain headers: {', '.join(missing)}")

