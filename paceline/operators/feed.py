"""Change feed as a keyed, versioned table: adds, updates, clears, deletes, reloads.

A change names its fields in a map: a field that is given replaces the old value, also
with null (a clear); a field that is not in the map stays.  A delete leaves a tombstone:
what an id had before does not come back with a later change.  A reload starts a new
generation of its race: rows of earlier generations are gone unless changes that follow
bring them again.

The batch fold and the streaming upsert (``streaming.stateful.stream_feed``) give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize

ROW = ["race_id", "id"]
# Columns of the table and their types; the names in a change are those of the wire.
FIELDS = {
    "bib_number": ("bibNumber", "string"),
    "racer_name": ("racerName", "string"),
    "finish_time_ms": ("finishTime", "double"),
    "rank": ("rank", "bigint"),
    "gender": ("gender", "string"),
    "team": ("team", "string"),
    "age": ("age", "string"),
}
COLUMNS = [*ROW, *FIELDS, "seq", "version"]


def fields_of(row: dict[str, Column], given: dict[str, Column] | None = None) -> Column:
    """The map of a change: given columns by wire name, as text."""
    given = given or {}
    kind = "struct<key:string,value:string>"
    entries = [
        F.when(given.get(c, F.lit(True)), F.struct(F.lit(FIELDS[c][0]).alias("key"), v.cast("string").alias("value")).cast(kind))
        for c, v in row.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def typed(fields: Column) -> list[Column]:
    """The table's columns from a map of wire names; a malformed number is null."""
    return [
        F.try_element_at(fields, F.lit(wire)).try_cast(kind).alias(c) if kind != "string"
        else F.try_element_at(fields, F.lit(wire)).alias(c)
        for c, (wire, kind) in FIELDS.items()
    ]


def fold_feed(log: DataFrame) -> DataFrame:
    """Table after a feed (race_id, change_seq, type, id, fields), one row per live id.

    ``seq`` is the change that brought the row into the table, ``version`` the last one
    applied.  ``change_seq`` is unique in a race.  Changes without an id, and unknown
    types, are ignored.  Deletes and reloads are found by partial aggregates and
    written, one row per deleted id and race; then each field is the last value given.
    """
    reloads = log.where("type = 'reload'").groupBy("race_id").agg(F.max("change_seq").alias("_reload"))
    deletes = log.where("type = 'delete' AND id IS NOT NULL").groupBy(*ROW).agg(F.max("change_seq").alias("_delete"))
    changes = log.where(F.col("type").isin("add", "update") & F.col("id").isNotNull())
    changes = changes.join(materialize(reloads, "reloads"), "race_id", "left").join(materialize(deletes, "deletes"), ROW, "left")
    cut = F.greatest("_reload", "_delete")
    live = changes.where(cut.isNull() | (F.col("change_seq") > cut))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    last = [
        F.max_by(F.struct(F.try_element_at(fields, F.lit(w)).alias("v")), F.when(F.map_contains_key(fields, w), F.col("change_seq"))).alias(c)
        for c, (w, _) in FIELDS.items()
    ]
    rows = live.groupBy(*ROW).agg(*last, F.min("change_seq").alias("seq"), F.max("change_seq").alias("version"))
    value = lambda c, kind: F.col(f"{c}.v") if kind == "string" else F.col(f"{c}.v").try_cast(kind)
    return rows.select(*ROW, *[value(c, kind).alias(c) for c, (_, kind) in FIELDS.items()], "seq", "version")


def live_table(upserts: DataFrame) -> DataFrame:
    """The same table from the upserts that ``stream_feed`` has sent so far.

    Each upsert is a whole row, so the newest version of an id counts; rows of older
    generations of a race, and tombstones, are left out.
    """
    newest = F.max_by(F.struct("generation", "seq", "deleted", "fields"), "version").alias("n")
    rows = upserts.where("id IS NOT NULL").groupBy(*ROW).agg(newest, F.max("version").alias("version"))
    generations = upserts.groupBy("race_id").agg(F.max("generation").alias("_now"))
    rows = rows.select(*ROW, "n.*", "version").join(materialize(generations, "generations"), "race_id")
    rows = rows.where("generation = _now AND NOT deleted")
    return rows.select(*ROW, *typed(F.col("fields")), "seq", "version")
