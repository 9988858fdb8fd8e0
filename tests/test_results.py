"""Roster, finishers, edits and reorder on the fixture rows."""

import pytest
from pyspark.sql import functions as F

from paceline import schemas
from paceline.operators import boards, ranking, report
from paceline.operators import results as res
from paceline.sources import feeds

RAW = "race_id bigint, row_num bigint, bib_number string, racer_name string, gender string, team string, age string"


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


@pytest.fixture
def raw(rows_of):
    return rows_of(
        RAW,
        (0, 2, "101", " Ann Mary Lee ", "woman", "A", None),
        (0, 3, "102", "Bo", "x", " B ", " 7 "),
        (0, 4, "101", "Other", "M", None, None),
        (0, 5, "", "NoBib", "F", None, None),
        (0, 6, "103", "", None, None, None),
        (0, 7, "104", "Cy", "", "", ""),
    )


@pytest.fixture
def results(rows_of):
    return rows_of(
        schemas.RESULT,
        (0, "a", "101", "Racer #101", 1000.0, 1, "M", "old", "30", 1),
        (0, "b", "Unknown-3", "Racer 3", 2000.0, 2, None, None, None, 2),
        (0, "c", "101", "Racer #101", 3000.0, 3, "M", None, None, 3),
        (0, "d", "9", "Nine", None, None, None, None, None, 4),
    )


def test_quarantine(raw):
    rows, errors = res.roster_quarantine(raw)
    assert by(rows, "bib_number", "racer_name", "gender", "team", "age") == {
        "101": ("Ann Mary Lee", "W", "A", None),
        "102": ("Bo", "X", "B", "7"),
        "104": ("Cy", None, None, None),
    }
    assert by(errors, "row_num", "error") == {
        4: "Row 4: Duplicate bib number 101 in CSV file",
        5: "Row 5: Missing bibNumber or racerName",
        6: "Row 6: Missing bibNumber or racerName",
    }


def test_upload(raw, results):
    out = res.upload_roster(results, raw)
    table = by(out["results"], "bib_number", "id", "racer_name", "finish_time_ms", "gender", "team", "age", "seq")
    # The two rows of bib 101 collapse into the last one's values.
    assert table == {
        "101": ("c", "Ann Mary Lee", 3000.0, "W", "A", None, 2),
        "Unknown-3": ("b", "Racer 3", 2000.0, None, None, None, 1),
        "9": ("d", "Nine", None, None, None, None, 3),
        "102": ("102", "Bo", None, "X", "B", "7", 4),
        "104": ("104", "Cy", None, None, None, None, 5),
    }
    assert {r.bib_number for r in out["lookup"].collect()} == {"9", "102", "104"}
    report_row = out["report"].first()
    assert (report_row.uploaded, report_row.updated, report_row.total, report_row.errors) == (2, 1, 3, 3)
    assert report_row.message == (
        "Successfully processed roster: 2 new racers added, 1 existing racers updated"
    )


def test_upload_twice_changes_nothing(raw, results):
    once = res.upload_roster(results, raw)["results"]
    twice = res.upload_roster(once, raw)["results"]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_upload_keeping_duplicates(raw, results):
    out = res.upload_roster(results, raw, keep_duplicates=True, keep_finished_in_lookup=True)
    ids = by(out["results"], "id", "racer_name", "team")
    assert ids["a"] == ("Ann Mary Lee", "A") and ids["c"] == ("Ann Mary Lee", "A")
    assert len(ids) == 6 and out["lookup"].count() == 6


EVENT = (
    "race_id bigint, event_id string, bib_number string, wall_clock_s double, finish_time_ms double, "
    "finish_time_str string, racer_name string, gender string, team string, age string, ts_s double, seq bigint"
)


def test_add_finishers(rows_of):
    results = rows_of(schemas.RESULT, (0, "a", "1", "One", 70000.0, 1, None, None, None, 0))
    clock = rows_of(schemas.CLOCK_EVENT, (0, 100.0, 1, "start", None), (0, 300.0, 2, "stop", None))
    roster = rows_of(schemas.ROSTER, (0, "5", "Five", "f", " T ", None))
    none = (None, None, None, None)
    events = rows_of(
        EVENT,
        (0, "e1", None, 150.0, None, None, *none, 150.0, 1),
        (0, "e2", "5", None, None, None, *none, 150.0, 2),
        (0, "e3", "5", 160.0, 5.0, None, *none, 160.0, 3),
        (0, "e4", "5", None, None, "01:23.45", *none, 161.0, 4),
        (0, "e5", "6", None, None, "1:2.5", "Typed", "man", "x", "4", 162.0, 5),
        (0, "e6", "6", None, None, "bad", *none, 163.0, 6),
        (0, "e7", "7", 310.0, None, None, *none, 310.0, 7),
        (0, "e8", "7", None, 70000.0, None, *none, 311.0, 8),
    )
    ranked, rejected = res.add_finishers(results, events, clock, roster)
    assert by(rejected, "event_id", "error") == {
        "e1": res.MSG_NO_BIB, "e2": res.MSG_NO_TIME, "e6": res.MSG_BAD_TIME, "e7": res.MSG_CLOCK,
    }
    assert by(ranked, "seq", "racer_name", "finish_time_ms", "gender", "team", "rank") == {
        0: ("One", 70000.0, None, None, 3),
        3: ("Five", 60000.0, "W", "T", 1),
        4: ("Five", 83450.0, "W", "T", 5),
        5: ("Typed", 62050.0, "M", "x", 2),
        8: ("Racer #7", 70000.0, None, None, 4),
    }


def test_edits(rows_of, results):
    roster = rows_of(schemas.ROSTER, (0, "50", "Fifty", "W", None, "8"))
    edits = rows_of(
        schemas.EDIT,
        (0, "a", {"bibNumber": "50", "team": " new ", "gender": None}),
        (0, "b", {"bibNumber": "77", "racerName": "Ignored"}),
        (0, "c", {"finishTime": "1:2.5", "team": None, "racerName": "Cee"}),
        (0, "d", {"finishTime": "nope", "racerName": "Kept out"}),
        (0, "zz", {"team": "x"}),
    )
    got = by(
        res.apply_edits(results, edits, roster), "id",
        "bib_number", "racer_name", "finish_time_ms", "rank", "gender", "team", "age", "edit_status",
    )
    assert got == {
        "a": ("50", "Fifty", 1000.0, 1, "NONE", "new", None, "edited"),
        "b": ("77", "Racer #77", 2000.0, 2, None, None, None, "edited"),
        "c": ("101", "Cee", 62050.0, 3, "M", None, None, "edited"),
        "d": ("9", "Nine", None, None, None, None, None, res.MSG_BAD_TIME),
    }
    told = res.apply_edits(results, edits, roster)
    assert by(told, "id", "notify") == {"a": "reload", "b": "update", "c": "update", "d": None}
    texts = [r.value for r in feeds.edit_messages(told).collect()]
    assert len(texts) == 3 and texts.count('{"action":"reload"}') == 1
    assert feeds.reload_messages(results).collect()[0].value == '{"action":"reload"}'
    assert [r.id for r in res.unknown_ids(results, edits).collect()] == ["zz"]


def test_edits_of_one_id_are_folded(rows_of):
    edits = rows_of(
        "race_id bigint, id string, fields map<string,string>, edit_seq bigint",
        (0, "a", {"team": "T1", "age": "4"}, 1), (0, "a", {"finishTime": "bad", "team": "T9"}, 3), (0, "a", {"team": None}, 2),
        (0, "b", {"finishTime": "bad"}, 1), (1, "a", {"age": "7"}, 1),
    )
    got = {(r.race_id, r.id): r.fields for r in res.fold_edits(edits).collect()}
    assert got == {(0, "a"): {"team": None, "age": "4"}, (0, "b"): {"finishTime": "bad"}, (1, "a"): {"age": "7"}}


def test_reorder_with_large_sequence_numbers(rows_of):
    rows = rows_of("race_id bigint, id string, seq bigint", (0, "a", 5), (0, "b", (1 << 63) - 1), (0, "c", 1 << 52)).selectExpr("*", "1L AS rank")
    order = rows_of("race_id bigint, id string, rank bigint, pos int", (0, "c", 1, 0))
    got = {r.id: r.seq for r in res.reorder(rows, order, keep_unlisted=True).collect()}
    assert got["c"] < got["a"] < got["b"]


def test_delete_and_reorder(rows_of, results):
    gone = rows_of("race_id bigint, id string", (0, "a"))
    assert {r.id for r in res.apply_deletes(results, gone).collect()} == {"b", "c", "d"}
    order = rows_of("race_id bigint, id string, rank bigint, pos int", (0, "c", 1, 0), (0, "a", 2, 1), (0, "q", 3, 2))
    assert by(res.reorder(results, order), "id", "rank", "seq") == {"c": (1, 0), "a": (2, 1)}
    kept = by(res.reorder(results, order, keep_unlisted=True), "id", "rank", "seq")
    assert set(kept) == {"a", "b", "c", "d"} and kept["b"][1] > 1


def test_leaderboard_text(rows_of):
    rows = rows_of(
        schemas.RESULT,
        (0, "a", "1", " Ann  Mary Lee", 60000.0, None, "W", "T", None, 1),
        (0, "b", "2", None, 80000.0, None, None, None, None, 2),
        (0, "c", "3", "Zed", None, None, None, None, None, 3),
    )
    got = [tuple(r)[1:] for r in ranking.leaderboard(rows).orderBy("Place").collect()]
    assert got[0] == (
        1, "1", " Ann  Mary Lee", "Ann", "Mary Lee", "", "W", "01:00.00", "00:00.00",
        "0.000000", "1.000000", "0.125000", "0.125000", "T",
    )
    assert got[1][7:13] == ("01:20.00", "00:20.00", "0.250000", "0.750000", "-0.125000", "-0.125000")[0:6]
    assert got[2][7:13] == ("", "", "", "", "", "")


def test_boards(rows_of, results):
    assert by(boards.dedupe_board(results), "bib_number", "id")["101"] == "a"
    assert by(res.flag_duplicate_bibs(results), "id", "is_duplicate") == {
        "a": True, "b": False, "c": True, "d": False,
    }
    once = boards.dedupe_board(results)
    assert boards.dedupe_board(once).count() == once.count()
    with pytest.raises(ValueError):
        boards.dedupe_board(results, "other")
    export = [tuple(r)[1:5] for r in boards.export_rows(results).orderBy("Rank").collect()]
    assert export[0] == (1, "9", "Nine", "") and export[1] == (2, "101", "Racer #101", "00:01.00")


def test_starter_list(rows_of):
    schema = "Bib double, `First Name` string, `Last Name` string, Gender string, Age double"
    rows = rows_of(
        schema, (1.0, "A", "B", "M", 9.0), (None, "C", "D", "F", 9.0), (2.0, "E", None, "F", None)
    )
    got = [tuple(r) for r in report.format_starter_list(rows).orderBy("bibNumber").collect()]
    assert got == [(1, "A B", "Male", 9, "Age 7 - 9"), (2, None, "Female", 100, "Age 19 and up")]


def test_zero_timing_total(rows_of):
    assert report.timing_report(rows_of(schemas.STAGE_TIMING, ("a", 0.0))).count() == 0


def test_ranks_are_dense(spark, rows_of):
    rows = spark.range(100).select(
        F.lit(0).cast("bigint").alias("race_id"), (F.col("id") % 7).cast("double").alias("finish_time_ms"),
        F.col("id").alias("seq"), F.lit(None).cast("bigint").alias("rank"),
    )
    assert sorted(r.rank for r in ranking.rank_overall(rows).collect()) == list(range(1, 101))
