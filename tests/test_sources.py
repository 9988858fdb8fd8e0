"""Files in and out."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from paceline import schemas
from paceline.operators import annotate, results
from paceline.options import Options
from paceline.sources import feeds, files, sinks


def text_files(path):
    return sorted(p for p in path.rglob("part-*") if not p.name.endswith(".crc"))


@pytest.mark.parametrize("multi_line", [True, False])
def test_roster(spark, tmp_path, multi_line):
    path = tmp_path / "r.csv"
    path.write_text("bibNumber,racerName,Age\n101, Ann ,7\n102,\"Bo, Jr\",\n\n,None,3\n", encoding="utf-8")
    rows = files.read_roster(spark, str(path), race_id=4, multi_line=multi_line).orderBy("row_num").collect()
    assert [(r.race_id, r.row_num, r.bib_number, r.racer_name, r.age, r.team) for r in rows] == [
        (4, 2, "101", " Ann ", "7", None), (4, 3, "102", "Bo, Jr", None, None), (4, 4, None, "None", "3", None),
    ]


def test_roster_line_breaks_and_errors(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('bibNumber,racerName\n1,"A\nB"\n2,C\n', encoding="utf-8")
    rows = files.read_roster(spark, str(path)).orderBy("row_num").collect()
    assert [(r.row_num, r.racer_name) for r in rows] == [(2, "A\nB"), (3, "C")]
    (tmp_path / "h.csv").write_text("bib,racerName\n1,A\n")
    with pytest.raises(ValueError, match="must contain headers"):
        files.read_roster(spark, str(tmp_path / "h.csv"))
    with pytest.raises(ValueError, match="CSV file"):
        files.read_roster(spark, str(tmp_path / "h.txt"))
    (tmp_path / "latin.csv").write_bytes("bibNumber,racerName\n1,J\xe4n\n".encode("latin-1"))
    with pytest.raises(Exception, match="UTF-8"):
        files.read_roster(spark, str(tmp_path / "latin.csv")).collect()


def test_rows_are_numbered_per_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        body = "".join(f"{i},{name}\n" for i in range(n))
        (tmp_path / f"{name}.csv").write_text("bibNumber,racerName\n" + body)
    rows = files.read_roster(spark, f"{tmp_path}/").collect()
    assert all(r.row_num == int(r.bib_number) + 2 for r in rows) and len(rows) == 8


def test_roster_over_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bibNumber,racerName\n4,A\n5,First\n5,Again\n")
    (tmp_path / "b.csv").write_text("bibNumber,racerName\n6,C\n5,Other file\n4,\n")
    kept, errors = results.roster_quarantine(files.read_roster(spark, f"{tmp_path}/"))
    assert {(r.bib_number, r.racer_name, r.file_no, r.row_num) for r in kept.collect()} == {
        ("4", "A", 0, 2), ("5", "First", 0, 3), ("6", "C", 1, 2),
    }
    assert {(r.file_no, r.row_num, r.bib_number) for r in errors.collect()} == {(0, 4, "5"), (1, 3, "5"), (1, 4, "4")}


def test_starter_list_round_trip(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Bib,First Name,Last Name,Gender,Age,Extra\n1,A,B,M,9,q\n,C,D,F,x,q\n")
    rows = files.read_starter_list(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in rows.collect()] == [(1.0, "A", "B", "M", 9.0), (None, "C", "D", "F", None)]
    sinks.write_starter_list(rows, str(tmp_path / "out"))
    assert files.read_starter_list(spark, str(tmp_path / "out")).count() == 2


def test_equal_bodies_are_two_events(spark, tmp_path):
    body = '{"bibNumber": "5", "finishTime": 1000}'
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(f'{body}\n{{"bibNumber": "6"}}\n{body}\n')
    rows = feeds.read_finisher_events(spark, f"{tmp_path}/").orderBy("seq").collect()
    assert [r.bib_number for r in rows] == ["5", "6", "5"] * 2
    assert len({r.event_id for r in rows}) == len({r.seq for r in rows}) == 6
    again = feeds.read_finisher_events(spark, f"{tmp_path}/").orderBy("seq").collect()
    assert rows == again


def test_scope_deletes_its_tables(spark):
    from paceline.plans import tables

    kept = tables.materialize(spark.range(3), "kept")
    with tables.scope(spark):
        inner = tables.materialize(spark.range(4), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_malformed_shapes_drop_the_document(spark):
    schema = "stem string, imageWidth double, imageHeight double, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
    two = [[1.0, 2.0], [3.0, 4.0]]
    docs = spark.createDataFrame(
        [
            ("ok", 10.0, 10.0, [("0", "rectangle", two), ("0", "polygon", [])]), ("one", 10.0, 10.0, [("0", "rectangle", two[:1])]),
            ("short", 10.0, 10.0, [("0", "rectangle", [[1.0], [2.0, 3.0]])]), ("none", 10.0, 10.0, [("0", "rectangle", None)]),
            ("bib", 10.0, 10.0, [("bib", "rectangle", two)]), ("empty", 10.0, 10.0, []),
        ],
        schema,
    )
    assert {r.stem for r in annotate.label_text(docs).collect()} == {"ok", "empty"}
    assert {r.stem for r in annotate.malformed(docs).collect()} == {"one", "short", "none", "bib"}


def test_annotations_to_labels(spark, tmp_path):
    def doc(name, width, *shapes):
        body = {"imageWidth": width, "imageHeight": 100, "shapes": list(shapes)}
        (tmp_path / name).write_text(json.dumps(body))

    def shape(label, kind, *points):
        return {"label": label, "shape_type": kind, "points": [list(map(float, p)) for p in points]}

    rect = "rectangle"
    doc("a.json", 200, shape("1", rect, (60, 40), (20, 10)), shape("0", rect, (0, 0), (200, 100)), shape("x", "polygon", (0, 0), (1, 1)))
    doc("b.json", 200)
    doc("c.json", 0, shape("1", rect, (0, 0), (1, 1)))
    doc("d.json", 200, shape("bib", rect, (0, 0), (1, 1)))
    (tmp_path / "e.json").write_text("{not json")
    docs, bad = files.read_annotations(spark, str(tmp_path))
    assert [r.stem for r in bad.collect()] == ["e"]
    texts = {r.stem: r.value for r in annotate.label_text(docs).collect()}
    assert texts == {
        "a": "1 0.200000 0.250000 0.200000 0.300000\n0 0.500000 0.500000 1.000000 1.000000",
        "b": "",
    }
    assert annotate.converted_count(docs).first().converted == 2
    sinks.write_labels(annotate.label_text(docs), str(tmp_path / "rows"))
    assert {r.stem: r.value for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == texts
    sinks.write_labels(annotate.label_text(docs), str(tmp_path / "labels"), per_image=True)
    (folder,) = (tmp_path / "labels").glob("folder=*/stem=a")
    assert text_files(folder)[0].read_text().split("\n")[0].startswith("1 0.2")


def test_pairs(spark, tmp_path):
    for name in ("a.json", "a.jpg", "b.json", "c.JSON", "c.jpg", "d.json", "d.JPG"):
        (tmp_path / name).write_text("x")
    listing = files.list_files(spark, str(tmp_path))
    assert {r.stem for r in annotate.pair_files(listing).collect()} == {"a", "c"}
    assert {r.stem for r in annotate.unpaired_files(listing).collect()} == {"b", "d"}
    plan = listing._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_export_and_board(spark, rows_of, tmp_path):
    rows = rows_of(
        schemas.RESULT,
        (0, "a", "1", 'Ann "Ace" Lee', 61230.0, 1, "W", "T, U", None, 1),
        (0, "b", "2", None, 0.0, None, None, None, None, 2),
    )
    path = sinks.write_results_export(rows, str(tmp_path), date(2024, 5, 6))
    assert path.endswith("race_results_2024-05-06.csv")
    out = [line for p in text_files(tmp_path / "race_results_2024-05-06.csv") for line in p.read_text().splitlines()]
    lines = [x for x in out if not x.startswith("Rank")]
    assert lines == ['1,2,"Unknown Runner",,,""', '2,1,"Ann ""Ace"" Lee",01:01.23,W,"T, U"']
    sinks.write_leaderboard(rows, str(tmp_path / "board"))
    board = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "board"))
    assert tuple(c for c in board.columns if c != "race_id") == sinks.LEADERBOARD
    assert [(r.Place, r.Name) for r in board.orderBy("Place").collect()] == [("1", 'Ann "Ace" Lee'), ("2", None)]


def test_board_parts_are_in_order(spark, tmp_path):
    rows = spark.range(5000).select(
        (F.col("id") % 3).alias("race_id"), F.col("id").cast("string").alias("id"),
        F.col("id").cast("string").alias("bib_number"), F.lit("A B").alias("racer_name"),
        ((F.col("id") * 7919) % 5000).cast("double").alias("finish_time_ms"),
        *[F.lit(None).cast("string").alias(c) for c in ("gender", "team", "age")],
        F.col("id").alias("seq"),
    )
    sinks.write_leaderboard(rows, str(tmp_path / "board"))
    for race in range(3):
        lines = [x for p in text_files(tmp_path / "board" / f"race_id={race}") for x in p.read_text().splitlines()]
        places = [int(x.split(",")[0]) for x in lines if not x.startswith("Place")]
        assert places == list(range(1, len(places) + 1)) and len(places) > 1600


def test_messages_round_trip(rows_of):
    rows = rows_of(schemas.RESULT, (0, "a", "1", "Ann", 5.0, 2, "W", "T", None, 9))
    sent = rows.select("race_id", F.col("seq").alias("change_seq"), feeds.result_message("update").alias("value"))
    assert json.loads(sent.first().value) == {
        "type": "update",
        "data": {"id": "a", "bibNumber": "1", "racerName": "Ann", "finishTime": 5.0, "rank": 2, "gender": "W", "team": "T"},
    }
    row = feeds.change_log(sent).first()
    assert (row.type, row.id, row.data.racer_name, row.data["rank"]) == ("update", "a", "Ann", 2)
    state = rows_of("race_start_s double, status string, offset_ms double", (1.0, "running", 2.0))
    assert json.loads(state.select(feeds.clock_message()).first()[0]) == {
        "type": "clock_update", "data": {"raceStartTime": 1.0, "status": "running", "offset": 2.0},
    }
    assert json.loads(state.select(feeds.reload_message()).first()[0]) == {"action": "reload"}


def test_detections_push_down(spark, rows_of, tmp_path):
    rows_of(schemas.DETECTION, (0, "c", 1, 0.0, 0.0, 0, 1, 0, 0.9, 0.0, 0.0, 1.0, 1.0)).write.parquet(str(tmp_path / "d"))
    hits = feeds.read_detections(spark, str(tmp_path / "d")).where("cls = 1 AND conf > 0.7").select("track_id")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cls,1)" in plan and "GreaterThan(conf,0.7)" in plan and "x1" not in plan


def test_options():
    assert Options.from_env({"LEADERBOARD_CSV_PATH": "/x"}).leaderboard_path == "/x"
    assert Options.from_env({}).bib_conf == 0.70
