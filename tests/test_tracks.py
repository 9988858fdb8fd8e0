"""Detections to finishers: fixture rows, and random sequences against the machine."""

import random

import pytest
from pyspark.sql import functions as F

from paceline import schemas
from paceline.functions import geometry as geo
from paceline.operators import detections, frames, idle, tracks, votes
from tests.machine import emissions, kept_frames, random_frames

CAM = (0, "c")


def boxes(rows_of, *rows):
    """(frame, det_seq, track, cls, conf, x1, y1, x2, y2)"""
    full = [(*CAM, f, f * 40.0, 1000.0 + f, *rest) for f, *rest in rows]
    return rows_of(schemas.DETECTION, *full)


def test_first_bib_decides_before_the_gate(rows_of):
    det = boxes(
        rows_of,
        (1, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (1, 1, 20, 1, 0.65, 740.0, 650.0, 770.0, 690.0),
        (1, 2, 21, 1, 0.95, 745.0, 655.0, 775.0, 695.0),
        (2, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (2, 1, 8, 0, 0.9, 690.0, 600.0, 790.0, 900.0),
        (2, 2, 21, 1, 0.95, 745.0, 655.0, 775.0, 695.0),
        (3, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (3, 1, 21, 1, 0.95, 690.0, 655.0, 710.0, 695.0),
    )
    persons, bibs = det.where("cls = 0"), det.where("cls = 1")
    got = {(r.frame_ord, r.track_id): r.det_seq for r in detections.assign_bibs(persons, bibs).collect()}
    # Frame 1: the weak first bib hides the second.  Frame 3: centre on the edge.
    assert got == {(2, 7): 2, (2, 8): 2}


def test_assign_bibs_brute_force(rows_of):
    rng = random.Random(3)
    rows = []
    for f in range(30):
        for n in range(60):
            cls = int(rng.random() < 0.5)
            x, y = rng.uniform(-900, 40000), rng.uniform(-900, 3000)
            w, h = (40, 30) if cls else (rng.uniform(1, 9000), rng.uniform(1, 2500))
            rows.append((f, n, n, cls, rng.random(), x, y, x + w, y + h))
    det = boxes(rows_of, *rows)
    got = {
        (r.frame_ord, r.track_id): r.det_seq
        for r in detections.assign_bibs(det.where("cls = 0"), det.where("cls = 1")).collect()
    }
    want = {}
    for f, _, t, cls, _, x1, y1, x2, y2 in rows:
        if cls:
            continue
        for g, n, _, bcls, conf, bx1, by1, bx2, by2 in rows:
            if g == f and bcls and x1 < (bx1 + bx2) / 2 < x2 and y1 < (by1 + by2) / 2 < y2:
                if conf > 0.7:
                    want[f, t] = n
                break
    assert got == want and want


def test_bib_without_sequence_comes_last(rows_of):
    det = boxes(
        rows_of,
        (1, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (1, None, 20, 1, 0.99, 740.0, 650.0, 770.0, 690.0),
        (1, 5, 21, 1, 0.95, 745.0, 655.0, 775.0, 695.0),
        (2, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (2, None, 20, 1, 0.99, 740.0, 650.0, 770.0, 690.0),
    )
    got = detections.assign_bibs(det.where("cls = 0"), det.where("cls = 1")).collect()
    assert {(r.frame_ord, r.det_seq, r.yolo_conf) for r in got} == {(1, 5, 0.95), (2, None, 0.99)}


def test_split_and_crossing(rows_of):
    det = boxes(
        rows_of,
        (1, 0, 7, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (1, 1, 7, 0, 0.9, 701.0, 600.0, 800.0, 900.0),
        (1, 2, 9, 0, 0.9, 0.0, 900.0, 10.0, 1000.0),
        (1, 3, None, 0, 0.9, 700.0, 600.0, 800.0, 900.0),
        (2, 0, 7, 0, 0.9, 700.0, 700.0, 800.0, 1080.0),
        (3, 0, 7, 0, 0.9, 700.0, 700.0, 800.0, 1080.0),
    )
    size = F.lit(1920), F.lit(1080)
    persons, _ = detections.split_classes(det, *size)
    assert {(r.frame_ord, r.track_id, r.x1) for r in persons.collect()} == {
        (1, 7, 701.0), (2, 7, 700.0), (3, 7, 700.0),
    }
    hit = tracks.line_crossings(persons, *size).first()
    assert (hit.track_id, hit.cross_ord, hit.finish_time_ms, hit.finish_wall_time) == (7, 2, 80.0, 1002.0)


def test_crossing_reduces_to_bottom_right(spark):
    rng = random.Random(9)
    rows = [(x, y, x + rng.uniform(0, 200), y + rng.uniform(0, 400)) for x, y in
            ((rng.uniform(0, 1900), rng.uniform(0, 1200)) for _ in range(2000))]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    line = geo.finish_line(F.lit(1920), F.lit(1080))
    anywhere = geo.crosses(geo.box_columns(), line["m"], line["b"])
    corner = F.col("y2") >= line["m"] * F.col("x2") + line["b"]
    assert df.where(anywhere != corner).count() == 0
    assert 0 < df.where(anywhere).count() < 2000


def test_geometry(spark):
    w, h = F.lit(1920), F.lit(1080)
    got = spark.range(1).select(geo.roi_bounds(w, h)).first()[0]
    assert tuple(got) == (547, 476, 1920, 1080)
    box = tuple(F.lit(float(x)) for x in (5.9, -3.2, 1918.0, 40.0))
    crop = spark.range(1).select(geo.pad_crop(box, w, h)).first()[0]
    assert tuple(crop) == (0, 0, 1920, 55)
    level = geo.x_at_y((F.lit(1.0), F.lit(5.0)), (F.lit(9.0), F.lit(5.0)), F.lit(7.0))
    assert spark.range(1).select(level).first()[0] == 1.0


def as_tables(rows_of, sequences):
    """Sequences per camera to persons (with ``crossed``) and frames."""
    persons, frame_rows = [], []
    for cam, sequence in enumerate(sequences):
        for at, seen in enumerate(sequence):
            frame_rows.append((0, f"c{cam}", at))
            persons += [(0, f"c{cam}", at, t, at * 40.0, 1000.0 + at, bool(x)) for t, x in seen.items()]
    schema = "race_id bigint, camera_id string, frame_ord bigint, track_id bigint, video_ms double, wall_ts double, crossed boolean"
    return (
        rows_of(schema, *persons),
        rows_of("race_id bigint, camera_id string, frame_ord bigint", *frame_rows),
    )


@pytest.mark.parametrize("flush", [False, True])
def test_emissions_match_the_machine(rows_of, flush):
    rng = random.Random(17)
    sequences = [random_frames(rng, rng.randint(1, 90), 6, rng.choice([0.7, 0.9, 0.97])) for _ in range(60)]
    persons, frame_rows = as_tables(rows_of, sequences)
    crossings = tracks.first_crossing(persons, F.col("crossed"))
    sent = tracks.emissions(persons, frame_rows, crossings, flush_at_end=flush)
    got = {(r.camera_id, r.track_id): (r.cross_ord, r.emit_ord) for r in sent.collect()}
    want = {
        (f"c{cam}", t): pair
        for cam, sequence in enumerate(sequences)
        for t, pair in emissions(sequence, flush=flush).items()
    }
    assert got == want and want


def test_islands(rows_of):
    persons, frame_rows = as_tables(rows_of, [[{1: 0}, {1: 0}, {}, {1: 0, 2: 0}, {2: 0}]])
    got = {(r.track_id, r.island_start, r.island_end, r.n_frames) for r in tracks.track_islands(persons).collect()}
    assert got == {(1, 0, 1, 2), (1, 3, 3, 1), (2, 3, 4, 2)}
    changed = {r.frame_ord for r in tracks.set_changed(persons, frame_rows).collect()}
    assert changed == {0, 2, 3, 4}


@pytest.mark.parametrize("block_rows", [7, 50, 100_000])
def test_idle_skip(spark, block_rows):
    rng = random.Random(block_rows)
    series = {}
    for cam in ("a", "b"):
        flags = []
        while len(flags) < 600:
            flags += [rng.random() < 0.4] * rng.randint(1, 45)
        series[cam] = flags
    rows = [(0, cam, 3 * i, has) for cam, flags in series.items() for i, has in enumerate(flags)]
    df = spark.createDataFrame(rows, "race_id bigint, camera_id string, frame_ord bigint, has_person boolean")
    kept = tracks.idle_skip(df.repartition(5), block_rows=block_rows)
    got = sorted((r.camera_id, r.frame_ord // 3) for r in kept.collect())
    assert got == sorted((cam, i) for cam, flags in series.items() for i in kept_frames(flags))


def test_idle_tables_stay_in_range():
    steps = idle.step_tables(10, 31)
    assert steps.shape == (2, 41) and steps.max() == 40 and steps[0, 9] == 10
    with pytest.raises(ValueError):
        tracks.idle_skip(None, after=200, drop=100)


READ_ROWS = (
    (1, 1, 0, "12", 0.50), (1, 2, 0, "34", 0.50),
    (2, 1, 0, "7", 0.95), (2, 2, 0, "123", 0.40),
    (3, 1, 0, "55", 0.80), (3, 2, 0, "9", 0.995), (3, 3, 0, "55", 0.98), (3, 4, 0, "8", 0.999),
    (4, 1, 0, "10", 0.5), (4, 2, 0, "20", 0.9), (4, 3, 0, "10", 0.45),
)


@pytest.fixture
def reads(rows_of):
    return rows_of(schemas.OCR_READ, *[(*CAM, *r, 0.9) for r in READ_ROWS])


def test_vote(reads):
    got = {r.track_id: (r.final_bib, r.score, r.locked) for r in votes.vote(reads).collect()}
    assert got == {1: ("12", 0.5, False), 3: ("9", 0.995, True), 4: ("10", 0.95, False)}
    shown = {r.track_id: r.display_bib for r in votes.display_bib(reads).collect()}
    assert shown == {1: "12", 2: "7", 3: "9", 4: "10"}
    named = votes.with_bib(reads.select(*detections.TRACK).distinct(), votes.vote(reads))
    assert {r.track_id: r.bib_number for r in named.collect()}[2] == "Unknown-2"
    order = [(r.bib_read, r.read_no) for r in votes.reads_by_track(reads).where("track_id = 3").orderBy("read_no").collect()]
    assert order == [("55", 1), ("9", 2), ("55", 3), ("8", 4)]


def test_finishers_use_earlier_reads_only(rows_of, reads):
    sent = rows_of(
        "race_id bigint, camera_id string, track_id bigint, emit_ord bigint",
        (*CAM, 3, 2), (*CAM, 4, 3), (*CAM, 8, 3),
    )
    got = {r.track_id: r.bib_number for r in tracks.finishers(sent, reads).collect()}
    assert got == {3: "55", 4: "20", 8: "Unknown-8"}


def test_candidates(rows_of):
    c = rows_of(
        schemas.OCR_CANDIDATE,
        (*CAM, 1, 0, " 12 ", 0.5), (*CAM, 1, 1, "13", 0.5), (*CAM, 2, 0, " ", 0.9),
        (*CAM, 2, 1, "5", 0.8), (*CAM, 3, 0, "6", 0.0),
    )
    assert [(r.crop_id, r.text) for r in detections.best_candidate(c).collect()] == [(1, "12")]


def test_frame_range():
    assert frames.frame_range(100, 25.0) == (0, 100)
    assert frames.frame_range(100, 25.0, -1, 2) == (0, 50)
    with pytest.raises(ValueError):
        frames.frame_range(100, 25.0, 4, 4)
    with pytest.raises(ValueError):
        frames.sample_frames(None, 0, 1, 1.0)


def test_frame_name(spark):
    name = frames.frame_name(F.lit(7), F.lit(30.0), "JPG")
    assert spark.range(1).select(name).first()[0] == "frame_000007_t0.233s.jpg"


def test_ranges_of_several_cameras(rows_of, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 8)
    camera = "race_id bigint, camera_id string, "
    shown = rows_of(camera + "frame_ord bigint", *[(0, c, k) for c in "ab" for k in range(40)])
    videos = rows_of(camera + "fps double, total bigint", (0, "a", 10.0, 40), (0, "b", None, 30))
    asked = {("a", 0): (3, 0.75, 2.99), ("a", 1): (5, -1.0, None), ("a", 2): (1, 3.95, 99.0), ("b", 0): (7, None, None),
             ("b", 1): (1, 0.0, 9.0), ("a", 3): (None, None, None), ("c", 0): (1, None, None), ("a", 4): (2, 4.0, 5.0)}
    ranges = rows_of(camera + "range_no int, every int, start_s double, end_s double", *[(0, *key, *r) for key, r in asked.items()])
    got, rejected = frames.sample_ranges(shown, ranges, videos)
    want = {("a", 0): range(7, 29, 3), ("a", 1): range(0, 40, 5), ("a", 2): range(39, 40), ("b", 0): range(0, 30, 7)}
    assert sorted((r["camera_id"], r["range_no"], r["frame_ord"]) for r in got.collect()) == sorted((*key, k) for key, ks in want.items() for k in ks)
    assert {(r["camera_id"], r["range_no"]): r["error"] for r in rejected.collect()} == {
        ("b", 1): frames.MSG_RANGE, ("a", 3): frames.MSG_EVERY, ("c", 0): frames.MSG_VIDEO, ("a", 4): frames.MSG_RANGE,
    }
