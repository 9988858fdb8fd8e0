"""The composed race against the plain machine: missing frame numbers, idle stretches, clock."""

import random

from pyspark.sql import functions as F

from paceline import schemas
from paceline.operators import race
from paceline.options import Options
from tests.machine import emissions, kept_frames, random_frames

W, H = 1920, 1080
CROP_READ = "race_id bigint, camera_id string, frame_ord bigint, det_seq int, bib_read string, ocr_conf double"
FRAMES = "race_id bigint, camera_id string, frame_ord bigint, wall_ts double"
OPTS = Options(hold_frames=8)


def sequence(rng, n):
    """Frames with tracks that come and go, and stretches without anybody."""
    shown = random_frames(rng, n, 4, 0.9, 0.1)
    return [{} if (at // 25) % 3 == 1 else seen for at, seen in enumerate(shown)]


def rows_of_camera(cam, numbers, shown):
    """Boxes inside the corridor; those of a crossing reach below the line."""
    det = []
    for at, seen in zip(numbers, shown, strict=True):
        for i, (track, over) in enumerate(sorted(seen.items())):
            x, foot = 700.0 + 150 * i, 1060.0 if over else 700.0
            det.append((0, cam, at, at * 40.0, 1000.0 + at, i, track, 0, 0.9, x, 560.0, x + 100, foot))
            det.append((0, cam, at, at * 40.0, 1000.0 + at, 10 + i, 900 + i, 1, 0.9, x + 40, 600.0, x + 60, 620.0))
    return det


def test_events_on_processed_frames(rows_of):
    rng, det, frames, want, reads = random.Random(12), [], [], {}, []
    for cam in ("a", "b"):
        shown = sequence(rng, 160)
        numbers = sorted(rng.sample(range(400), len(shown)))  # most numbers are missing
        det += rows_of_camera(cam, numbers, shown)
        frames += [(0, cam, at, 1000.0 + at) for at in numbers]
        kept = kept_frames([bool(s) for s in shown])
        assert len(kept) < len(shown)
        for track, (cross, emit) in emissions([shown[k] for k in kept], hold=8).items():
            want[cam, track] = (cross, emit, numbers[kept[emit]], 1000.0 + numbers[kept[cross]])
    for r in det:
        if r[7] == 1:
            reads.append((0, r[1], r[2], r[5], "42", 0.6))
    got = race.finisher_events(
        rows_of(schemas.DETECTION, *det), rows_of(FRAMES, *frames), rows_of(CROP_READ, *reads),
        F.lit(W), F.lit(H), OPTS,
    )
    rows = got.collect()
    assert {(r.camera_id, r.track_id): (r.cross_ord, r.emit_ord, r.source_ord, r.finish_wall_time) for r in rows} == want
    assert want and all(r.sent_ts == 1000.0 + r.source_ord for r in rows)
    # A track that crosses in the first frame it is seen in may be gone before a read.
    assert {r.bib_number for r in rows} >= {"42"}


def test_ranked_and_rejected(rows_of):
    shown = [{1: at == 3, 2: at == 5} for at in range(20)]
    numbers = [3 * at for at in range(20)]
    det = rows_of(schemas.DETECTION, *rows_of_camera("a", numbers, shown))
    frames = rows_of(FRAMES, *[(0, "a", at, 1000.0 + at) for at in numbers])
    reads = rows_of(CROP_READ, *[(0, "a", at, 10 + i, str(11 + i), 0.6) for at in numbers for i in (0, 1)])
    roster = rows_of(schemas.ROSTER, (0, "12", "Twelve", "f", None, None))
    # Track 1 is sent in frame 11 (33), track 2 in frame 13 (39): the clock stops in between.
    log = rows_of(schemas.CLOCK_EVENT, (0, 1000.0, 1, "start", None), (0, 1036.0, 2, "stop", None))
    args = (det, frames, reads, log, roster, F.lit(W), F.lit(H), OPTS)
    ranked, rejected = race.race_results(*args)
    assert [(r.bib_number, r.finish_time_ms, r["rank"]) for r in ranked.collect()] == [("11", 9000.0, 1)]
    assert [r.event_id for r in rejected.collect()] == ["a:2"]
    ranked, rejected = race.race_results(*args[:3], log.where("action = 'start'"), *args[4:])
    got = sorted((r["rank"], r.bib_number, r.racer_name, r.finish_time_ms) for r in ranked.collect())
    assert got == [(1, "11", "Racer 1", 9000.0), (2, "12", "Twelve", 15000.0)]
    assert rejected.isEmpty()


def test_nothing_seen(rows_of):
    det, reads = rows_of(schemas.DETECTION), rows_of(CROP_READ)
    frames = rows_of(FRAMES, *[(0, "a", at, 1000.0 + at) for at in range(60)])
    for some in (frames, frames.limit(0)):
        assert race.finisher_events(det, some, reads, F.lit(W), F.lit(H)).isEmpty()
