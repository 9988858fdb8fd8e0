"""Streaming twins: several splits, restarts from the checkpoint, and the writers."""

import random

import pytest
from pyspark.sql import functions as F

from paceline import schemas
from paceline.catalog.streams import folder
from paceline.operators import clock, tracks
from paceline.options import Options
from paceline.sources import feeds, sinks
from paceline.streaming import serve, stateful
from tests.machine import emissions, kept_frames, random_frames
from tests.test_clock import plain_fold, random_log

PERSONS = (
    "race_id bigint, camera_id string, frame_ord bigint, video_ms double, wall_ts double, "
    "persons array<struct<track_id:bigint, det_seq:int, crossed:boolean>>, "
    "reads array<struct<track_id:bigint, det_seq:int, bib_read:string, ocr_conf:double>>"
)


class Files:
    """A folder read as a stream, fed file by file."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, folder(spark, "in")
        self.spark.createDataFrame([], schema).coalesce(1).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.path)


def drain(df, writer, checkpoint):
    serve.run_available(df, writer, checkpoint).awaitTermination()


def feed_rows(sequences):
    rows = []
    for cam, sequence in enumerate(sequences):
        for at, seen in enumerate(sequence):
            people = [(t, i, bool(x)) for i, (t, x) in enumerate(seen.items())]
            reads = [(t, i, str(10 + t), 0.6) for i, t in enumerate(seen) if (at + t) % 3 == 0]
            rows.append((0, f"c{cam}", at, at * 40.0, 1000.0 + at, people, reads))
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_emissions(spark, shuffled):
    rng = random.Random(4)
    sequences = [random_frames(rng, 70, 5, 0.9) for _ in range(4)]
    rows = sorted(feed_rows(sequences), key=lambda r: r[2])
    if shuffled:
        rng.shuffle(rows)  # early frames wait in state
    source, out, checkpoint = Files(spark, PERSONS), folder(spark, "out"), folder(spark, "ck")
    for part in (rows[:100], rows[100:190], rows[190:]):
        source.add(part)
        # One run per part: each run resumes from the checkpoint of the last one.
        drain(stateful.stream_emissions(source.stream()), serve.table_writer(out), checkpoint)
    got = {(r.camera_id, r.track_id): (r.cross_ord, r.emit_ord) for r in spark.read.parquet(out).collect()}
    want = {(f"c{c}", t): p for c, s in enumerate(sequences) for t, p in emissions(s).items()}
    assert got == want and want


def state_rows(spark, checkpoint, name, key):
    """Number of entries of a state variable of the emission operator."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return reader.load(checkpoint).count()


def test_emission_state_stays_small(spark):
    """Many micro-batches with a lost frame: all finishers are sent, and the state stays flat."""
    rng, length, lost = random.Random(9), 400, 150
    frames = []
    for at in range(length):  # six tracks in view, each for 24 frames; one in four never crosses
        seen = {10 * t + k: (at - 8 * t) > 14 and k != 0 for t in range(at // 8 - 2, at // 8 + 1) for k in (0, 1) if t >= 0 and at - 8 * t < 24}
        frames.append(seen)
    rows = sorted(feed_rows([frames, frames]), key=lambda r: r[2])
    kept = [r for r in rows if not (r[1] == "c1" and r[2] == lost)]
    source, out, checkpoint = Files(spark, PERSONS), folder(spark, "out"), folder(spark, "ck")
    opts, sizes = Options(hold_frames=5, gap_frames=12, forget_frames=20), []
    for part in range(4):
        for n in range(20):
            at = 5 * (20 * part + n)
            mine = [r for r in kept if at <= r[2] < at + 5]
            source.add(rng.sample(mine, len(mine)))
        drain(stateful.stream_emissions(source.stream(), opts), serve.table_writer(out), checkpoint)
        sizes.append([state_rows(spark, checkpoint, name, "track_id") for name in ("tracks", "waiting", "stretches")])
    assert max(s[0] for s in sizes) <= 60 and max(s[1] for s in sizes) <= 24 and max(s[2] for s in sizes) <= 8
    got = {(r.camera_id, r.track_id): (r.cross_ord, r.emit_ord) for r in spark.read.parquet(out).collect()}
    whole = emissions(frames, hold=5)
    want = {("c0", t): p for t, p in whole.items()}
    # A lost frame is passed over: what it would have shown is seen, or sent, one frame later.
    late = lambda n: n + 1 if n == lost else n
    without = emissions([f for at, f in enumerate(frames) if at != lost], hold=5)
    assert {k: p for k, p in got.items() if k[0] == "c0"} == want
    assert {k[1] for k in got if k[0] == "c1"} == set(without)
    assert {t: got["c1", t][0] for t in without} == {t: late(p[0]) for t, p in whole.items()}


def test_late_frames_are_ignored(spark):
    """Frames that were given up do nothing when they come after all."""
    frames = [{1: at >= 10} for at in range(60)]
    rows = feed_rows([frames])
    source, out, checkpoint = Files(spark, PERSONS), folder(spark, "out"), folder(spark, "ck")
    opts = Options(hold_frames=5, gap_frames=8)
    for part in (rows[:9] + rows[20:30], rows[9:20], rows[30:]):
        source.add(part)
        drain(stateful.stream_emissions(source.stream(), opts), serve.table_writer(out), checkpoint)
    assert [(r.track_id, r.cross_ord, r.emit_ord) for r in spark.read.parquet(out).collect()] == [(1, 20, 25)]


def test_in_order_source(spark):
    rng = random.Random(5)
    sequence = random_frames(rng, 80, 4, 0.9)
    # Frame numbers with gaps; the batch is taken in order as it is.
    rows = [(0, "c0", 3 * at, *rest) for _, _, at, *rest in feed_rows([sequence])]
    source, out, checkpoint = Files(spark, PERSONS), folder(spark, "out"), folder(spark, "ck")
    opts = Options(hold_frames=90)
    for part in (rows[:33], rows[33:]):
        source.add(part)
        sent = stateful.stream_emissions(source.stream(), opts, dense=False)
        drain(sent, serve.table_writer(out), checkpoint)
    got = {r.track_id: (r.cross_ord // 3, r.emit_ord // 3) for r in spark.read.parquet(out).collect()}
    assert got == emissions(sequence) and got


def test_emission_votes_match_batch(spark, rows_of):
    rng = random.Random(8)
    rows = feed_rows([random_frames(rng, 60, 4, 0.95)])
    source, out = Files(spark, PERSONS), folder(spark, "out")
    source.add(rows)
    drain(stateful.stream_emissions(source.stream()), serve.table_writer(out), folder(spark, "ck"))
    got = {r.track_id: r.bib_number for r in spark.read.parquet(out).collect()}
    feed = spark.createDataFrame(rows, PERSONS)
    keys = ["race_id", "camera_id", "frame_ord"]
    people = feed.select(*keys, "video_ms", "wall_ts", F.inline("persons"))
    reads = feed.select(*keys, F.inline("reads"))
    sent = tracks.emissions(people, feed, tracks.first_crossing(people, F.col("crossed")))
    assert got == {r.track_id: r.bib_number for r in tracks.finishers(sent, reads).collect()}


def test_clock(spark):
    rng = random.Random(6)
    log = random_log(rng, 120)
    schema = "race_id bigint, kind int, ts_s double, seq bigint, action string, arg_ms double"
    # An event right after each clock row, at the same time.
    rows = [(0, k, ts, seq, a if k == 0 else None, arg) for ts, seq, a, arg in log for k in (0, 1)]
    source, out, checkpoint = Files(spark, schema), folder(spark, "out"), folder(spark, "ck")
    cut = next(i for i in range(100, 240) if rows[i][2] > rows[i - 1][2])
    for part in (rows[:cut], rows[cut:]):
        source.add(rng.sample(part, len(part)))
        stream = source.stream()
        events = stream.where("kind = 1").select("race_id", "ts_s", "seq")
        drain(stateful.stream_apply_clock(events, stream.where("kind = 0")), serve.table_writer(out), checkpoint)
    all_rows = spark.createDataFrame(rows, schema)
    batch = clock.apply_clock(all_rows.where("kind = 1").select("race_id", "ts_s", "seq"), all_rows.where("kind = 0"))
    state = lambda df: {r.seq: (r.race_start_s, r.status, r.offset_ms) for r in df.collect()}
    got = state(spark.read.parquet(out))
    assert got == state(batch) and len(got) == 120
    assert got[119] == plain_fold(log)[-1]


def test_idle_skip(spark):
    flags = [random.Random(i // 13).random() < 0.3 for i in range(400)]
    schema = "race_id bigint, camera_id string, frame_ord bigint, has_person boolean"
    source, out, checkpoint = Files(spark, schema), folder(spark, "out"), folder(spark, "ck")
    rows = [(0, "a", i, has) for i, has in enumerate(flags)]
    for part in (rows[:137], rows[137:]):
        source.add(part)
        drain(stateful.stream_idle_skip(source.stream()), serve.table_writer(out), checkpoint)
    assert sorted(r.frame_ord for r in spark.read.parquet(out).collect()) == kept_frames(flags)


def test_race_events_on_processed_frames(spark):
    """Missing frame numbers and idle stretches: lost tracks are judged on processed frames."""
    rng = random.Random(21)
    shown = [{} if (at // 25) % 3 == 1 else f for at, f in enumerate(random_frames(rng, 150, 4, 0.9))]
    numbers = sorted(rng.sample(range(400), len(shown)))
    rows = [(0, "c0", numbers[at], *rest) for _, _, at, *rest in feed_rows([shown])]
    kept = kept_frames([bool(f) for f in shown])
    source, out, checkpoint = Files(spark, PERSONS), folder(spark, "out"), folder(spark, "ck")
    opts = Options(hold_frames=8)
    for part in (rows[:61], rows[61:90], rows[90:]):
        source.add(part)
        dense = stateful.stream_processed(source.stream(), opts)
        drain(stateful.stream_emissions(dense, opts), serve.table_writer(out), checkpoint)
    got = {r.track_id: (r.cross_ord, r.emit_ord) for r in spark.read.parquet(out).collect()}
    assert got == emissions([shown[k] for k in kept], hold=8) and got and len(kept) < len(shown)


def run_keyed(spark, schema, batches, transform):
    """The change log of a keyed aggregate, and its checkpoint."""
    source, out, checkpoint = Files(spark, schema), folder(spark, "out"), folder(spark, "ck")
    for rows in batches:
        source.add(rows)
        changed = transform(source.stream())
        serve.run_available(changed, serve.table_writer(out), checkpoint, "update").awaitTermination()
    return spark.read.parquet(out), checkpoint


def test_first_row_per_key_costs_what_a_batch_holds(spark):
    rng, schema = random.Random(3), "race_id bigint, bib_number string, seq bigint, t double"
    # Bib 0 holds most rows; two rows come late.
    rows = [(0, str(max(0, rng.randrange(-20, 12))), n, None if n % 7 == 0 else n / 2) for n in range(400)]
    order = rows[:40] + rows[60:] + rows[40:60]
    batches = [order[n : n + 50] for n in range(0, 400, 50)]
    keys = ["race_id", "bib_number"]
    log, checkpoint = run_keyed(spark, schema, batches, lambda f: stateful.stream_first(f, keys, "seq"))
    want = {}
    for r in sorted(rows, key=lambda r: r[2]):
        want.setdefault(r[1], r)
    got = serve.first_log(log.select("race_id", "bib_number", "seq", "t"), keys, "seq").collect()
    assert {r.bib_number: tuple(r) for r in got} == want
    # A batch writes the keys it holds, whatever came before; the state has one row per key.
    sent = {r.batch_id: r["count"] for r in log.groupBy("batch_id").count().collect()}
    held = [len({r[1] for r in b}) for b in batches]
    assert [sent[k] for k in sorted(sent) if sent[k]] == held
    assert spark.read.format("statestore").load(checkpoint).count() == len(want)


def test_latest_slot_drops_late_frames(spark):
    schema = "race_id bigint, camera_id string, frame_ord bigint, tag string"
    batches = [
        [(0, "a", 1, "x"), (0, "a", 3, "y"), (0, "b", 5, None)],
        [(0, "a", 2, "late")],  # never takes the slot
        [(0, "a", 4, "z"), (0, "a", 6, None), (0, "b", 4, "late")],
        [(None, None, 1, "n")],
    ]
    log, checkpoint = run_keyed(spark, schema, batches, stateful.stream_latest)
    log = log.select("race_id", "camera_id", "frame_ord", "tag", "n_seen")
    got = {(r.camera_id, r.frame_ord, r.tag, r.n_taken, r.n_dropped) for r in serve.latest_log(log).collect()}
    # Camera a: 3 and 6 were taken, 1, 2 and 4 dropped.
    assert got == {("a", 6, None, 2, 3), ("b", 5, None, 1, 1), (None, 1, "n", 1, 0)}
    assert spark.read.format("statestore").load(checkpoint).count() == 3


def test_first_arrival_is_idempotent(spark):
    schema = "race_id bigint, bib_number string, seq bigint"
    path = folder(spark, "first")
    write = serve.first_arrival_writer(path)
    one = spark.createDataFrame([(0, "a", 2), (0, "a", 1), (0, "b", 3)], schema)
    two = spark.createDataFrame([(0, "a", 4), (0, "c", 5)], schema)
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        write(batch, n)
    got = {(r.bib_number, r.seq) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1), ("b", 3), ("c", 5)}


def test_board_versions(spark, tmp_path):
    """A reader sees whole boards only, also during a rewrite; few versions stay."""
    path, schema = str(tmp_path / "board"), "race_id bigint, n int"
    board = lambda n: spark.createDataFrame([(0, n), (1, n)], schema)
    write = sinks.write_version
    assert sinks.current_version(spark, path) is None
    for n in range(6):
        write(spark, path, n, lambda to, n=n: board(n).write.mode("overwrite").parquet(to), keep=3)
        assert sinks.current_version(spark, path).endswith(f"version={n}")
    assert sorted(p.name for p in tmp_path.joinpath("board").iterdir()) == [f"version={n}" for n in (3, 4, 5)]
    opened = spark.read.parquet(sinks.current_version(spark, path))

    def torn(to):
        board(6).write.parquet(to)
        tmp_path.joinpath("board/version=6/_SUCCESS").unlink()  # as while its tasks still write
        raise RuntimeError

    with pytest.raises(RuntimeError):
        write(spark, path, 6, torn, keep=3)
    assert sinks.current_version(spark, path).endswith("version=5")
    # A retried batch writes its own version anew; an opened board stays readable.
    write(spark, path, 6, lambda to: board(6).write.mode("overwrite").parquet(to), keep=3)
    write(spark, path, 6, lambda to: board(6).write.mode("overwrite").parquet(to), keep=3)
    assert sinks.current_version(spark, path).endswith("version=6")
    assert {r.n for r in opened.collect()} == {5}


def test_versioned_leaderboard(spark, rows_of, tmp_path):
    rows = [(0, str(n), str(n), f"R {n}", 1000.0 * (9 - n), None, "M", None, None, n) for n in range(6)]
    rows[2] = (*rows[2][:4], None, *rows[2][5:])
    table, path = str(tmp_path / "table"), str(tmp_path / "boards")
    write = serve.versioned_board(table, path, keep=2)
    for batch in range(3):
        for _ in range(2):  # a retried batch changes nothing
            write(rows_of(schemas.RESULT, *rows[2 * batch : 2 * batch + 2]), batch)
    assert sorted(p.name for p in tmp_path.joinpath("boards").iterdir()) == ["version=1", "version=2"]
    bibs = lambda df: [r.Bib for r in df.orderBy(F.col("Place").cast("int")).collect()]
    assert bibs(sinks.read_leaderboard(spark, path)) == ["5", "4", "3", "1", "0"]
    assert bibs(spark.read.option("header", True).csv(f"{path}/version=1")) == ["3", "1", "0"]


def test_serving_pipeline(spark, rows_of, tmp_path):
    body = '{{"event_id": "{0}", "bibNumber": "{1}", {2}, "arrival_ts": {3}, "seq": {0}}}'
    lines = [
        body.format(1, 5, '"wallClockTime": 110.0', 110.0),
        body.format(2, 6, '"finishTime": "00:05.50"', 111.0),
        body.format(3, 7, '"finishTime": 70000', 112.0),
        body.format(4, 8, '"finishTime": "bad"', 113.0),
    ]
    source, out = folder(spark, "events"), folder(spark, "out")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(source)
    log = rows_of(schemas.CLOCK_EVENT, (0, 100.0, 1, "start", None))
    roster = rows_of(schemas.ROSTER, (0, "5", "Five Star", "f", None, None))
    seen = []
    writer = serve.results_writer(
        out, lambda: roster, snapshot=str(tmp_path / "board"), changes=str(tmp_path / "changes")
    )
    hook = serve.on_finisher(lambda batch, n: (seen.append(batch.count()), writer(batch, n)))
    events = feeds.read_finisher_events(spark, source, streaming=True)
    drain(events, serve.official_times(lambda: log, hook), folder(spark, "ck"))
    assert seen == [4]
    rows = {r.bib_number: (r.racer_name, r.finish_time_ms) for r in spark.read.parquet(f"{out}/results").collect()}
    assert rows == {"5": ("Five Star", 10000.0), "6": ("Racer #6", 5500.0), "7": ("Racer #7", 70000.0)}
    assert spark.read.parquet(f"{out}/rejected").first().error == "Invalid time format. Use MM:SS.ms"
    board = spark.read.option("header", True).csv(str(tmp_path / "board")).orderBy("Place").collect()
    assert [(r.Bib, r.Time, r["First name"]) for r in board] == [
        ("6", "00:05.50", "Racer"), ("5", "00:10.00", "Five"), ("7", "01:10.00", "Racer"),
    ]
    messages = spark.read.text(str(tmp_path / "changes")).withColumn("m", feeds.from_message(F.col("value")))
    assert {r.m.data.bibNumber for r in messages.collect()} == {"5", "6", "7"}


def test_latest_only(rows_of):
    rows = rows_of("race_id bigint, camera_id string, frame_ord bigint, x int", (0, "a", 1, 5), (0, "a", 3, 6), (0, "b", 2, 7))
    assert {tuple(r) for r in serve.latest_only(rows).collect()} == {(0, "a", 3, 6), (0, "b", 2, 7)}


def test_track_board(spark, rows_of):
    path, board = folder(spark, "crossed"), folder(spark, "board")
    schema = "race_id bigint, camera_id string, track_id bigint, finish_time_ms double"
    write = serve.track_board_writer(path, board)
    write(rows_of(schema, (0, "a", 1, 50.0), (0, "a", 2, 40.0)), 0)
    write(rows_of(schema, (0, "a", 3, 45.0)), 1)
    got = [(r.track_id, r.position) for r in spark.read.parquet(board).orderBy("position").collect()]
    assert got == [(2, 1), (3, 2), (1, 3)]
