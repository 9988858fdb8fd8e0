"""Streaming operators run to the end of their input; each equals its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, detections, feed, race
from ..plans.tables import materialize, shared_folder
from ..sources import sinks
from ..sources.feeds import read_frame_feed
from ..streaming import serve, stateful
from . import detections as det
from . import race as race_queries
from . import ranking as rank_queries
from . import views as v
from .registry import SQL, query

BATCHES = 4


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parts(df: DataFrame, order: str) -> list[DataFrame]:
    """The rows in a few ranges of ``order``, each for one micro-batch."""
    cuts = df.approxQuantile(order, [i / BATCHES for i in range(1, BATCHES)], 0.05)
    out, edges = [], [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        out.append(part)
    return out


def run(df: DataFrame, order: str, transform, writer=None, mode: str = "append") -> DataFrame:
    """Feed the rows of ``df`` range by range through a stream; read the resulting table.

    A range's rows are written by as many tasks as hold them and make one micro-batch;
    the query starts anew from its checkpoint for each.
    """
    spark = df.sparkSession
    path, out, checkpoint = (folder(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    for part in parts(df, order):
        part.write.mode("append").parquet(path)
        result = transform(spark.readStream.schema(df.schema).parquet(path))
        query = serve.run_available(result, (writer or serve.table_writer)(out), checkpoint, mode)
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).select(*result.columns)


def frame_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Frame feed from the detection view, with a read per person."""
    d = det.decoded(spark, sf)
    return nested_feed(d, det.person_reads(det.split(d)[0]))


def nested_feed(d: DataFrame, reads: DataFrame) -> DataFrame:
    """Frame feed: boxes and reads nested per frame."""
    reads = reads.groupBy("race_id", "camera_id", "frame_ord").agg(
        F.collect_list(F.struct("track_id", "det_seq", "bib_read", "ocr_conf")).alias("reads")
    )
    box = F.struct("det_seq", "track_id", "cls", "conf", "x1", "y1", "x2", "y2")
    frames = d.groupBy("race_id", "camera_id", "frame_ord").agg(
        F.first("video_ms").alias("video_ms"),
        F.first("wall_ts").alias("wall_ts"),
        F.collect_list(box).alias("detections"),
    )
    return frames.join(reads, ["race_id", "camera_id", "frame_ord"], "left").select(
        "race_id", "camera_id", "frame_ord", "video_ms", "wall_ts",
        F.lit(v.WIDTH).alias("width"), F.lit(v.HEIGHT).alias("height"), "detections", "reads",
    )


@query("q_stream_emission", det.FINISHERS)
def stream_emission(spark, sf):
    # Frames are written once as a feed and read back, as a camera's files would be.
    path = folder(spark, "feed")
    frame_feed(spark, sf).write.parquet(path)
    feed = read_frame_feed(spark, path)
    sent = run(feed, "frame_ord", lambda f: stateful.stream_emissions(stateful.feed_persons(f)))
    return sent.drop("cross_ord", "finish_time_ms")


SENT = ["cross_ord", "emit_ord", "finish_wall_time", "bib_number", "racer_name"]


@query(
    "q_stream_race",
    race_queries.EVENTS + f"SELECT race_id, camera_id, track_id, {', '.join(SENT)} FROM sent",
)
def stream_race(spark, sf):
    # A camera's feed carries the reads of the bibs assigned in each frame.
    d, _, reads = race_queries.observed(spark, sf)
    persons, bibs = det.split(d)
    shown = race.track_reads(detections.assign_bibs(persons, bibs), reads)
    path = folder(spark, "feed")
    nested_feed(d, shown).write.parquet(path)
    feed = read_frame_feed(spark, path)
    return run(feed, "frame_ord", stateful.stream_race_events).select(*det.CAM, "track_id", *SENT)


@query("q_stream_clock", SQL["q_clock_asof"])
def stream_clock(spark, sf):
    # One range holds both kinds of rows, as one ordered source does.
    events, log = v.v_arrival(spark, sf), v.v_clock(spark, sf)
    rows = events.withColumn("kind", F.lit(1)).unionByName(
        log.withColumn("kind", F.lit(0)), allowMissingColumns=True
    )

    def apply(stream):
        finishers = stream.where("kind = 1").select(*events.columns)
        return stateful.stream_apply_clock(finishers, stream.where("kind = 0"))

    timed = run(rows, "ts_s", apply)
    return timed.select(
        "race_id", "seq", F.round("race_start_s", 3).alias("race_start_s"), "status",
        F.round("offset_ms", 3).alias("offset_ms"),
    )


@query("q_stream_dedupe", SQL["q_dedupe_first_arrival"])
def stream_dedupe(spark, sf):
    first = lambda f: stateful.stream_first(f, boards.BIB, "seq")
    log = run(v.v_finish(spark, sf), "seq", first, mode="update")
    return serve.first_log(log, boards.BIB, "seq").drop("seq")


@query("q_stream_idle_skip", SQL["q_idle_skip"])
def stream_idle_skip(spark, sf):
    return run(v.v_idle(spark, sf), "frame_ord", stateful.stream_idle_skip)


@query("q_stream_changelog", SQL["q_changelog_fold"])
def stream_changelog(spark, sf):
    log = run(rank_queries.change_log(spark, sf), "change_seq", lambda f: f)
    folded = boards.fold_changes(log)
    return folded.select("race_id", "id", "seq", "finish_time_ms", "racer_name")


@query("q_stream_feed", SQL["q_feed_fold"])
def stream_feed(spark, sf):
    sent = run(rank_queries.change_feed(spark, sf), "change_seq", stateful.stream_feed)
    return feed.live_table(sent).select(*rank_queries.FEED_COLUMNS)


@query(
    "q_latest_frame",
    f"WITH {v.V_IDLE}"
    + " SELECT race_id, camera_id, max(frame_ord) AS frame_ord FROM v_idle GROUP BY ALL",
)
def latest_frame(spark, sf):
    return serve.latest_only(v.v_idle(spark, sf)).drop("has_person")


@query(
    "q_stream_latest",
    f"WITH {v.V_IDLE}"
    + """ SELECT race_id, camera_id, max(frame_ord) AS frame_ord,
  arg_max(has_person, frame_ord) AS has_person, count(*) AS n_seen FROM v_idle GROUP BY ALL""",
)
def stream_latest(spark, sf):
    log = run(v.v_idle(spark, sf), "frame_ord", stateful.stream_latest, mode="update")
    slots = serve.latest_log(log)
    # How many were taken hangs on the cuts between batches; taken and dropped add up.
    n_seen = (F.col("n_taken") + F.col("n_dropped")).alias("n_seen")
    return slots.select("race_id", "camera_id", "frame_ord", "has_person", n_seen)


@query(
    "q_stream_board",
    f"""SELECT race_id, CAST("Place" AS VARCHAR) AS place, "Bib" AS bib, "Name" AS name, "Time" AS time,
  "Difference" AS difference, nullif(trim(team), '') AS team
FROM ({SQL['q_leaderboard']} WHERE finish_time_ms IS NOT NULL)""",
)
def stream_board(spark, sf):
    # Every batch adds its rows and leaves a version of the board; the last one is read.
    boards_path = folder(spark, "boards")
    # Written once: cutting the rows into ranges reads them once a range and more.
    results = materialize(v.v_results(spark, sf), "results")
    run(results, "seq", lambda f: f, lambda out: serve.versioned_board(out, boards_path))
    columns = {"Place": "place", "Bib": "bib", "Name": "name", "Time": "time", "Difference": "difference"}
    board = sinks.read_leaderboard(spark, boards_path).withColumnsRenamed(columns)
    return board.select("race_id", *columns.values(), "team")
