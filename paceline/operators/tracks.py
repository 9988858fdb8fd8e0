"""Crossings, track islands, emission of finishers, and idle-frame skipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..functions import geometry as geo
from ..options import Options
from ..plans.ordered import ordered_index
from ..plans.skew import spread_join
from ..plans.tables import materialize
from . import idle
from . import votes as vote_ops
from .detections import FRAME, TRACK

DEFAULT = Options()
CAMERA = ["race_id", "camera_id"]


def first_crossing(persons: DataFrame, crossed: Column) -> DataFrame:
    """First frame in which each track meets the ``crossed`` predicate."""
    first = F.min(F.struct("frame_ord", "video_ms", "wall_ts")).alias("_f")
    hits = persons.where(crossed).groupBy(*TRACK).agg(first)
    return hits.select(
        *TRACK,
        F.col("_f.frame_ord").alias("cross_ord"),
        F.col("_f.video_ms").alias("finish_time_ms"),
        F.col("_f.wall_ts").alias("finish_wall_time"),
    )


def line_crossings(
    persons: DataFrame, width: Column, height: Column, opts: Options = DEFAULT
) -> DataFrame:
    line = geo.finish_line(width, height, opts.geometry)
    return first_crossing(persons, geo.crosses(geo.box_columns(), line["m"], line["b"]))


def entries_and_exits(persons: DataFrame) -> DataFrame:
    """Where runs of consecutive frames begin (``enters``) and where they are missed first.

    Each sighting counts for its own frame and, shifted, for the next one; a
    track found on one side only has entered or left.  The two sides of a run
    cancel in the partial aggregate, before the shuffle.
    """
    key = [*TRACK, "frame_ord"]
    after = (F.col("frame_ord") + 1).alias("frame_ord")
    now = persons.select(*key, F.lit(True).alias("enters"))
    before = persons.select(*TRACK, after, F.lit(False).alias("enters"))
    sides = now.unionByName(before).groupBy(*key).agg(
        F.min("enters").alias("enters"), F.max("enters").alias("_max")
    )
    return sides.where(F.col("enters") == F.col("_max")).drop("_max")


def track_islands(persons: DataFrame) -> DataFrame:
    """Runs of consecutive frames per track: first frame, last frame, length.

    Only the ends of runs are sorted; they alternate, so each pair is one run.
    """
    ends = ordered_index(entries_and_exits(persons), TRACK, [F.col("frame_ord").asc()], "_n")
    pair = F.floor((F.col("_n") + 1) / 2).alias("_pair")
    runs = ends.groupBy(*TRACK, pair).agg(
        F.min("frame_ord").alias("island_start"), (F.max("frame_ord") - 1).alias("island_end")
    )
    length = F.col("island_end") - F.col("island_start") + 1
    return runs.drop("_pair").withColumn("n_frames", length)


def lost_tracks(persons: DataFrame, crossings: DataFrame) -> DataFrame:
    """Crossed tracks that went missing, with the first frame they were missed in."""
    gone = entries_and_exits(persons).where(~F.col("enters"))
    crossed = crossings.select(*TRACK, "cross_ord")
    missed = spread_join(gone, crossed, TRACK, F.col("frame_ord"))
    later = missed.where(F.col("frame_ord") > F.col("cross_ord"))
    return later.groupBy(*TRACK).agg(F.min("frame_ord").alias("lost_ord"))


def set_changed(persons: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames whose set of tracks differs from the previous frame's."""
    moved = entries_and_exits(persons).select(*FRAME).distinct()
    return frames.select(*FRAME).join(moved, FRAME, "left_semi")


def emissions(
    persons: DataFrame,
    frames: DataFrame,
    crossings: DataFrame,
    hold: int = DEFAULT.hold_frames,
    flush_at_end: bool = False,
) -> DataFrame:
    """Frame in which each crossed track is sent on.

    A track that crossed at frame c goes out at c + hold while it stays in view,
    or in the first frame it is missing from.  Only the ``hold`` frames from c
    on matter, so each track keeps at most ``hold`` small numbers.  Tracks whose
    frame lies beyond the input are not sent, unless ``flush_at_end``.
    """
    crossed = materialize(crossings, "crossings")
    # The hold touches two buckets of ``hold`` frames, so (track, bucket) is an
    # equality key, and even a track that fills the table spreads over buckets.
    bucket = lambda at: F.floor(at / hold).alias("_bucket")
    cross = F.col("cross_ord")
    holds = crossed.select(
        *TRACK, "cross_ord", F.explode(F.array(bucket(cross), bucket(cross) + 1)).alias("_bucket")
    )
    seen = persons.select(*TRACK, "frame_ord", bucket(F.col("frame_ord")))
    offset = (F.col("frame_ord") - cross).cast("int")
    near = (
        seen.join(holds, [*TRACK, "_bucket"])
        .where(offset.between(0, hold - 1))
        .groupBy(*TRACK)
        .agg(F.collect_set(offset).alias("_seen"))
    )
    gaps = F.array_except(F.sequence(F.lit(0), F.lit(hold - 1)), F.col("_seen"))
    stay = F.coalesce(F.array_min(gaps), F.lit(hold))
    ends = materialize(frames.groupBy(*CAMERA).agg(F.max("frame_ord").alias("_last")), "ends")
    emit = F.col("cross_ord") + stay
    rows = crossed.join(near, TRACK).join(ends, CAMERA).withColumn("emit_ord", emit)
    if flush_at_end:
        rows = rows.withColumn("emit_ord", F.least("emit_ord", F.col("_last") + 1))
    else:
        rows = rows.where(F.col("emit_ord") <= F.col("_last"))
    return rows.drop("_seen", "_last")


def finishers(emitted: DataFrame, reads: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Emission events with the bib voted from the reads before the emission frame."""
    sent = materialize(emitted, "emitted")
    until = sent.select(*TRACK, "emit_ord")
    early = spread_join(reads, until, TRACK, F.col("frame_ord")).where("frame_ord < emit_ord")
    named = vote_ops.with_bib(sent, vote_ops.vote(early.drop("emit_ord"), opts))
    return named.withColumn("racer_name", clean.track_name(F.col("track_id")))


def track_board(crossings: DataFrame, votes: DataFrame) -> DataFrame:
    """All crossed tracks in order of video time, sent or not."""
    named = vote_ops.with_bib(crossings, votes, F.lit(clean.NO_BIB))
    order = [F.col("finish_time_ms").asc(), F.col("track_id").asc()]
    return ordered_index(named, CAMERA, order, "position")


# --- idle skip ---------------------------------------------------------------

BLOCK_ROWS = 1_000_000


def idle_skip(
    frames: DataFrame,
    after: int = DEFAULT.idle_after,
    drop: int = DEFAULT.idle_drop,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Frames that are processed: ``after`` empty ones in a row drop the next ``drop``.

    ``frames`` carry ``has_person``.
    """
    if after + drop > 255:
        raise ValueError("after + drop must stay below 256")
    cols = [*FRAME, F.coalesce("has_person", F.lit(False)).cast("int").alias("has_person")]
    rows = ordered_index(frames.select(*cols), CAMERA, [F.col("frame_ord").asc()], "_n")
    block = F.floor((F.col("_n") - 1) / block_rows).alias("_block")
    rows = materialize(rows.select("*", block), "blocks")
    maps = rows.groupBy(*CAMERA, "_block").applyInPandas(
        idle.block_map(after, drop),
        "race_id bigint, camera_id string, _block bigint, _exits binary",
    )
    entries = maps.groupBy(*CAMERA).applyInPandas(
        idle.chain, "race_id bigint, camera_id string, _block bigint, _entry int"
    )
    entered = rows.join(materialize(entries, "entries"), [*CAMERA, "_block"])
    return entered.groupBy(*CAMERA, "_block").applyInPandas(
        idle.replay(after, drop), "race_id bigint, camera_id string, frame_ord bigint"
    )


def person_frames(frames: DataFrame, persons: DataFrame) -> DataFrame:
    """Frames with ``has_person``."""
    seen = persons.select(*FRAME).distinct().withColumn("has_person", F.lit(True))
    joined = frames.join(seen, FRAME, "left")
    return joined.withColumn("has_person", F.coalesce("has_person", F.lit(False)))


def processed_ordinals(frames: DataFrame) -> DataFrame:
    """Dense 0-based ordinal of the processed frames of each camera."""
    numbered = ordered_index(frames, CAMERA, [F.col("frame_ord").asc()], "_n")
    return numbered.withColumn("ordinal", F.col("_n") - 1).drop("_n")

