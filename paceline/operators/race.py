"""A race composed: detections to finisher events, official times and ranks.

Lost tracks, the hold and the bib tally are judged on processed frames, those the idle
rule lets through, whatever their own numbers: frames a camera never delivered, or that
were dropped while nobody was in view, do not part a track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..options import Options
from ..plans.ordered import ordered_index
from ..plans.tables import materialize
from ..schemas import RESULT
from . import detections, results, tracks
from .detections import BIB, FRAME, PERSON
from .tracks import CAMERA

DEFAULT = Options()
CROP = [*FRAME, "det_seq"]


def processed_frames(
    frames: DataFrame, persons: DataFrame, opts: Options = DEFAULT
) -> DataFrame:
    """Frames the idle rule lets through, with their dense ``ordinal`` per camera (from 0)."""
    flagged = tracks.person_frames(frames.select(*FRAME), persons)
    kept = tracks.idle_skip(flagged, opts.idle_after, opts.idle_drop)
    return materialize(tracks.processed_ordinals(kept), "processed")


def renumber(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of processed frames: ``frame_ord`` is the ordinal, ``source_ord`` the frame's own.

    An equi-join on the frame, so a hot camera spreads over its frames.
    """
    numbered = processed.select(*FRAME, "ordinal")
    return rows.join(numbered, FRAME).withColumnsRenamed(
        {"frame_ord": "source_ord", "ordinal": "frame_ord"}
    )


def track_reads(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of the crops that were assigned to a person, one row per track and frame."""
    crops = hits.select(*CROP, "track_id").join(reads.select(*CROP, "bib_read", "ocr_conf"), CROP)
    return crops.select(*CAMERA, "track_id", "frame_ord", "det_seq", "bib_read", "ocr_conf")


def observe(
    det: DataFrame,
    frames: DataFrame,
    reads: DataFrame,
    width: Column,
    height: Column,
    opts: Options = DEFAULT,
) -> dict[str, DataFrame]:
    """What the processed frames show: ``processed``, ``in_view``, ``persons``, ``reads``.

    ``reads`` come per crop (frame and ``det_seq`` of the bib box); frames without
    detections must be in ``frames``.
    """
    inside = geo.in_corridor(geo.box_columns(), width, height, opts.geometry)
    wanted = (F.col("cls") == BIB) | ((F.col("cls") == PERSON) & inside)
    used = detections.drop_untracked(det).where(wanted)
    processed = processed_frames(frames, used.where(F.col("cls") == PERSON), opts)
    # Read four times below: persons twice, their last boxes, and the bibs.
    seen = materialize(renumber(used, processed), "seen")
    in_view = seen.where(F.col("cls") == PERSON)
    persons = detections.last_box_per_track(in_view)
    hits = detections.assign_bibs(persons, seen.where(F.col("cls") == BIB), opts.bib_conf)
    shown = track_reads(hits, renumber(reads, processed))
    return {"processed": processed, "in_view": in_view, "persons": persons, "reads": shown}


def finisher_events(
    det: DataFrame,
    frames: DataFrame,
    reads: DataFrame,
    width: Column,
    height: Column,
    opts: Options = DEFAULT,
) -> DataFrame:
    """Finishers as sent, with the emission frame's number and wall time (``sent_ts``).

    ``cross_ord`` and ``emit_ord`` count processed frames; ``source_ord`` is the emission
    frame's own number.
    """
    seen = observe(det, frames, reads, width, height, opts)
    crossings = tracks.line_crossings(seen["persons"], width, height, opts)
    dense = seen["processed"].select(*CAMERA, F.col("ordinal").alias("frame_ord"))
    sent = tracks.emissions(seen["in_view"], dense, crossings, opts.hold_frames)
    named = tracks.finishers(sent, seen["reads"], opts)
    numbers = seen["processed"].select(
        *CAMERA, F.col("ordinal").alias("emit_ord"), F.col("frame_ord").alias("source_ord")
    )
    walls = frames.select(
        *CAMERA, F.col("frame_ord").alias("source_ord"), F.col("wall_ts").alias("sent_ts")
    )
    return named.join(numbers, [*CAMERA, "emit_ord"]).join(walls, [*CAMERA, "source_ord"])


def arrivals(sent: DataFrame) -> DataFrame:
    """Finishers as events for the results table, numbered per race in order of sending."""
    order = [F.col("sent_ts").asc(), F.col("camera_id").asc(), F.col("track_id").asc()]
    numbered = ordered_index(sent, ["race_id"], order, "seq")
    none = F.lit(None).cast("string")
    # The name sent is a stand-in for the track; the roster or the bib names the runner.
    return numbered.select(
        "race_id",
        F.concat_ws(":", "camera_id", F.col("track_id").cast("string")).alias("event_id"),
        "bib_number",
        F.col("finish_wall_time").alias("wall_clock_s"),
        F.lit(None).cast("double").alias("finish_time_ms"),
        none.alias("finish_time_str"),
        "racer_name",
        *[none.alias(c) for c in ("gender", "team", "age")],
        F.col("sent_ts").alias("ts_s"),
        "seq",
    )


def race_results(
    det: DataFrame,
    frames: DataFrame,
    reads: DataFrame,
    clock: DataFrame,
    roster: DataFrame,
    width: Column,
    height: Column,
    opts: Options = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Ranked results of a race from its detections, and the events that were rejected."""
    sent = finisher_events(det, frames, reads, width, height, opts)
    empty = det.sparkSession.createDataFrame([], RESULT)
    return results.add_finishers(empty, arrivals(sent), clock, roster)
