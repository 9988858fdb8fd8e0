"""Frame selection for training sets, and per-video summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from .detections import FRAME, PERSON

CAMERA = ["race_id", "camera_id"]
# Ranges are matched with frames in blocks of this many frames.
BLOCK = 1 << 14
MSG_EVERY = "frame interval must be at least 1"
MSG_RANGE = "start time must be less than end time"
MSG_VIDEO = "no such video"


def frame_range(
    total: int, fps: float, start_s: float | None = None, end_s: float | None = None
) -> tuple[int, int]:
    """First frame and end frame (exclusive) of a time range."""
    first = max(0, int(start_s * fps)) if start_s is not None else 0
    end = min(total, int(end_s * fps)) if end_s is not None else total
    if first >= end:
        raise ValueError(MSG_RANGE)
    return first, end


def sample_frames(
    frames: DataFrame,
    every: int,
    total: int,
    fps: float,
    start_s: float | None = None,
    end_s: float | None = None,
) -> DataFrame:
    """Every n-th frame of the range, counted from the range start."""
    if every < 1:
        raise ValueError(MSG_EVERY)
    first, end = frame_range(total, fps, start_s, end_s)
    at = F.col("frame_ord")
    return frames.where((at >= first) & (at < end) & ((at - first) % every == 0))


def resolve_ranges(ranges: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges with first and end frame (exclusive), and rejected ones with ``error``.

    ``ranges`` has race_id, camera_id, range_no, every, start_s, end_s, the last two null
    where the video is not cut; ``videos`` one row per camera with fps and total.  A null
    ``every`` is rejected like a zero; a null or zero fps puts every given time at frame 0.
    """
    known = videos.select(*CAMERA, F.coalesce(F.col("fps").cast("double"), F.lit(0.0)).alias("_fps"), F.col("total").alias("_total"))
    at = lambda c: (F.col(c) * F.col("_fps")).cast("bigint")
    rows = ranges.join(known, CAMERA, "left").withColumns(
        {
            "first": F.greatest(F.lit(0), F.coalesce(at("start_s"), F.lit(0))).cast("bigint"),
            "end": F.least(F.col("_total"), F.coalesce(at("end_s"), F.col("_total"))).cast("bigint"),
        }
    )
    error = (
        F.when(F.coalesce(F.col("every") < 1, F.lit(True)), F.lit(MSG_EVERY))
        .when(F.col("_total").isNull(), F.lit(MSG_VIDEO))
        .when(F.col("first") >= F.col("end"), F.lit(MSG_RANGE))
    )
    rows = rows.withColumn("error", error).drop("_fps", "_total")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").drop("first", "end")


def sample_ranges(frames: DataFrame, ranges: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every n-th frame of each range of each camera, with ``range_no``; and rejected ranges.

    A frame in several ranges is returned for each.  Ranges are dealt to blocks of frames
    and joined by camera and block, so a frame meets only ranges that reach its block, and
    a camera with a third of the frames spreads over its blocks.
    """
    good, rejected = resolve_ranges(ranges, videos)
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    spread = good.select(*CAMERA, "range_no", "every", "first", "end", F.explode(blocks).alias("_block"))
    at = F.col("frame_ord")
    hits = frames.withColumn("_block", F.floor(at / BLOCK)).join(spread, [*CAMERA, "_block"])
    hits = hits.where((at >= F.col("first")) & (at < F.col("end")) & ((at - F.col("first")) % F.col("every") == 0))
    return hits.select(*frames.columns, "range_no"), rejected


def frames_with_person_in_roi(
    frames: DataFrame,
    detections: DataFrame,
    width: Column,
    conf: float,
    roi_from: float = 0.5,
) -> DataFrame:
    """Frames with a sure person whose centre is in the right part of the image."""
    if not 0 < conf < 1:
        raise ValueError("confidence threshold must lie between 0 and 1")
    centre = (F.col("x1") + F.col("x2")) / 2
    hits = detections.where(
        (F.col("cls") == PERSON) & (F.col("conf") >= conf) & (centre >= width * roi_from)
    )
    return frames.join(hits.select(*FRAME).distinct(), FRAME, "left_semi")


def frame_name(frame_ord: Column, fps: Column, extension: str = "jpg") -> Column:
    stamp = times.fixed(frame_ord / fps, 3)
    return F.format_string(f"frame_%06d_t%ss.{extension.lower()}", frame_ord, stamp)


def video_summary(frames: DataFrame) -> DataFrame:
    """Frame count, fps and duration per camera."""
    counted = frames.groupBy(*CAMERA).agg(
        F.count(F.lit(1)).alias("frames"), F.max("fps").alias("fps")
    )
    return counted.select(
        "*",
        times.duration_s(F.col("frames"), F.col("fps")).alias("duration_s"),
        times.fmt_duration(F.col("frames"), F.col("fps")).alias("duration"),
    )
