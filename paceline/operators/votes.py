"""Which bib a track carries: confidence vote, lock, and displayed bib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..options import Options
from ..plans.ordered import ordered_index
from .detections import TRACK, reliable

DEFAULT = Options()
# Confidences are summed as whole billionths: exact, whatever the order of rows.
UNIT = 10**9


def _arrival() -> Column:
    return F.struct("frame_ord", "det_seq")


def _units() -> Column:
    return F.round(F.col("ocr_conf") * UNIT).cast("bigint")


def _tally(reads: DataFrame, opts: Options) -> DataFrame:
    """One row per track and bib, by partial aggregates."""
    good, lock = reliable(opts), F.col("ocr_conf") > opts.lock_conf
    return reads.groupBy(*TRACK, "bib_read").agg(
        F.sum(F.when(good, _units())).alias("_votes"),
        F.min(F.when(good, _arrival())).alias("_voted_at"),
        F.count(F.lit(1)).alias("_reads"),
        F.min(_arrival()).alias("_seen_at"),
        F.min(F.when(lock, F.struct("frame_ord", "det_seq", "ocr_conf"))).alias("_lock"),
    )


def _first_by(tally: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*TRACK).orderBy(*order)
    return tally.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")


def lock_bibs(reads: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Track's first read above the lock threshold."""
    locks = reads.where(F.col("ocr_conf") > opts.lock_conf)
    first = F.min(F.struct("frame_ord", "det_seq", "bib_read", "ocr_conf")).alias("_f")
    return locks.groupBy(*TRACK).agg(first).select(
        *TRACK,
        F.col("_f.bib_read").alias("final_bib"),
        F.col("_f.ocr_conf").alias("score"),
        F.col("_f.frame_ord").alias("locked_at"),
    )


def vote(reads: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Final bib per track: the lock, else the highest summed confidence.

    Ties go to the bib read first.  Reads after a lock cannot matter.
    """
    tally = _tally(reads, opts).where("_lock IS NOT NULL OR _votes IS NOT NULL")
    best = _first_by(
        tally,
        F.col("_lock").asc_nulls_last(),
        F.col("_votes").desc_nulls_last(),
        F.col("_voted_at").asc(),
    )
    locked = F.col("_lock").isNotNull()
    score = F.when(locked, F.col("_lock.ocr_conf")).otherwise(F.col("_votes") / F.lit(UNIT))
    return best.select(
        *TRACK, F.col("bib_read").alias("final_bib"), score.alias("score"), locked.alias("locked")
    )


def display_bib(reads: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Bib shown while tracking: the lock, else the most frequent raw read."""
    best = _first_by(
        _tally(reads, opts),
        F.col("_lock").asc_nulls_last(),
        F.col("_reads").desc(),
        F.col("_seen_at").asc(),
    )
    conf = F.col("_lock.ocr_conf")
    label = clean.track_label(F.col("track_id"), F.col("bib_read"), conf)
    return best.select(
        *TRACK,
        F.col("bib_read").alias("display_bib"),
        F.col("_lock").isNotNull().alias("locked"),
        label.alias("label"),
    )


def reads_by_track(reads: DataFrame) -> DataFrame:
    """Reads numbered in arrival order per track, as rows rather than lists."""
    order = [F.col("frame_ord").asc(), F.col("det_seq").asc()]
    return ordered_index(reads, TRACK, order, "read_no")


def with_bib(tracks: DataFrame, votes: DataFrame, default: Column | None = None) -> DataFrame:
    """Left join of the final bib; ``Unknown-{track}`` unless another default is given."""
    default = clean.unknown_bib(F.col("track_id")) if default is None else default
    joined = tracks.join(votes.select(*TRACK, "final_bib"), TRACK, "left")
    return joined.withColumn("bib_number", F.coalesce("final_bib", default)).drop("final_bib")
