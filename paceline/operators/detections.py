"""Detections: routing, filters, and bibs joined to persons by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.times import strip
from ..options import Options

DEFAULT = Options()
FRAME = ["race_id", "camera_id", "frame_ord"]
TRACK = ["race_id", "camera_id", "track_id"]
PERSON, BIB = 0, 1
# Grid of the position join: cell side in pixels, and the last cell index.
CELL, LAST_CELL = 512, 63


def drop_untracked(df: DataFrame) -> DataFrame:
    return df.where(F.col("track_id").isNotNull())


def last_box_per_track(persons: DataFrame) -> DataFrame:
    """A track seen twice in one frame keeps its last box."""
    key = [*FRAME, "track_id"]
    rest = [c for c in persons.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.col("det_seq")).alias("_last")
    return persons.groupBy(*key).agg(last).select(*key, "_last.*").select(*persons.columns)


def persons_in_view(
    df: DataFrame, width: Column, height: Column, opts: Options = DEFAULT
) -> DataFrame:
    """Tracked persons inside the corridor, repeated boxes included.

    A pure filter.  Presence of a track (islands, emission) needs no more than
    this, so those operators skip the shuffle of ``last_box_per_track``.
    """
    inside = geo.in_corridor(geo.box_columns(), width, height, opts.geometry)
    return drop_untracked(df).where((F.col("cls") == PERSON) & inside)


def split_classes(
    df: DataFrame, width: Column, height: Column, opts: Options = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Persons inside the corridor (one box per track) and all bibs."""
    persons = last_box_per_track(persons_in_view(df, width, height, opts))
    return persons, drop_untracked(df).where(F.col("cls") == BIB)


def conf_gate(df: DataFrame, threshold: float = DEFAULT.bib_conf) -> DataFrame:
    return df.where(F.col("conf") > threshold)


def _cell(coord: Column) -> Column:
    """Grid index, clamped at both ends; clamping keeps the order of coordinates."""
    last = F.lit(LAST_CELL).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(last, F.floor(coord / CELL)))


def _cells(lo: Column, hi: Column) -> Column:
    a, b = _cell(lo), _cell(hi)
    return F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))


def _first_hits(who: DataFrame, what: DataFrame) -> DataFrame:
    """First bib (by ``det_seq``) with its centre strictly inside each person box."""
    inside = (
        (F.col("x1") < F.col("_cx"))
        & (F.col("_cx") < F.col("x2"))
        & (F.col("y1") < F.col("_cy"))
        & (F.col("_cy") < F.col("y2"))
    )
    covered = who.withColumn("_gx", _cells(F.col("x1"), F.col("x2")))
    covered = covered.withColumn("_gy", _cells(F.col("y1"), F.col("y2")))
    pairs = covered.join(what, [*FRAME, "_gx", "_gy"]).where(inside)
    place = F.struct(F.col("det_seq").isNull().alias("_last"), "det_seq")
    first = F.min(F.struct(place.alias("_place"), "_bib")).alias("_first")
    return pairs.groupBy(*FRAME, "track_id").agg(first)


def assign_bibs(
    persons: DataFrame, bibs: DataFrame, gate: float | None = None
) -> DataFrame:
    """First bib (by ``det_seq``) whose centre lies strictly inside each person box.

    The confidence gate applies afterwards, so a weak first bib hides later
    ones.  Bibs sit in one grid cell and persons in the cells they cover; joining
    on frame and cell keeps candidates local.

    One pass over any frame; a bib without ``det_seq`` comes after all others.
    """
    gate = DEFAULT.bib_conf if gate is None else gate
    who = persons.select(*FRAME, "track_id", *geo.BOX)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    what = bibs.select(
        *FRAME,
        cx.alias("_cx"),
        cy.alias("_cy"),
        _cell(cx).alias("_gx"),
        _cell(cy).alias("_gy"),
        "det_seq",
        F.struct("det_seq", "conf", *geo.BOX).alias("_bib"),
    )
    hits = _first_hits(who, what)
    named = hits.select(
        *FRAME,
        "track_id",
        F.col("_first._bib.det_seq").alias("det_seq"),
        F.col("_first._bib.conf").alias("yolo_conf"),
        *[F.col(f"_first._bib.{c}").alias(c) for c in geo.BOX],
    )
    return named.where(F.col("yolo_conf") > gate)


def crops(
    bibs: DataFrame, width: Column, height: Column, padding: int = DEFAULT.crop_padding
) -> DataFrame:
    """Add the padded ``crop`` box; boxes that leave nothing are dropped."""
    crop = geo.pad_crop(geo.box_columns(), width, height, padding)
    return bibs.withColumn("crop", crop).where(geo.non_empty(F.col("crop")))


def best_candidate(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Most confident reading of each crop, the first on ties; then usable ones only."""
    keys = keys or ["race_id", "camera_id", "crop_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("cand_seq").asc())
    best = candidates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return usable_reads(best)


def usable_reads(df: DataFrame, text: str = "text", conf: str = "confidence") -> DataFrame:
    """Non-blank text (trimmed) with a non-zero confidence."""
    stripped = df.withColumn(text, strip(F.col(text)))
    return stripped.where((F.col(text) != "") & (F.col(conf) != 0))


def reliable_reads(reads: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    return reads.where(reliable(opts))


def reliable(opts: Options = DEFAULT) -> Column:
    lo, hi = opts.read_len
    return F.length("bib_read").between(lo, hi) & (F.col("ocr_conf") > opts.read_conf)
