"""Camera geometry: crop box, finish line, corridor and box predicates.

Every function builds a Column from box columns and frame size, so the
predicates stay inside generated code and reach the scan where they can.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Geometry

BOX = ("x1", "y1", "x2", "y2")
DEFAULT = Geometry()


def _int(c: Column) -> Column:
    return c.cast("int")


def roi_bounds(width: Column, height: Column, geo: Geometry = DEFAULT) -> Column:
    """``struct<x1,y1,x2,y2>`` of the detector crop, cut to whole pixels."""
    top = height * geo.horizon_y * geo.crop_factor
    return F.struct(
        _int(width * geo.left_top_x).alias("x1"),
        _int(top).alias("y1"),
        _int(width).alias("x2"),
        _int(height).alias("y2"),
    )


def finish_line(width: Column, height: Column, geo: Geometry = DEFAULT) -> Column:
    """``struct<m,b>`` of ``y = m*x + b`` between the two frame edges."""
    left, right = height * geo.finish_left_y, height * geo.finish_right_y
    m = (right - left) / width.cast("double")
    return F.struct(m.alias("m"), left.alias("b"))


def camera_config(cameras: DataFrame, geo: Geometry = DEFAULT) -> DataFrame:
    """Add line, guide and crop columns to a table of cameras (width, height).

    One row per camera; join it to detections and use its columns in the
    predicates below.
    """
    w, h = F.col("width"), F.col("height")
    line, roi = finish_line(w, h, geo), roi_bounds(w, h, geo)
    added = {"m": line["m"], "b": line["b"]}
    added.update({f"crop_{c}": roi[c] for c in BOX})
    for name, ends in zip(("gl", "gr"), guides(w, h, geo), strict=True):
        for i, (x, y) in enumerate(ends, 1):
            added.update({f"{name}_x{i}": x, f"{name}_y{i}": y})
    return cameras.withColumns(added)


def to_frame_coords(
    df: DataFrame, width: Column, height: Column, geo: Geometry = DEFAULT
) -> DataFrame:
    """Detector pixels to frame pixels: scale up, then add the crop corner."""
    roi = roi_bounds(width, height, geo)
    moved = {
        c: F.col(c) / geo.detector_scale + roi[f"{c[0]}1"] for c in BOX
    }
    return df.withColumns(moved)


def corners(box: tuple[Column, ...]) -> list[tuple[Column, Column]]:
    x1, y1, x2, y2 = box
    return [(x, y) for y in (y1, y2) for x in (x1, x2)]


def box_columns(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def crosses(box: tuple[Column, ...], m: Column, b: Column) -> Column:
    """Some corner lies on or below the finish line."""
    return reduce(or_, [y >= m * x + b for x, y in corners(box)])


def x_at_y(p1: tuple[Column, Column], p2: tuple[Column, Column], y: Column) -> Column:
    """x of a guide line at height y; a level line answers with its first x."""
    dy = p2[1] - p1[1]
    slope_x = p1[0] + F.try_divide(y - p1[1], dy) * (p2[0] - p1[0])
    return F.when(F.abs(dy) < 1e-6, p1[0]).otherwise(slope_x)


def guides(width: Column, height: Column, geo: Geometry = DEFAULT):
    """Left and right guide line, each as (bottom point, top point)."""
    w, h = width.cast("double"), height.cast("double")
    horizon = h * geo.horizon_y
    left = ((w * geo.left_bottom_x, h), (w * geo.left_top_x, horizon))
    right = ((w, h * geo.right_bottom_y), (w * geo.right_top_x, horizon))
    return left, right


def in_corridor(
    box: tuple[Column, ...], width: Column, height: Column, geo: Geometry = DEFAULT
) -> Column:
    """Some corner lies between the two guide lines, edges included."""
    left, right = guides(width, height, geo)

    def between(x: Column, y: Column) -> Column:
        a, b = x_at_y(*left, y), x_at_y(*right, y)
        return x.between(F.least(a, b), F.greatest(a, b))

    return reduce(or_, [between(x, y) for x, y in corners(box)])


def valid_box(box: tuple[Column, ...], width: Column, height: Column) -> Column:
    """Drawable after cutting to whole pixels: inside the frame, not empty."""
    x1, y1, x2, y2 = (_int(c) for c in box)
    return (x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height)


def pad_crop(
    box: tuple[Column, ...], width: Column, height: Column, padding: int = 15
) -> Column:
    """``struct`` of the padded box clamped to the image."""
    x1, y1, x2, y2 = (_int(c) for c in box)
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, x1 - padding).alias("x1"),
        F.greatest(zero, y1 - padding).alias("y1"),
        F.least(_int(width), x2 + padding).alias("x2"),
        F.least(_int(height), y2 + padding).alias("y2"),
    )


def non_empty(crop: Column) -> Column:
    return (crop["x2"] > crop["x1"]) & (crop["y2"] > crop["y1"])
