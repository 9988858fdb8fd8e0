"""Annotation documents to normalised label rows, and file pairing.

A document's shapes are one array column, so filtering, normalising and joining
its label lines happen inside the row: no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.times import fixed

RECTANGLE = "rectangle"


def valid_images(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("imageWidth") > 0) & (F.col("imageHeight") > 0))


def rectangles(docs: DataFrame) -> DataFrame:
    """Keep rectangles only; a malformed document is dropped whole.

    Malformed: a rectangle whose class is no integer, or that lacks two points of
    two coordinates.  ``malformed`` lists those documents.
    """
    return _rectangles(docs).where(_well_formed())


def malformed(docs: DataFrame) -> DataFrame:
    """Documents that ``rectangles`` drops."""
    return _rectangles(docs).where(~F.coalesce(_well_formed(), F.lit(False)))


def _rectangles(docs: DataFrame) -> DataFrame:
    only = F.filter("shapes", lambda s: s["shape_type"] == RECTANGLE)
    return docs.withColumn("shapes", only)


def _well_formed() -> Column:
    def corner(shape: Column, i: int) -> Column:
        point = F.get(shape["points"], F.lit(i))
        return F.get(point, F.lit(0)).isNotNull() & F.get(point, F.lit(1)).isNotNull()

    return F.forall(
        "shapes",
        lambda s: F.trim(s["label"]).try_cast("int").isNotNull()
        & F.coalesce(corner(s, 0) & corner(s, 1), F.lit(False)),
    )


def _label(shape: Column, width: Column, height: Column) -> Column:
    def point(i: int, axis: int) -> Column:
        return F.get(F.get(shape["points"], F.lit(i)), F.lit(axis))

    def span(axis: int) -> tuple[Column, Column]:
        a, b = point(0, axis), point(1, axis)
        return F.least(a, b), F.greatest(a, b)

    (x1, x2), (y1, y2) = span(0), span(1)
    w, h = x2 - x1, y2 - y1
    return F.struct(
        F.trim(shape["label"]).try_cast("int").alias("cls"),
        ((x1 + w / 2) / width).alias("cx"),
        ((y1 + h / 2) / height).alias("cy"),
        (w / width).alias("w"),
        (h / height).alias("h"),
    )


def _labels(docs: DataFrame) -> DataFrame:
    size = F.col("imageWidth"), F.col("imageHeight")
    made = F.transform("shapes", lambda s: _label(s, *size))
    return rectangles(valid_images(docs)).withColumn("labels", made)


def labelme_to_yolo(docs: DataFrame) -> DataFrame:
    """One row per rectangle: stem, position, class, centre and size in 0..1."""
    rows = _labels(docs).select("stem", F.posexplode("labels").alias("label_no", "l"))
    return rows.select("stem", F.col("label_no").cast("bigint").alias("label_no"), "l.*")


def label_text(docs: DataFrame) -> DataFrame:
    """One text per image; empty when there is no rectangle."""
    line = F.transform(
        "labels",
        lambda s: F.concat_ws(
            " ", s["cls"].cast("string"), *[fixed(s[c], 6) for c in ("cx", "cy", "w", "h")]
        ),
    )
    return _labels(docs).select("stem", F.array_join(line, "\n").alias("value"))


def converted_count(docs: DataFrame) -> DataFrame:
    return _labels(docs).agg(F.count(F.lit(1)).alias("converted"))


def _stems(listing: DataFrame, extension: Column) -> DataFrame:
    return listing.where(extension).select(
        clean.file_stem(F.col("path")).alias("stem"), F.col("path")
    )


def _json_and_jpg(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON by any case of its extension, images by exactly ``jpg``."""
    ext = clean.file_ext(F.col("path"))
    docs = _stems(listing, F.lower(ext) == "json")
    images = _stems(listing, ext == "jpg")
    return docs, images.withColumnRenamed("path", "image_path")


def pair_files(listing: DataFrame) -> DataFrame:
    docs, images = _json_and_jpg(listing)
    return docs.withColumnRenamed("path", "json_path").join(images, "stem")


def unpaired_files(listing: DataFrame) -> DataFrame:
    docs, images = _json_and_jpg(listing)
    return docs.join(images, "stem", "left_anti")
