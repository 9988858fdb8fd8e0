"""Bounded training samples and held-out marks, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize


def held_out(parts: int, part: int) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(True))


def classes(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` ids of each value of ``label``, the same ids on every run.

    A frequent label is thinned by its count first, to half as many again as are
    wanted, so that no task gathers all rows of a label.
    """
    few = rows.select("doc_id", label).where(f"doc_id IS NOT NULL AND {label} IS NOT NULL")
    # Written, so that Catalyst knows it to be small and leaves the rows where they are.
    counts = materialize(few.groupBy(label).agg(F.count(F.lit(1)).alias("_all")), "counts")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = few.join(counts, label).where((F.col("_all") <= 2 * per_class) | (place * F.col("_all") < 1.5 * per_class))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    few = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class)
    return few.select("doc_id", label)


def sample(documents: DataFrame, ids: DataFrame, label: str, longest: int) -> tuple[list[str], list]:
    """Texts and labels of sampled ids, texts of over ``longest`` characters left out.

    The ids are written first: a bounded table that Catalyst can see to be small.
    """
    ids = materialize(ids, "sample")
    texts = documents.select("doc_id", "text").where((F.length("text") <= longest) & (F.length("text") > 0))
    rows = texts.join(ids, "doc_id").select("text", label, "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r[label] for r in rows]
