"""Timing report, lag metric and starter-list formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, times
from ..plans.tables import materialize


def timing_report(timings: DataFrame) -> DataFrame:
    """Seconds per stage and percent of the total; empty when the total is zero."""
    # One row per stage: the cross-stage total is a sum over that small table.
    stages = materialize(
        timings.groupBy("stage").agg(F.sum("seconds").alias("seconds")), "stages"
    )
    total = stages.agg(F.sum("seconds")).scalar()
    return (
        stages.withColumn("_total", total)
        .where("_total > 0")
        .select("stage", "seconds", (F.col("seconds") / F.col("_total") * 100).alias("percent"))
        .orderBy(F.col("seconds").desc(), F.col("stage").asc())
    )


def lag_metric(df: DataFrame, elapsed_s: Column, video_s: Column) -> DataFrame:
    """Add ``lag_s``, ``speed`` and the overlay text."""
    lag = times.lag_speed(elapsed_s, video_s)
    return df.withColumns(
        {"lag_s": lag["lag_s"], "speed": lag["speed"], "lag_text": lag["text"]}
    )


def format_starter_list(df: DataFrame) -> DataFrame:
    """Starter list to roster columns: full name, gender words, age band as team.

    The name is missing when either part is; rows without a bib are dropped; a
    missing age counts as 100 after its band has been chosen.
    """
    name = F.concat(F.col("First Name"), F.lit(" "), F.col("Last Name"))
    return df.where(F.col("Bib").isNotNull()).select(
        F.col("Bib").cast("int").alias("bibNumber"),
        name.alias("racerName"),
        clean.recode_gender(F.col("Gender")).alias("gender"),
        clean.default_age(F.col("Age")).alias("Age"),
        clean.age_band(F.col("Age")).alias("team"),
    )
