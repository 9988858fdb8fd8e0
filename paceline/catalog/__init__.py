"""Registered queries over the stand-in tables, with their SQL counterparts."""

from pyspark.sql import DataFrame, SparkSession

from . import detections as _detections  # noqa: F401  (registers its queries)
from . import race as _race  # noqa: F401  (registers its queries)
from . import ranking as _ranking
from . import replay as _replay  # noqa: F401  (registers its queries)
from . import results as _results  # noqa: F401  (registers its queries)
from . import streams as _streams  # noqa: F401
from .registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking.leaderboard(spark, sf_dir)
