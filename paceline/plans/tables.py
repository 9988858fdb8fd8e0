"""Cutting lineage through tables in the cluster's shared folder.

The folder is the one the session names in ``spark.checkpoint.dir``.  A written
table survives the loss of executors, is read back column by column, and its
file size gives Catalyst a measured size: a small table is broadcast by
``spark.sql.autoBroadcastJoinThreshold`` alone, a large one is shuffled and AQE
may split its hot keys.  That is why no operator forces a broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_written: list[str] = []
_list: ContextVar[list[str]] = ContextVar("tables", default=_written)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only local sessions may fall back to /tmp."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="paceline-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _list.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, tables: list[str] | None = None) -> int:
    """Delete the tables this process has written; frames built on them end here."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    tables = _written if tables is None else tables
    gone = 0
    while tables:
        folder = path_of(tables.pop())
        gone += folder.getFileSystem(conf).delete(folder, True)
    return gone


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside on leaving, as each micro-batch must."""
    mine: list[str] = []
    before = _list.set(mine)
    try:
        yield
    finally:
        _list.reset(before)
        release(spark, mine)
