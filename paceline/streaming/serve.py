"""Micro-batch writers: tables by batch, snapshots, change feed and hooks.

Tables are folders with one ``batch_id`` partition per micro-batch.  A retried
batch overwrites its own partition and reads only earlier ones, so every writer
is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from ..operators import boards, clock, ranking, results
from ..plans.tables import materialize, scope
from ..schemas import RESULT, RESULT_COLUMNS
from ..sources import feeds, sinks

Batch = Callable[[DataFrame, int], None]


SHUFFLE = "spark.sql.shuffle.partitions"


@contextmanager
def state_partitions(spark: SparkSession, most: int | None = None) -> Iterator[None]:
    """Start queries with no more state partitions than cores.

    A query fixes its number of state stores when it first starts.  Keys are
    cameras or races, so stores beyond the cores would be opened and committed
    in every batch for nothing.
    """
    before = spark.conf.get(SHUFFLE)
    most = most or spark.sparkContext.defaultParallelism
    spark.conf.set(SHUFFLE, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE, before)


def run_available(
    df: DataFrame, writer: Batch, checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    """Process everything available now, batch by batch, and return the query."""
    stream = (
        df.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(writer)
    )
    with state_partitions(df.sparkSession):
        return stream.start()


def on_finisher(fn: Batch) -> Batch:
    """Hook called with each non-empty batch of finishers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            fn(batch, batch_id)

    return write


def _earlier(spark: SparkSession, path: str, schema: StructType | str, batch_id: int) -> DataFrame:
    """Rows of the batches before this one (none when the folder is still missing)."""
    empty = spark.createDataFrame([], schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return empty
    full = StructType(empty.schema.fields).add("batch_id", LongType())
    rows = spark.read.schema(full).parquet(path)
    return rows.where(F.col("batch_id") < batch_id).drop("batch_id")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def table_writer(path: str) -> Batch:
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, path, batch_id)

    return write


def latest_only(batch: DataFrame, key: str = "camera_id", order: str = "frame_ord") -> DataFrame:
    """Newest row per camera of a micro-batch; older ones are dropped."""
    cols = [c for c in batch.columns if c not in ("race_id", key)]
    newest = F.max_by(F.struct(*cols), F.col(order)).alias("_n")
    return batch.groupBy("race_id", key).agg(newest).select("race_id", key, "_n.*")


def first_arrival_writer(path: str) -> Batch:
    """Keep the first row per bib: first within the batch, then unknown so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        first = boards.first_arrival(batch)
        known = _earlier(batch.sparkSession, path, batch.schema, batch_id)
        new = first.join(known.select("race_id", "bib_number"), boards.BIB, "left_anti")
        _write_batch(new, path, batch_id)

    return write


def first_log(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows in force after all batches of ``stateful.stream_first``."""
    first = F.min_by(F.struct(*[c for c in log.columns if c not in keys]), F.col(order))
    return log.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*log.columns)


def latest_log(log: DataFrame, keys: tuple[str, ...] = ("race_id", "camera_id")) -> DataFrame:
    """Slots after all batches of ``stateful.stream_latest``, with frames taken and dropped.

    The log has one row per camera and batch at most, so counting its distinct frames
    is a count of batches.
    """
    cols = [c for c in log.columns if c not in (*keys, "n_seen")]
    slot = F.max_by(F.struct(*cols), F.struct("n_seen", "frame_ord")).alias("_slot")
    counts = F.count_distinct("frame_ord").alias("n_taken"), F.max("n_seen").alias("n_seen")
    rows = log.groupBy(*keys).agg(slot, *counts)
    return rows.select(*keys, "_slot.*", "n_taken", (F.col("n_seen") - F.col("n_taken")).alias("n_dropped"))


def official_times(clock_log: Callable[[], DataFrame], fn: Batch) -> Batch:
    """As-of clock join of each batch against the clock log as it stands.

    The batch form sorts over the cluster, so one hot race is no bottleneck.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with scope(batch.sparkSession):
            fn(results.validate_events(clock.apply_clock(batch, clock_log())), batch_id)

    return write


def snapshot_sink(path: str) -> Batch:
    """Leaderboard of the finished rows, rewritten after each change."""

    def write(table: DataFrame, batch_id: int) -> None:
        with scope(table.sparkSession):
            sinks.write_leaderboard(ranking.finished(table), path)

    return write


def versioned_board(path: str, board_path: str, keep: int = 3) -> Batch:
    """Result rows by batch, and a leaderboard version per batch that has rows.

    Unlike ``snapshot_sink`` nothing is overwritten: ``sinks.read_leaderboard`` finds a
    whole board at any time, and ``keep`` bounds the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scope(spark):
            _write_batch(batch.select(*RESULT_COLUMNS), path, batch_id)
            table = ranking.finished(_earlier(spark, path, RESULT, batch_id + 1))
            publish = lambda to: sinks.write_leaderboard(table, to)
            sinks.write_version(spark, board_path, batch_id, publish, keep)

    return on_finisher(write)


def results_writer(
    path: str,
    roster: Callable[[], DataFrame],
    snapshot: str | None = None,
    changes: str | None = None,
) -> Batch:
    """Validated events to enriched result rows, then snapshot and change feed.

    Rank is not stored: it is derived from the table on reading.
    """

    def write(timed: DataFrame, batch_id: int) -> None:
        with scope(timed.sparkSession):
            serve(timed, batch_id)

    def serve(timed: DataFrame, batch_id: int) -> None:
        spark = timed.sparkSession
        kept = materialize(timed, "events")
        valid, rejected = results.split_valid(kept)
        rows = results.enrich(valid, roster()).withColumns(
            {
                "id": results.clean.finisher_id(F.col("race_id"), F.col("event_id"), F.col("seq")),
                "rank": F.lit(None).cast("bigint"),
            }
        )
        rows = materialize(rows.select(*RESULT_COLUMNS), "new_rows")
        _write_batch(rows, f"{path}/results", batch_id)
        _write_batch(rejected, f"{path}/rejected", batch_id)
        if changes is not None:
            sinks.write_changes(feeds.add_messages(rows), f"{changes}/batch_id={batch_id}")
        if snapshot is not None:
            table = _earlier(spark, f"{path}/results", RESULT, batch_id + 1)
            sinks.write_leaderboard(table, snapshot)

    return write


def track_board_writer(path: str, board_path: str) -> Batch:
    """Track leaderboard, rewritten with every batch of crossed tracks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, path, batch_id)
        seen = _earlier(batch.sparkSession, path, batch.schema, batch_id + 1)
        order = [F.col("finish_time_ms").asc(), F.col("track_id").asc()]
        with scope(batch.sparkSession):
            board = ranking.display_position(seen, order, ["race_id", "camera_id"])
            board.write.mode("overwrite").parquet(board_path)

    return write


def folded(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Table after all batches of a change log kept by ``table_writer``."""
    return boards.fold_changes(_earlier(spark, path, schema, 1 << 62))
