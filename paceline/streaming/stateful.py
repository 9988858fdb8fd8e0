"""Streaming operators with keyed state; each has a batch twin.

State is grouped by camera or race, so parallelism is bounded by their number.
For a backlog, or a race too hot for one key, use the batch forms, which have no
such bound (``serve.official_times`` runs the batch form per micro-batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import idle
from ..operators.clock import STATE
from ..options import Options
from .processors import (
    EMISSION,
    PROCESSED,
    UPSERT,
    ClockProcessor,
    GenerationProcessor,
    IdleProcessor,
    ProcessedProcessor,
    TrackProcessor,
    UpsertProcessor,
)

DEFAULT = Options()
FEED_SHARES = 64  # keys that a race's changes spread over; each holds a share of one batch
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; set it unless the session chose one."""
    if "RocksDB" not in (spark.conf.get(STATE_PROVIDER, "") or ""):
        spark.conf.set(STATE_PROVIDER, ROCKSDB)


def _box(d: Column) -> tuple[Column, ...]:
    return tuple(d[c] for c in geo.BOX)


def feed_persons(feed: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Frame feed with ``persons``: tracked persons in the corridor, and whether they crossed."""
    w, h = F.col("width"), F.col("height")
    line = geo.finish_line(w, h, opts.geometry)
    inside = F.filter(
        "detections",
        lambda d: d["track_id"].isNotNull()
        & (d["cls"] == 0)
        & geo.in_corridor(_box(d), w, h, opts.geometry),
    )
    persons = F.transform(
        inside,
        lambda d: F.struct(
            d["track_id"].alias("track_id"),
            d["det_seq"].alias("det_seq"),
            geo.crosses(_box(d), line["m"], line["b"]).alias("crossed"),
        ),
    )
    return feed.select(
        "race_id", "camera_id", "frame_ord", "video_ms", "wall_ts",
        persons.alias("persons"), "reads",
    )


def stream_emissions(
    persons: DataFrame,
    opts: Options = DEFAULT,
    first_ord: int = 0,
    dense: bool = True,
) -> DataFrame:
    """Finisher events from a stream of frames with persons and reads.

    State is bounded: ``opts.gap_frames`` says how far ahead a frame must be for missing
    ones to be given up, ``opts.forget_frames`` after how many frames a track that is out
    of view is forgotten; the tracker must not use its number again later than that.
    None switches either off.
    """
    use_rocksdb(persons.sparkSession)
    processor = TrackProcessor(
        opts.hold_frames, opts.read_len, opts.read_conf, opts.lock_conf, first_ord, dense,
        opts.gap_frames, opts.forget_frames,
    )
    return persons.groupBy("race_id", "camera_id").transformWithStateInPandas(
        processor, outputStructType=EMISSION, outputMode="Append", timeMode="None"
    )


def stream_apply_clock(events: DataFrame, clock: DataFrame) -> DataFrame:
    """Streaming twin of ``clock.apply_clock``: both streams share one keyed operator."""
    use_rocksdb(events.sparkSession)
    # Column names must not start with an underscore: pandas rows rename those.
    log = clock.select("race_id", "ts_s", "seq", "action", "arg_ms", F.lit(0).alias("row_kind"))
    rows = events.withColumn("row_kind", F.lit(1)).unionByName(log, allowMissingColumns=True)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]
    schema = ", ".join([*fields, "race_start_s double", "status string", "offset_ms double"])
    return rows.groupBy("race_id").transformWithStateInPandas(
        ClockProcessor([*events.columns, *STATE]),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )


def stream_idle_skip(
    frames: DataFrame, after: int = DEFAULT.idle_after, drop: int = DEFAULT.idle_drop
) -> DataFrame:
    """Streaming twin of ``tracks.idle_skip``."""
    use_rocksdb(frames.sparkSession)
    return frames.groupBy("race_id", "camera_id").transformWithStateInPandas(
        IdleProcessor(idle.step_tables(after, drop), after),
        outputStructType="race_id bigint, camera_id string, frame_ord bigint",
        outputMode="Append",
        timeMode="None",
    )


def stream_processed(persons: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Streaming twin of ``race.processed_frames``: frames the idle rule lets through.

    ``frame_ord`` becomes the dense ordinal, ``source_ord`` is the frame's own number.
    Batches must come in order; numbers may be missing.
    """
    use_rocksdb(persons.sparkSession)
    # Nested rows travel as text.
    shown = F.struct("persons", "reads")
    frames = persons.select(
        "race_id", "camera_id", F.col("frame_ord").alias("source_ord"), "video_ms", "wall_ts",
        (F.size("persons") > 0).alias("has_person"), F.to_json(shown).alias("shown"),
    )
    kept = frames.groupBy("race_id", "camera_id").transformWithStateInPandas(
        ProcessedProcessor(idle.step_tables(opts.idle_after, opts.idle_drop), opts.idle_after),
        outputStructType=PROCESSED,
        outputMode="Append",
        timeMode="None",
    )
    types = [f"{c}: {persons.schema[c].dataType.simpleString()}" for c in ("persons", "reads")]
    nested = F.from_json("shown", f"struct<{', '.join(types)}>")
    return kept.withColumn("shown", nested).select("*", "shown.*").drop("shown")


def stream_race_events(feed: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Streaming twin of ``race.finisher_events`` over a frame feed with the tracks' reads."""
    return stream_emissions(stream_processed(feed_persons(feed, opts), opts), opts)


def stream_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``, as changed rows (output mode ``update``).

    A stateful aggregate: rows of a hot key are reduced before the shuffle, the state
    keeps one row per key, and a batch costs what its own keys cost.  A key met again is
    sent again, with the same row unless an earlier one came late; ``serve.first_log``
    reads the rows in force.
    """
    use_rocksdb(rows.sparkSession)
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.col(order))
    found = rows.groupBy(*keys).agg(first.alias("_first"))
    return found.select(*keys, "_first.*").select(*rows.columns)


def stream_latest(frames: DataFrame, keys: tuple[str, ...] = ("race_id", "camera_id")) -> DataFrame:
    """One slot per camera, as changed rows (output mode ``update``).

    The slot holds the frame with the highest number; a frame that comes later with a
    lower one never takes it.  ``n_seen`` counts all frames the camera has delivered.
    Each change of the slot is one frame taken, the others are dropped:
    ``serve.latest_log`` counts both.
    """
    use_rocksdb(frames.sparkSession)
    cols = [c for c in frames.columns if c not in keys]
    newest = F.max_by(F.struct(*cols), F.col("frame_ord")).alias("_slot")
    slots = frames.groupBy(*keys).agg(newest, F.count(F.lit(1)).alias("n_seen"))
    return slots.select(*keys, "_slot.*", "n_seen")


def stream_feed(log: DataFrame) -> DataFrame:
    """Streaming twin of ``feed.fold_feed``: whole rows of ids that changed, to be upserted.

    Two keyed steps: changes get the generation of their race, in shares by id that all
    see the race's reloads; then each id keeps its row, tombstone and version.  State
    grows with the ids, the work of a batch with its changes.  A change sent again has a
    version that is known, and does nothing; so does one that arrives after a later
    change of its id, or a later reload of its race.  Read with ``feed.live_table``.
    """
    use_rocksdb(log.sparkSession)
    # Maps travel as text, which keeps a given null apart from a missing field.
    text = F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields")
    rows = log.where("type IN ('add', 'update', 'delete', 'reload') AND (id IS NOT NULL OR type = 'reload')")
    rows = rows.select("race_id", "change_seq", "type", F.when(F.col("type") != "reload", F.col("id")).alias("id"), text)
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(FEED_SHARES)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(FEED_SHARES - 1))
    rows = rows.withColumn("share", F.explode(F.when(F.col("type") == "reload", every).otherwise(own)))
    stamped = rows.groupBy("race_id", "share").transformWithStateInPandas(
        GenerationProcessor(),
        outputStructType="race_id bigint, change_seq bigint, type string, id string, fields string, generation bigint",
        outputMode="Append",
        timeMode="None",
    )
    sent = stamped.groupBy("race_id", "id").transformWithStateInPandas(
        UpsertProcessor(), outputStructType=UPSERT, outputMode="Append", timeMode="None"
    )
    return sent.withColumn("fields", F.from_json("fields", "map<string,string>"))
