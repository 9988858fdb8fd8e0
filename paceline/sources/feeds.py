"""Readers for detections, finisher events and messages, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.results import FILE_BITS
from .files import numbered_lines

# Kafka offsets are spread over this many partitions of a topic at most.
KAFKA_PARTITIONS = 1024


def read_detections(
    spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False
) -> DataFrame:
    """Detections with track ids; class and confidence filters reach the scan."""
    return _reader(spark, streaming).schema(schemas.DETECTION).format(fmt).load(path)


def read_frame_feed(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    streaming: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = _reader(spark, streaming).schema(schemas.FRAME_FEED).format(fmt)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def read_finisher_events(
    spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """JSON lines with one finisher body each.

    A line's place tells equal bodies apart.  Read as a batch, lines also get a
    ``seq`` in their order: files by name, lines as they stand.  A stream of files
    has no order of its own and cannot number lines; equal bodies of one file should
    carry ``event_id`` or ``seq``, or come through Kafka.
    """
    reader = _reader(spark, streaming).format("text")
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file = F.col("_metadata.file_path").alias("_file")
    block = F.col("_metadata.file_block_start").alias("_block")
    if streaming:
        lines = reader.load(path).select("value", F.concat_ws(":", file, block).alias("_place"))
        lines = lines.withColumn("_seq", _positive_hash(F.concat_ws("\n", "_place", "value")))
    else:
        lines = reader.load(path).select("value", file, block, F.monotonically_increasing_id().alias("_at"))
        lines = numbered_lines(lines)
        seq = F.shiftleft("file_no", FILE_BITS) + F.col("_n")
        lines = lines.withColumns({"_place": F.concat_ws(":", "_file", "_n"), "_seq": seq})
    return parse_finisher(lines, F.col("value"))


def _positive_hash(text: Column) -> Column:
    """52 bits, below the numbers that roster rows start from."""
    return F.shiftrightunsigned(F.xxhash64(text), 12)


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Message bodies of a topic as ``value`` text (needs the Kafka package).

    With their place, for ``parse_finisher``: in order within each partition.
    """
    reader = _reader(spark, streaming).format("kafka")
    rows = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select(
        F.col("value").cast("string").alias("value"),
        F.concat_ws(":", "partition", "offset").alias("_place"),
        (F.col("offset") * KAFKA_PARTITIONS + F.col("partition")).alias("_seq"),
    )


# The body's finishTime is a number or a text; both arrive as text here, and the
# JSON quotes tell them apart.
BODY = (
    "race_id bigint, event_id string, bibNumber string, wallClockTime double, "
    "finishTime string, racerName string, gender string, team string, age string, "
    "arrival_ts double, seq bigint"
)


def parse_finisher(df: DataFrame, body: Column) -> DataFrame:
    """Finisher columns from a JSON body.

    Where the source adds ``_place`` and ``_seq``, equal bodies from two places are
    two events, and arrive in the order of ``_seq``; a body's own id and ``seq`` win.
    """
    place = [c for c in ("_place",) if c in df.columns]
    seq = F.col("_seq") if "_seq" in df.columns else _positive_hash(F.col("_body"))
    quoted = body.rlike(r'"finishTime"\s*:\s*"')
    raw = F.col("_b.finishTime")
    return df.withColumn("_body", body).withColumn("_b", F.from_json("_body", BODY)).select(
        F.coalesce("_b.race_id", F.lit(0).cast("bigint")).alias("race_id"),
        F.coalesce(F.col("_b.event_id"), F.sha2(F.concat_ws("\n", *place, "_body"), 256)).alias("event_id"),
        F.col("_b.bibNumber").alias("bib_number"),
        F.col("_b.wallClockTime").alias("wall_clock_s"),
        F.when(~quoted, raw.try_cast("double")).alias("finish_time_ms"),
        F.when(quoted, raw).alias("finish_time_str"),
        F.col("_b.racerName").alias("racer_name"),
        *[F.col(f"_b.{c}").alias(c) for c in ("gender", "team", "age")],
        F.coalesce("_b.arrival_ts", "_b.wallClockTime").alias("ts_s"),
        F.coalesce("_b.seq", seq).alias("seq"),
    )


# Wire names of the result columns.
WIRE = {
    "id": "id",
    "bib_number": "bibNumber",
    "racer_name": "racerName",
    "finish_time_ms": "finishTime",
    "rank": "rank",
    "gender": "gender",
    "team": "team",
    "age": "age",
}


def result_message(kind: str, nulls: bool = False) -> Column:
    """JSON of an add or update message from the result columns.

    With ``nulls`` empty columns are sent too, so that a cleared field reaches subscribers.
    """
    data = F.struct(*[F.col(c).alias(n) for c, n in WIRE.items()])
    keep = {"ignoreNullFields": str(not nulls).lower()}
    return F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data")), keep)


def reload_message() -> Column:
    return F.to_json(F.struct(F.lit("reload").alias("action")))


def clock_message() -> Column:
    """JSON of a clock update from the clock state columns."""
    data = F.struct(
        F.col("race_start_s").alias("raceStartTime"),
        F.col("status").alias("status"),
        F.col("offset_ms").alias("offset"),
    )
    return F.to_json(F.struct(F.lit("clock_update").alias("type"), data.alias("data")))


def add_messages(rows: DataFrame) -> DataFrame:
    return rows.select("race_id", result_message("add").alias("value"))


def edit_messages(edited: DataFrame) -> DataFrame:
    """One message per applied edit (from the ``notify`` column)."""
    kind = F.col("notify")
    text = F.when(kind == "reload", reload_message()).otherwise(result_message("update", nulls=True))
    return edited.where(kind.isNotNull()).select("race_id", text.alias("value"))


def reload_messages(changed: DataFrame) -> DataFrame:
    """One reload per race: after an upload, a delete or a reorder."""
    return changed.select("race_id").distinct().select("race_id", reload_message().alias("value"))


MESSAGE = (
    "type string, action string, data struct<id:string, bibNumber:string, racerName:string, "
    "finishTime:double, rank:bigint, gender:string, team:string, age:string, "
    "raceStartTime:double, status:string, offset:double>"
)


def from_message(text: Column) -> Column:
    """Parsed message struct; a reload has ``action`` instead of ``type``."""
    return F.from_json(text, MESSAGE)


def change_log(messages: DataFrame) -> DataFrame:
    """Change-log rows from messages with race_id, change_seq and ``value``."""
    m = messages.withColumn("_m", from_message(F.col("value")))
    fields = [
        F.col(f"_m.data.{n}").alias(c) for c, n in WIRE.items() if c not in ("id", "age")
    ]
    return m.select(
        "race_id",
        "change_seq",
        F.coalesce("_m.type", "_m.action").alias("type"),
        F.col("_m.data.id").alias("id"),
        F.struct(*fields).alias("data"),
    )


def change_feed(messages: DataFrame) -> DataFrame:
    """Feed rows for ``feed.fold_feed`` from messages with race_id, change_seq and ``value``.

    ``fields`` has what a message's data names, null values included, as text.  A clock
    update is no change of a row and is left out.
    """
    kind = "type string, action string, data map<string,string>"
    m = messages.withColumn("_m", F.from_json("value", kind))
    rows = m.select(
        "race_id",
        "change_seq",
        F.coalesce("_m.type", "_m.action").alias("type"),
        F.try_element_at("_m.data", F.lit("id")).alias("id"),
        F.map_filter("_m.data", lambda k, _: k != "id").alias("fields"),
    )
    return rows.where(F.col("type").isin("add", "update", "delete", "reload"))


def delete_messages(ids: DataFrame) -> DataFrame:
    """One message per deleted id, for feeds that are folded rather than fetched again."""
    data = F.struct(F.col("id").alias("id"))
    text = F.to_json(F.struct(F.lit("delete").alias("type"), data.alias("data")))
    return ids.select("race_id", text.alias("value"))
