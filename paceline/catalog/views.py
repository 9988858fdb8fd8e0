"""Stand-in views: race-timing tables projected from the general test tables.

Each view exists twice, as a DataFrame and as a SQL common table expression, and
both compute the same rows.  Race 0 holds over a third of the finishers and of
the roster on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    micros = (F.date_part(F.lit("SECONDS"), ts) * 1000000).cast("bigint")
    minutes = F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60000000 + micros


def race_of(c: Column) -> Column:
    return F.when(c % 3 == 0, F.lit(0)).otherwise(c % 7).cast("bigint")


def key_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


RACE_SQL = "CASE WHEN {0} % 3 = 0 THEN 0 ELSE {0} % 7 END"
K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def v_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish rows from orders, with zero and missing times mixed in."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t = (
        F.when(key % 97 == 0, F.lit(0.0))
        .when(key % 89 == 0, F.lit(None))
        .otherwise(F.col("o_totalprice"))
    )
    return o.select(
        race_of(F.col("o_custkey")).alias("race_id"),
        key.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("bib_number"),
        t.cast("double").alias("finish_time_ms"),
        key.alias("seq"),
    )


V_FINISH = f"""v_finish AS (
  SELECT {RACE_SQL.format('o_custkey')} AS race_id,
         CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS bib_number,
         CASE WHEN o_orderkey % 97 = 0 THEN 0.0 WHEN o_orderkey % 89 = 0 THEN NULL
              ELSE o_totalprice END AS finish_time_ms,
         o_orderkey AS seq
  FROM orders)"""


def v_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster from customers; every fifth bib is foreign, every eleventh has no team."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    gender = (
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("male"))
        .when(F.col("c_nationkey") % 3 == 1, F.lit("F"))
        .otherwise(F.lit("x"))
    )
    team = F.when(key % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t"))
    )
    bib = F.when(key % 5 == 0, F.concat(F.lit("G"), key.cast("string")))
    return c.select(
        race_of(key).alias("race_id"),
        bib.otherwise(key.cast("string")).alias("bib_number"),
        F.col("c_name").alias("racer_name"),
        gender.alias("gender"),
        team.alias("team"),
        F.col("c_nationkey").cast("string").alias("age"),
    )


V_ROSTER = f"""v_roster AS (
  SELECT {RACE_SQL.format('c_custkey')} AS race_id,
         CASE WHEN c_custkey % 5 = 0 THEN 'G' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END
           AS bib_number,
         c_name AS racer_name,
         CASE c_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'F' ELSE 'x' END AS gender,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '  ' || c_mktsegment || chr(9) END AS team,
         CAST(c_nationkey AS VARCHAR) AS age
  FROM customer)"""

# Normalised gender and trimmed team, as the operators produce them.
GENDER_SQL = """CASE WHEN upper({0}) IN ('M','MALE','MAN') THEN 'M'
  WHEN upper({0}) IN ('W','F','FEMALE','WOMAN') THEN 'W' ELSE nullif(upper({0}),'') END"""
STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def v_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish rows that already carry runner columns (the whole customer table)."""
    c = table(spark, sf_dir, "customer")
    runner = c.select(
        F.col("c_custkey").cast("string").alias("bib_number"),
        F.col("c_name").alias("racer_name"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("M"))
        .when(F.col("c_nationkey") % 3 == 1, F.lit("W"))
        .alias("gender"),
        F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).alias(
            "team"
        ),
        F.col("c_nationkey").cast("string").alias("age"),
    )
    return (
        v_finish(spark, sf_dir)
        .join(runner, "bib_number")
        .withColumn("rank", F.lit(None).cast("bigint"))
        .select(
            "race_id", "id", "bib_number", "racer_name", "finish_time_ms",
            "rank", "gender", "team", "age", "seq",
        )
    )


V_RESULTS = (
    V_FINISH
    + """, v_results AS (
  SELECT f.race_id, f.id, f.bib_number, c.c_name AS racer_name, f.finish_time_ms,
         CAST(NULL AS BIGINT) AS rank,
         CASE c.c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'W' END AS gender,
         CASE WHEN c.c_custkey % 11 <> 0 THEN ' ' || c.c_mktsegment END AS team,
         CAST(c.c_nationkey AS VARCHAR) AS age, f.seq
  FROM v_finish f JOIN customer c ON f.bib_number = CAST(c.c_custkey AS VARCHAR))"""
)


def v_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from events: 20 per frame at any scale, three cameras.

    A track slot lives for 60 frames and moves toward the finish line; popular
    slots stay in view, rare ones come and go.
    """
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    block = F.floor(n / 20).cast("bigint")
    e = e.select(
        (block % 3 % 2).alias("race_id"),
        F.concat(F.lit("cam"), (block % 3).cast("string")).alias("camera_id"),
        F.floor(block / 3).cast("bigint").alias("frame_ord"),
        (n % 20).cast("int").alias("det_seq"),
        (F.col("event_type") == "error").cast("int").alias("cls"),
        (F.col("user_id") % 16).alias("u"),
        key_k(F.col("props")).alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    slot = (
        F.when(F.col("u") < 8, F.lit(0))
        .when(F.col("u") < 12, F.lit(1))
        .when(F.col("u") < 14, F.lit(2))
        .otherwise(F.col("u") - 11)
    )
    at, cls = F.col("frame_ord"), F.col("cls")
    x1 = F.lit(500) + F.col("k") * 10 + cls * 45
    y1 = F.lit(380) + at % 60 * 5 + F.col("v") % 200 + cls * 90
    return e.select(
        "race_id",
        "camera_id",
        "frame_ord",
        (at * 40.0).alias("video_ms"),
        (at * 0.04 + 1000.0).alias("wall_ts"),
        "det_seq",
        (F.floor(at / 60) * 5 + slot).cast("bigint").alias("track_id"),
        "cls",
        (F.lit(50) + F.floor(F.col("k") / 2)).cast("double").alias("conf100"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        (x1 + F.when(cls == 1, 30).otherwise(120)).cast("double").alias("x2"),
        (y1 + F.when(cls == 1, 20).otherwise(260)).cast("double").alias("y2"),
    ).withColumn("conf", F.col("conf100") / 100).drop("conf100")


V_DET = f"""v_det0 AS (
  SELECT (event_id // 20) % 3 % 2 AS race_id, 'cam' || ((event_id // 20) % 3) AS camera_id,
         (event_id // 20) // 3 AS frame_ord, CAST(event_id % 20 AS INTEGER) AS det_seq,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS cls, user_id % 16 AS u,
         {K_SQL} AS k, CAST(round(value * 100) AS BIGINT) AS v
  FROM events),
v_det AS (
  SELECT race_id, camera_id, frame_ord, frame_ord * CAST(40.0 AS DOUBLE) AS video_ms,
         frame_ord * CAST(0.04 AS DOUBLE) + CAST(1000.0 AS DOUBLE) AS wall_ts, det_seq,
         frame_ord // 60 * 5 + CASE WHEN u < 8 THEN 0 WHEN u < 12 THEN 1 WHEN u < 14 THEN 2
                                    ELSE u - 11 END AS track_id,
         cls, CAST(50 + k // 2 AS DOUBLE) / 100 AS conf,
         CAST(500 + k * 10 + cls * 45 AS DOUBLE) AS x1,
         CAST(380 + frame_ord % 60 * 5 + v % 200 + cls * 90 AS DOUBLE) AS y1,
         CAST(500 + k * 10 + cls * 45 + CASE cls WHEN 1 THEN 30 ELSE 120 END AS DOUBLE) AS x2,
         CAST(380 + frame_ord % 60 * 5 + v % 200 + cls * 90
              + CASE cls WHEN 1 THEN 20 ELSE 260 END AS DOUBLE) AS y2
  FROM v_det0)"""


def v_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event, about one in ten with a person."""
    e = table(spark, sf_dir, "events")
    has = (F.col("event_type") == "error") & (key_k(F.col("props")) < 50)
    return e.select(
        F.lit(0).cast("bigint").alias("race_id"),
        F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string")).alias("camera_id"),
        F.col("event_id").alias("frame_ord"),
        has.alias("has_person"),
    )


V_IDLE = f"""v_idle AS (
  SELECT CAST(0 AS BIGINT) AS race_id, 'cam' || (user_id % 4) AS camera_id,
         event_id AS frame_ord, event_type = 'error' AND {K_SQL} < 50 AS has_person
  FROM events)"""


def v_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR reads from line items: track = order, bib = supplier, conf = discount."""
    conf = F.round(F.col("l_discount") * 1000).cast("bigint") / 100
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 2).alias("race_id"),
        F.lit("cam0").alias("camera_id"),
        F.col("l_orderkey").alias("track_id"),
        F.col("l_linenumber").cast("bigint").alias("frame_ord"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("det_seq"),
        F.col("l_suppkey").cast("string").alias("bib_read"),
        conf.alias("ocr_conf"),
        F.lit(0.9).alias("yolo_conf"),
    )


V_READ = """v_read AS (
  SELECT l_orderkey % 2 AS race_id, 'cam0' AS camera_id, l_orderkey AS track_id,
         CAST(l_linenumber AS BIGINT) AS frame_ord,
         l_partkey * 1000000 + l_suppkey AS det_seq, CAST(l_suppkey AS VARCHAR) AS bib_read,
         CAST(round(l_discount * 1000) AS BIGINT) AS conf100
  FROM lineitem)"""


def v_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock log from events: signups start, errors stop, purchases edit or reset."""
    e, k = table(spark, sf_dir, "events"), key_k(F.col("props"))
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", F.lit("start"))
        .when(kind == "error", F.lit("stop"))
        .when((kind == "purchase") & (k < 40), F.lit("edit"))
        .when((kind == "purchase") & (k >= 90), F.lit("reset"))
    )
    return e.select(
        (F.col("user_id") % 3).alias("race_id"),
        (epoch_us(F.col("ts")) / 1000000).alias("ts_s"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        (k * 1000).cast("double").alias("arg_ms"),
    ).where(F.col("action").isNotNull())


V_CLOCK = f"""v_clock AS (
  SELECT * FROM (
    SELECT user_id % 3 AS race_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts_s,
           event_id AS seq,
           CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' THEN 'stop'
                WHEN event_type = 'purchase' AND {K_SQL} < 40 THEN 'edit'
                WHEN event_type = 'purchase' AND {K_SQL} >= 90 THEN 'reset' END AS action,
           CAST({K_SQL} * 1000 AS DOUBLE) AS arg_ms
    FROM events) WHERE action IS NOT NULL)"""


def v_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finisher events from views and clicks, some without a bib or a time."""
    e, k = table(spark, sf_dir, "events"), key_k(F.col("props"))
    wall = epoch_us(F.col("ts")) / 1000000
    n = F.col("event_id")
    kind = n % 5
    text = F.when(k % 7 == 0, F.lit("bad")).otherwise(
        F.concat(
            k.cast("string"), F.lit(":"), (n % 60).cast("string"),
            F.lit("."), (k % 10).cast("string"),
        )
    )
    return e.where(F.col("event_type").isin("view", "click")).select(
        (F.col("user_id") % 3).alias("race_id"),
        n.cast("string").alias("event_id"),
        F.when(n % 31 != 0, F.col("user_id").cast("string")).alias("bib_number"),
        F.when(kind < 3, wall).alias("wall_clock_s"),
        F.when(kind == 2, F.lit(5.0)).alias("finish_time_ms"),
        F.when(kind == 3, text).alias("finish_time_str"),
        F.lit(None).cast("string").alias("racer_name"),
        F.lit(None).cast("string").alias("gender"),
        F.lit(None).cast("string").alias("team"),
        F.lit(None).cast("string").alias("age"),
        wall.alias("ts_s"),
        n.alias("seq"),
    )


V_ARRIVAL = f"""v_arrival AS (
  SELECT user_id % 3 AS race_id, CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_id % 31 <> 0 THEN CAST(user_id AS VARCHAR) END AS bib_number,
         CASE WHEN event_id % 5 < 3 THEN CAST(epoch_us(ts) AS DOUBLE) / 1000000 END
           AS wall_clock_s,
         CASE WHEN event_id % 5 = 2 THEN CAST(5.0 AS DOUBLE) END AS finish_time_ms,
         CASE WHEN event_id % 5 = 3 THEN CASE WHEN {K_SQL} % 7 = 0 THEN 'bad'
              ELSE {K_SQL} || ':' || (event_id % 60) || '.' || ({K_SQL} % 10) END END
           AS finish_time_str,
         CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts_s, event_id AS seq
  FROM events WHERE event_type IN ('view', 'click'))"""


def v_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("seconds")
    )


V_STAGE = "v_stage AS (SELECT event_type AS stage, value AS seconds FROM events)"


def v_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing: labels as JSON (every third upper case), documents as images."""
    lab = table(spark, sf_dir, "labels").select(
        F.concat(
            F.lit("/shots/doc"), F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(".JSON")).otherwise(F.lit(".json")),
        ).alias("path")
    )
    doc = table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("/shots/doc"), F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 10 == 0, F.lit(".JPG")).otherwise(F.lit(".jpg")),
        ).alias("path")
    )
    return lab.unionByName(doc)


V_LISTING = """v_listing AS (
  SELECT '/shots/doc' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.JSON' ELSE '.json' END AS path
  FROM labels UNION ALL
  SELECT '/shots/doc' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.JPG' ELSE '.jpg' END
  FROM documents)"""


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation documents from parts: three shapes each, some invalid."""
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")

    def shape(label: Column, kind: Column, x1, y1, x2, y2) -> Column:
        pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
        return F.struct(
            label.alias("label"), kind.alias("shape_type"),
            F.array(pt(x1, y1), pt(x2, y2)).alias("points"),
        )

    rect = F.lit("rectangle")
    one = F.when(key % 23 == 0, F.lit("bib")).otherwise((key % 2).cast("string"))
    two = F.when(key % 4 == 0, F.lit("polygon")).otherwise(rect)
    return p.select(
        F.concat(F.lit("img"), key.cast("string")).alias("stem"),
        F.when(key % 19 == 0, F.lit(0.0)).otherwise(F.lit(640.0)).alias("imageWidth"),
        F.lit(512.0).alias("imageHeight"),
        F.array(
            shape(one, F.when(key % 5 == 0, F.lit("circle")).otherwise(rect),
                  size + 10, size + 20, size + 74, size + 52),
            shape(F.lit("1"), two, size * 2 + 100, F.lit(200), size, size + 5),
        ).alias("shapes"),
    )


V_DOCS = """v_docs AS (
  SELECT 'img' || p_partkey AS stem, p_partkey AS k, CAST(p_size AS DOUBLE) AS s,
         CASE WHEN p_partkey % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(640 AS DOUBLE) END AS iw,
         CAST(512 AS DOUBLE) AS ih
  FROM part),
v_good AS (
  SELECT * FROM v_docs WHERE iw > 0 AND NOT (k % 23 = 0 AND k % 5 <> 0)),
v_shape AS (
  SELECT stem, iw, ih, 0 AS pos, CAST(k % 2 AS INTEGER) AS cls,
         s + 10 AS x1, s + 20 AS y1, s + 74 AS x2, s + 52 AS y2
  FROM v_good WHERE k % 5 <> 0
  UNION ALL
  SELECT stem, iw, ih, 1 AS pos, 1 AS cls,
         s AS x1, least(CAST(200 AS DOUBLE), s + 5) AS y1, s * 2 + 100 AS x2,
         greatest(CAST(200 AS DOUBLE), s + 5) AS y2
  FROM v_good WHERE k % 4 <> 0),
v_label AS (
  SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY pos) - 1 AS label_no, cls,
         (x1 + (x2 - x1) / 2) / iw AS cx, (y1 + (y2 - y1) / 2) / ih AS cy,
         (x2 - x1) / iw AS w, (y2 - y1) / ih AS h
  FROM v_shape)"""


def v_race_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_det`` as a live camera delivers it: every eighth frame number is missing, and
    in twelve frames of 97 nothing but other objects (class 2) is in view."""
    at = F.col("frame_ord")
    return v_det(spark, sf_dir).withColumns(
        {
            "frame_ord": at + F.floor(at / 7).cast("bigint"),
            "cls": F.when((at % 97).between(14, 25), F.lit(2)).otherwise(F.col("cls")),
        }
    )


V_RACE_DET = (
    V_DET.replace("v_det AS (", "v_all AS (")
    + """, v_race_det AS (SELECT * REPLACE (frame_ord + frame_ord // 7 AS frame_ord,
    CASE WHEN frame_ord % 97 BETWEEN 14 AND 25 THEN 2 ELSE cls END AS cls) FROM v_all)"""
)


def v_crop_read(det: DataFrame) -> DataFrame:
    """Reading of each bib box, from its place in the frame."""
    n = F.col("det_seq")
    return det.where(F.col("cls") == 1).select(
        "race_id", "camera_id", "frame_ord", "det_seq",
        (F.lit(10) + F.floor(n / 4)).cast("string").alias("bib_read"),
        ((F.lit(40) + (F.col("frame_ord") + n) % 61) / 100).alias("ocr_conf"),
    )


def v_race_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock commands of ``v_clock``, given while the event's frame was taken."""
    block = F.floor(F.col("seq") / 20).cast("bigint")
    return v_clock(spark, sf_dir).withColumns(
        {
            "race_id": block % 3 % 2,
            "ts_s": F.floor(block / 3).cast("bigint") * 0.04 + 1000.0,
        }
    )


V_RACE_CLOCK = (
    V_CLOCK.replace("v_clock AS (", "v_log AS (")
    + """, v_clock AS (SELECT (seq // 20) % 3 % 2 AS race_id,
    (seq // 20) // 3 * CAST(0.04 AS DOUBLE) + CAST(1000.0 AS DOUBLE) AS ts_s,
    seq, action, arg_ms FROM v_log)"""
)
