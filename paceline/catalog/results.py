"""Roster, edits, deletes, reorder and race clock."""

import uuid

from pyspark.sql import functions as F

from ..functions import clean, times
from ..operators import clock as clk
from ..operators import ranking
from ..operators import report
from ..operators import results as res
from ..plans.tables import shared_folder
from ..sources import feeds
from . import views as v
from .registry import query

MS = "finish_time_ms"
RESULTS_ROSTER = f"WITH {v.V_RESULTS}, {v.V_ROSTER} "


def g(col: str) -> str:
    return v.GENDER_SQL.format(col)


def strip(col: str) -> str:
    return v.STRIP_SQL.format(col)


@query(
    "q_roster_enrich",
    f"""WITH {v.V_FINISH}, {v.V_ROSTER}
SELECT f.race_id, f.id, f.bib_number, coalesce(r.racer_name, 'Racer #' || f.bib_number)
    AS racer_name, {g('r.gender')} AS gender, {strip("nullif(r.team, '')")} AS team, r.age
FROM v_finish f LEFT JOIN v_roster r
  ON f.race_id = r.race_id AND f.bib_number = r.bib_number""",
)
def roster_enrich(spark, sf):
    none = F.lit(None).cast("string")
    events = v.v_finish(spark, sf).withColumns(
        {c: none for c in ("racer_name", "gender", "team", "age")}
    )
    rows = res.enrich(events, v.v_roster(spark, sf))
    return rows.drop(MS, "seq")


# A raw roster file: orders as rows, so most bibs repeat and some fields are blank.
RAW = f"""raw AS (
  SELECT {v.RACE_SQL.format('o_custkey')} AS race_id, o_orderkey + 2 AS row_num,
         CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS bib_number,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE '  ' || o_orderpriority END AS racer_name,
         CASE WHEN o_orderkey % 2 = 0 THEN 'man' WHEN o_orderkey % 5 = 0 THEN '' END AS gender,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ' ' END AS team,
         CAST(NULL AS VARCHAR) AS age
  FROM orders),
valid AS (SELECT * FROM raw WHERE bib_number <> '' AND racer_name <> ''),
num AS (SELECT *, row_number() OVER (PARTITION BY race_id, bib_number ORDER BY row_num) AS rn
        FROM valid),
kept AS (SELECT race_id, row_num, bib_number, {strip('racer_name')} AS racer_name,
                {g('gender')} AS gender, {strip('team')} AS team, age FROM num WHERE rn = 1),
err AS (
  SELECT race_id, row_num, bib_number, 'Row ' || row_num || ': Missing bibNumber or racerName'
    AS error FROM raw WHERE NOT (coalesce(bib_number, '') <> '' AND coalesce(racer_name, '') <> '')
  UNION ALL
  SELECT race_id, row_num, bib_number,
    'Row ' || row_num || ': Duplicate bib number ' || bib_number || ' in CSV file'
  FROM num WHERE rn > 1)"""


def raw_roster(spark, sf):
    n = F.col("o_orderkey")
    return v.table(spark, sf, "orders").select(
        v.race_of(F.col("o_custkey")).alias("race_id"),
        (n + 2).alias("row_num"),
        F.when(n % 29 == 0, F.lit(""))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("bib_number"),
        F.when(n % 31 != 0, F.concat(F.lit("  "), F.col("o_orderpriority"))).alias("racer_name"),
        F.when(n % 2 == 0, F.lit("man")).when(n % 5 == 0, F.lit("")).alias("gender"),
        F.when(n % 3 == 0, F.concat(F.col("o_orderstatus"), F.lit(" "))).alias("team"),
        F.lit(None).cast("string").alias("age"),
    )


@query("q_roster_quarantine", f"WITH {RAW} SELECT * FROM err")
def roster_quarantine(spark, sf):
    return res.roster_quarantine(raw_roster(spark, sf))[1]


@query("q_roster_clean", f"WITH {RAW} SELECT * FROM kept")
def roster_clean(spark, sf):
    return res.roster_quarantine(raw_roster(spark, sf))[0]


# The same rows as three files: rows are numbered per file, and bibs repeat across files.
FILES_RAW = (
    RAW.replace("o_orderkey + 2 AS row_num", "o_orderkey // 3 + 2 AS row_num, o_orderkey % 3 AS file_no")
    .replace("ORDER BY row_num)", "ORDER BY file_no, row_num)")
    .replace("race_id, row_num, bib_number, {", "race_id, file_no, row_num, bib_number, {")
    .replace("SELECT race_id, row_num, bib_number", "SELECT race_id, file_no, row_num, bib_number")
)


def roster_files_rows(spark, sf):
    at = F.col("row_num") - 2
    rows = raw_roster(spark, sf).withColumn("file_no", at % 3)
    return rows.withColumn("row_num", F.floor(at / 3) + 2)


@query("q_roster_files", f"WITH {FILES_RAW} SELECT race_id, file_no, row_num, bib_number, racer_name FROM kept")
def roster_files(spark, sf):
    kept, _ = res.roster_quarantine(roster_files_rows(spark, sf))
    return kept.select("race_id", "file_no", "row_num", "bib_number", "racer_name")


@query("q_roster_files_errors", f"WITH {FILES_RAW} SELECT * FROM err")
def roster_files_errors(spark, sf):
    return res.roster_quarantine(roster_files_rows(spark, sf))[1]


# Results to merge into: every fourth bib is unknown to the file, which adds it anew.
MERGED = (
    f"WITH {v.V_RESULTS}, {RAW}"
    + """, base AS (SELECT * REPLACE (CASE WHEN CAST(bib_number AS BIGINT) % 4 = 1
    THEN 'Unknown-' || bib_number ELSE bib_number END AS bib_number) FROM v_results),
last AS (SELECT *, row_number() OVER (PARTITION BY race_id, bib_number ORDER BY seq DESC) AS rn,
           min(seq) OVER (PARTITION BY race_id, bib_number) AS first_seq FROM base),
col AS (SELECT * FROM last WHERE rn = 1),
merged AS (
  SELECT coalesce(c.race_id, k.race_id) AS race_id, coalesce(c.id, k.bib_number) AS id,
    coalesce(c.bib_number, k.bib_number) AS bib_number,
    coalesce(k.racer_name, c.racer_name) AS racer_name, c.finish_time_ms,
    coalesce(k.gender, c.gender) AS gender, coalesce(k.team, c.team) AS team,
    coalesce(k.age, c.age) AS age, coalesce(c.first_seq, 4503599627370496 + k.row_num) AS seq,
    CASE WHEN k.bib_number IS NULL THEN 'kept' WHEN c.id IS NULL THEN 'uploaded'
         ELSE 'updated' END AS op
  FROM col c FULL JOIN kept k ON c.race_id = k.race_id AND c.bib_number = k.bib_number) """
)


def _base(spark, sf):
    bib = F.col("bib_number")
    unread = F.when(bib.cast("bigint") % 4 == 1, clean.unknown_bib(bib)).otherwise(bib)
    return v.v_results(spark, sf).withColumn("bib_number", unread)


@query("q_roster_merge", MERGED + "SELECT * FROM merged")
def roster_merge(spark, sf):
    kept, _ = res.roster_quarantine(raw_roster(spark, sf))
    return res.merge_roster(_base(spark, sf), kept).drop("rank")


@query(
    "q_merge_report",
    MERGED
    + """, ops AS (SELECT race_id, op FROM merged UNION ALL SELECT race_id, 'error' FROM err),
n AS (SELECT race_id, count(*) FILTER (WHERE op = 'uploaded') AS uploaded,
  count(*) FILTER (WHERE op = 'updated') AS updated, count(*) FILTER (WHERE op = 'error') AS errors
  FROM ops GROUP BY race_id)
SELECT race_id, uploaded, updated, uploaded + updated AS total, errors,
  'Successfully processed roster: ' || concat_ws(', ',
    CASE WHEN uploaded > 0 THEN uploaded || ' new racers added' END,
    CASE WHEN updated > 0 THEN updated || ' existing racers updated' END) AS message
FROM n""",
)
def merge_report(spark, sf):
    return res.upload_roster(_base(spark, sf), raw_roster(spark, sf))["report"]


@query(
    "q_roster_upload",
    MERGED
    + """SELECT race_id, id, bib_number, racer_name, finish_time_ms, gender, team, age,
  row_number() OVER (PARTITION BY race_id ORDER BY finish_time_ms IS NULL,
    coalesce(nullif(finish_time_ms, 0), 'infinity'::DOUBLE),
    coalesce(TRY_CAST(bib_number AS DOUBLE), 'infinity'::DOUBLE), seq) AS seq
FROM merged""",
)
def roster_upload(spark, sf):
    return res.upload_roster(_base(spark, sf), raw_roster(spark, sf))["results"].drop("rank")


@query(
    "q_lookup_roster",
    MERGED
    + """SELECT race_id, bib_number, racer_name, gender, team, age FROM merged
WHERE finish_time_ms IS NULL""",
)
def lookup_roster(spark, sf):
    return res.upload_roster(_base(spark, sf), raw_roster(spark, sf))["lookup"]


@query(
    "q_collapse_bibs",
    f"""WITH {v.V_FINISH} SELECT race_id, bib_number, arg_max(id, seq) AS id,
  min(seq) AS seq FROM v_finish GROUP BY race_id, bib_number""",
)
def collapse_bibs(spark, sf):
    return res.collapse_bibs(v.v_finish(spark, sf)).drop(MS)


# Edits: every fourth row; the field set and the new bib follow from the id.
EDITS = (
    RESULTS_ROSTER
    + """, e AS (SELECT *, CAST(id AS BIGINT) AS n FROM v_results),
x AS (SELECT *, n % 4 = 0 AND NOT (n % 20 = 8) AS live, n % 20 = 8 AS bad,
  CASE WHEN n % 4 = 0 AND n % 20 <> 8 AND n % 3 = 0
       THEN CAST(CAST(bib_number AS BIGINT) + 21 AS VARCHAR) END AS new_bib FROM e),
j AS (SELECT x.*, r.racer_name AS rn, r.gender AS rg, r.team AS rt,
        r.bib_number IS NOT NULL AS hit
      FROM x LEFT JOIN v_roster r ON x.race_id = r.race_id AND x.new_bib = r.bib_number) """
)


def _edits(spark, sf):
    n = F.col("id").cast("bigint")
    rows = v.v_results(spark, sf).where(n % 4 == 0)
    bib = (F.col("bib_number").cast("bigint") + 21).cast("string")
    pairs = F.array(
        F.when(n % 3 == 0, F.struct(F.lit("bibNumber").alias("k"), bib.alias("v"))),
        F.when(n % 5 == 0, F.struct(F.lit("gender").alias("k"), F.lit("woman").alias("v"))),
        F.when(
            n % 20 == 8, F.struct(F.lit("finishTime").alias("k"), F.lit("nope").alias("v"))
        ),
        F.when(
            n % 16 == 4, F.struct(F.lit("finishTime").alias("k"), F.lit("2:03.5").alias("v"))
        ),
        F.when(n % 32 == 0, F.struct(F.lit("team").alias("k"), F.lit(" t ").alias("v"))),
        F.when(n % 24 == 0, F.struct(F.lit("racerName").alias("k"), F.lit("Typed").alias("v"))),
    )
    first = F.transform(F.filter(pairs, lambda p: p.isNotNull()), lambda p: p)
    # finishTime may be asked for twice; the rejected text wins.
    keep = F.filter(
        first, lambda p, i: ~((p["k"] == "finishTime") & (p["v"] != "nope") & (n % 20 == 8))
    )
    return rows.select("race_id", "id", F.map_from_entries(keep).alias("fields"))


@query(
    "q_edit_apply",
    EDITS
    + """SELECT race_id, id, coalesce(new_bib, bib_number) AS bib_number,
  CASE WHEN hit AND n % 24 = 0 THEN 'Typed' WHEN hit THEN rn
       WHEN new_bib IS NOT NULL THEN 'Racer #' || new_bib
       WHEN live AND n % 24 = 0 THEN 'Typed' ELSE racer_name END AS racer_name,
  CASE WHEN live AND n % 16 = 4 THEN CAST(123050 AS DOUBLE) ELSE finish_time_ms END
    AS finish_time_ms,
  CASE WHEN live AND n % 5 = 0 THEN 'W' WHEN hit THEN nullif(rg, '') ELSE gender END AS gender,
  CASE WHEN live AND n % 32 = 0 THEN 't' WHEN hit THEN nullif(rt, '') ELSE team END AS team,
  CASE WHEN hit THEN NULL ELSE age END AS age, seq,
  CASE WHEN bad THEN 'Invalid time format. Use MM:SS.ms' WHEN live THEN 'edited' END
    AS edit_status,
  CASE WHEN hit THEN 'reload' WHEN live THEN 'update' END AS notify
FROM j""",
)
def edit_apply(spark, sf):
    edited = res.apply_edits(v.v_results(spark, sf), _edits(spark, sf), v.v_roster(spark, sf))
    return edited.drop("rank")


@query(
    "q_delete_apply",
    f"""WITH {v.V_FINISH} SELECT race_id, id, finish_time_ms FROM v_finish WHERE seq % 6 <> 1""",
)
def delete_apply(spark, sf):
    rows = v.v_finish(spark, sf)
    gone = rows.where(F.col("seq") % 6 == 1).select("race_id", "id")
    return res.apply_deletes(rows, gone).select("race_id", "id", MS)


@query(
    "q_reorder",
    f"""WITH {v.V_FINISH} SELECT race_id, id, seq % 10 AS rank, 1000000 - seq AS seq
FROM v_finish WHERE seq % 2 = 0""",
)
def reorder(spark, sf):
    rows = v.v_finish(spark, sf).withColumn("rank", F.lit(None).cast("bigint"))
    n = F.col("seq")
    order = rows.where(n % 2 == 0).select(
        "race_id", "id", (n % 10).alias("rank"), (F.lit(1000000) - n).alias("pos")
    )
    return res.reorder(rows, order).select("race_id", "id", "rank", "seq")


@query(
    "q_quick_add",
    f"""WITH {v.V_FINISH}, n AS (SELECT race_id, count(*) AS total FROM v_finish GROUP BY race_id)
SELECT f.race_id, CASE WHEN seq % 2 = 0 THEN bib_number ELSE 'No-Bib-' || (total + 1) END
    AS bib_number,
  CASE WHEN f.race_id % 2 = 0 THEN floor((seq - 10) * CAST(1000 AS DOUBLE) + 7 + 0.5)
       ELSE CAST(7 AS DOUBLE) END AS finish_time_ms
FROM v_finish f JOIN n ON f.race_id = n.race_id""",
)
def quick_add(spark, sf):
    rows = v.v_finish(spark, sf)
    n = F.col("seq")
    typed = rows.select(
        "race_id",
        F.when(n % 2 == 0, F.col("bib_number")).otherwise(F.lit(" ")).alias("bib_number"),
        n.cast("double").alias("now_s"),
    )
    status = F.when(F.col("race_id") % 2 == 0, F.lit("running")).otherwise(F.lit("stopped"))
    state = rows.select("race_id").distinct().select(
        "race_id",
        F.lit(10.0).alias("race_start_s"),
        status.alias("status"),
        F.lit(7.0).alias("offset_ms"),
    )
    return res.quick_add(typed, state, ranking.finish_counts(rows))


# --- clock -----------------------------------------------------------------------

@query(
    "q_edit_messages",
    EDITS
    + """SELECT race_id, CASE WHEN hit THEN 'reload' ELSE 'update' END AS kind,
  CASE WHEN NOT hit THEN id END AS id FROM j WHERE live""",
)
def edit_messages(spark, sf):
    edited = res.apply_edits(v.v_results(spark, sf), _edits(spark, sf), v.v_roster(spark, sf))
    message = feeds.from_message(F.col("value"))
    kind = F.coalesce(message["type"], message["action"])
    return feeds.edit_messages(edited).select(
        "race_id", kind.alias("kind"), message["data"]["id"].alias("id")
    )


@query(
    "q_clock_log",
    """WITH t AS (SELECT o_orderkey, o_custkey % 3 AS race_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'start' ELSE 'edit' END AS action,
  CASE WHEN o_orderkey % 4 = 1 THEN o_custkey || '.5'
       WHEN o_orderkey % 4 = 2 THEN (o_custkey % 50) || ':' || (o_orderkey % 60) || '.7'
       WHEN o_orderkey % 8 = 3 THEN '1:2' END AS arg FROM orders)
SELECT race_id, o_orderkey AS seq, action, CASE o_orderkey % 4
    WHEN 1 THEN CAST(arg AS DOUBLE)
    WHEN 2 THEN CAST(split_part(arg, ':', 1) AS DOUBLE) * 60000 + (o_orderkey % 60) * 1000 + 70
  END AS arg_ms,
  CASE WHEN o_orderkey % 8 = 3 THEN 'Invalid time format. Use MM:SS.ms'
       WHEN o_orderkey % 8 = 7 THEN 'Time is required' END AS error FROM t""",
)
def clock_log(spark, sf):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    arg = (
        F.when(n % 4 == 1, F.concat(c.cast("string"), F.lit(".5")))
        .when(
            n % 4 == 2,
            F.concat(
                (c % 50).cast("string"), F.lit(":"), (n % 60).cast("string"), F.lit(".7")
            ),
        )
        .when(n % 8 == 3, F.lit("1:2"))
    )
    raw = v.table(spark, sf, "orders").select(
        (c % 3).alias("race_id"),
        n.cast("double").alias("ts_s"),
        n.alias("seq"),
        F.when(n % 4 == 0, F.lit("start")).otherwise(F.lit("edit")).alias("action"),
        arg.alias("arg"),
    )
    good, bad = clk.clock_log(raw)
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.select("race_id", "seq", "action", "arg_ms", "error")


FOLD = (
    f"WITH {v.V_CLOCK}"
    + """, w AS (SELECT *, count(*) FILTER (WHERE action IN ('start', 'reset'))
    OVER (PARTITION BY race_id ORDER BY ts_s, seq) AS gs,
  count(*) FILTER (WHERE action <> 'edit') OVER (PARTITION BY race_id ORDER BY ts_s, seq) AS gt,
  count(*) FILTER (WHERE action IN ('edit', 'reset'))
    OVER (PARTITION BY race_id ORDER BY ts_s, seq) AS go FROM v_clock),
s AS (SELECT *, max(CASE WHEN action = 'start' THEN ts_s END) OVER (PARTITION BY race_id, gs)
    AS race_start_s,
  coalesce(max(CASE WHEN action = 'start' THEN 'running' WHEN action IN ('stop', 'reset')
    THEN 'stopped' END) OVER (PARTITION BY race_id, gt), 'stopped') AS status FROM w),
f AS (SELECT *, CASE WHEN action = 'reset' THEN CAST(0 AS DOUBLE)
    WHEN action = 'edit' THEN CASE WHEN race_start_s IS NULL THEN arg_ms
      ELSE arg_ms - (ts_s - race_start_s) * 1000 END END AS o FROM s),
fold AS (SELECT race_id, ts_s, seq, race_start_s, status,
  coalesce(max(o) OVER (PARTITION BY race_id, go), 0) AS offset_ms FROM f) """
)


@query(
    "q_clock_fold",
    FOLD + """SELECT race_id, seq, round(race_start_s, 3) AS race_start_s, status,
  round(offset_ms, 3) AS offset_ms FROM fold""",
)
def clock_fold(spark, sf):
    states = clk.fold_clock(v.v_clock(spark, sf))
    return states.select(
        "race_id", "seq", F.round("race_start_s", 3).alias("race_start_s"), "status",
        F.round("offset_ms", 3).alias("offset_ms"),
    )


@query(
    "q_clock_status",
    FOLD + """SELECT race_id, round(race_start_s, 3) AS race_start_s, status,
  round(offset_ms, 3) AS offset_ms FROM
  (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ts_s DESC, seq DESC) AS rn FROM fold)
WHERE rn = 1""",
)
def clock_status(spark, sf):
    s = clk.clock_status(v.v_clock(spark, sf))
    return s.withColumns({c: F.round(c, 3) for c in ("race_start_s", "offset_ms")})


ASOF = (
    FOLD
    + f""", {v.V_ARRIVAL},
in_force AS (SELECT a.*, c.race_start_s, coalesce(c.status, 'stopped') AS status,
    coalesce(c.offset_ms, 0) AS offset_ms
  FROM v_arrival a ASOF LEFT JOIN fold c ON a.race_id = c.race_id AND a.ts_s >= c.ts_s) """
)


@query(
    "q_clock_asof",
    ASOF + """SELECT race_id, seq, round(race_start_s, 3) AS race_start_s, status,
  round(offset_ms, 3) AS offset_ms FROM in_force""",
)
def clock_asof(spark, sf):
    rows = clk.apply_clock(v.v_arrival(spark, sf), v.v_clock(spark, sf))
    return rows.select(
        "race_id", "seq", F.round("race_start_s", 3).alias("race_start_s"), "status",
        F.round("offset_ms", 3).alias("offset_ms"),
    )


def _small_races(text: str) -> str:
    return text.replace("user_id % 3 AS race_id", "event_id // 40 AS race_id")


# Races of 40 events each: few clock commands per race, many races.
@query(
    "q_clock_asof_races",
    _small_races(ASOF)
    + """SELECT race_id, seq, round(race_start_s, 3) AS race_start_s, status,
  round(offset_ms, 3) AS offset_ms FROM in_force""",
)
def clock_asof_races(spark, sf):
    race = F.floor(F.col("seq") / 40).cast("bigint")
    events = v.v_arrival(spark, sf).withColumn("race_id", race)
    rows = clk.apply_clock(events, v.v_clock(spark, sf).withColumn("race_id", race))
    return rows.select(
        "race_id", "seq", F.round("race_start_s", 3).alias("race_start_s"), "status",
        F.round("offset_ms", 3).alias("offset_ms"),
    )


TIMED = (
    ASOF
    + r""", parsed AS (SELECT *, CASE WHEN finish_time_str = 'bad' THEN CAST(-1 AS DOUBLE)
    WHEN finish_time_str IS NOT NULL THEN
      CAST(split_part(finish_time_str, ':', 1) AS DOUBLE) * 60000
      + CAST(split_part(split_part(finish_time_str, ':', 2), '.', 1) AS DOUBLE) * 1000
      + CAST(split_part(finish_time_str, '.', 2) AS DOUBLE) * 10 END AS p,
  CASE WHEN status = 'running' AND race_start_s IS NOT NULL
    THEN (wall_clock_s - race_start_s) * 1000 + offset_ms END AS official FROM in_force),
timed AS (SELECT *, CASE WHEN bib_number IS NULL THEN 'bibNumber is required'
    WHEN wall_clock_s IS NOT NULL AND official IS NULL
      THEN 'Race clock is not running. Please start the race clock first.'
    WHEN wall_clock_s IS NULL AND p < 0 THEN 'Invalid time format. Use MM:SS.ms'
    WHEN wall_clock_s IS NULL AND p IS NULL AND finish_time_ms IS NULL
      THEN 'Either wallClockTime or finishTime is required' END AS error,
  CASE WHEN wall_clock_s IS NOT NULL THEN official WHEN p IS NOT NULL THEN p
       ELSE finish_time_ms END AS ms FROM parsed) """
)


@query(
    "q_official_time",
    TIMED + """SELECT race_id, seq, CASE WHEN error IS NULL THEN round(ms, 3) END
  AS finish_time_ms, error FROM timed""",
)
def official_time(spark, sf):
    rows = clk.apply_clock(v.v_arrival(spark, sf), v.v_clock(spark, sf))
    timed = res.validate_events(rows)
    return timed.select("race_id", "seq", F.round(MS, 3).alias(MS), "error")


@query(
    "q_add_finishers",
    TIMED
    + f""", {v.V_ROSTER}, ok AS (SELECT t.race_id, t.bib_number, t.seq, ms,
    coalesce(r.racer_name, 'Racer #' || t.bib_number) AS racer_name,
    {g('r.gender')} AS gender FROM timed t LEFT JOIN v_roster r
    ON t.race_id = r.race_id AND t.bib_number = r.bib_number WHERE error IS NULL)
SELECT race_id, bib_number, seq, round(ms, 3) AS finish_time_ms, racer_name, gender,
  row_number() OVER (PARTITION BY race_id ORDER BY round(ms, 6), seq) AS rank FROM ok""",
)
def add_finishers(spark, sf):
    none = spark.createDataFrame([], "race_id bigint").select(
        "race_id",
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("id", "string"), ("bib_number", "string"), ("racer_name", "string"),
            (MS, "double"), ("rank", "bigint"), ("gender", "string"), ("team", "string"),
            ("age", "string"), ("seq", "bigint"))],
    )
    ranked, _ = res.add_finishers(
        none, v.v_arrival(spark, sf), v.v_clock(spark, sf), v.v_roster(spark, sf)
    )
    return ranked.select(
        "race_id", "bib_number", "seq", F.round(MS, 3).alias(MS), "racer_name", "gender", "rank"
    )


# --- starter list and reports ----------------------------------------------------------


@query(
    "q_starter_list",
    """WITH s AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END
    AS bib, c_mktsegment AS f, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_name END AS l,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS g,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS a FROM customer)
SELECT CAST(bib AS INTEGER) AS "bibNumber", f || ' ' || l AS "racerName",
  CASE g WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE g END AS gender,
  CAST(coalesce(a, 100) AS INTEGER) AS "Age",
  CASE WHEN a <= 9 THEN 'Age 7 - 9' WHEN a <= 12 THEN 'Age 10 - 12'
    WHEN a <= 15 THEN 'Age 13 - 15' WHEN a <= 19 THEN 'Age 16 - 18' ELSE 'Age 19 and up' END
    AS team
FROM s WHERE bib IS NOT NULL""",
)
def starter_list(spark, sf):
    key = F.col("c_custkey")
    rows = v.table(spark, sf, "customer").select(
        F.when(key % 9 != 0, key.cast("double")).alias("Bib"),
        F.col("c_mktsegment").alias("First Name"),
        F.when(key % 8 != 0, F.col("c_name")).alias("Last Name"),
        F.when(key % 3 == 0, F.lit("M")).when(key % 3 == 1, F.lit("F")).otherwise(F.lit("X"))
        .alias("Gender"),
        F.nullif(F.col("c_nationkey").cast("double"), F.lit(0.0)).alias("Age"),
    )
    return report.format_starter_list(rows)


@query(
    "q_timing_report",
    f"""WITH {v.V_STAGE}, t AS (SELECT stage, sum(seconds) AS s FROM v_stage GROUP BY stage)
SELECT stage, round(s, 4) AS seconds, round(s / sum(s) OVER () * 100, 6) AS percent FROM t""",
)
def timing_report(spark, sf):
    r = report.timing_report(v.v_stage(spark, sf))
    return r.select(
        "stage", F.round("seconds", 4).alias("seconds"), F.round("percent", 6).alias("percent")
    )


@query(
    "q_lag_speed",
    """WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) AS e,
  o_totalprice / 1000 AS v FROM orders)
SELECT o_orderkey, CASE WHEN e > 0 THEN e - v END AS lag_s,
  CASE WHEN e > 0 THEN v / e END AS speed, 
  CASE WHEN e > 0 THEN printf('Lag: %.1fs (Speed: %.1fx)', e - v, v / e)
       ELSE 'Lag: Calculating...' END AS lag_text FROM x""",
)
def lag_speed(spark, sf):
    orders = v.table(spark, sf, "orders")
    elapsed = (F.col("o_orderkey") % 50).cast("double")
    rows = report.lag_metric(orders, elapsed, F.col("o_totalprice") / 1000)
    return rows.select(
        "o_orderkey",
        "lag_s",
        "speed",
        "lag_text",
    )


@query(
    "q_placeholders",
    """SELECT o_orderkey, 'Unknown-' || o_orderkey AS unknown, 'Racer ' || o_orderkey AS track_name,
  CASE WHEN o_custkey % 2 = 0 THEN 'Unknown Runner' ELSE o_orderpriority END AS runner,
  CASE o_custkey % 4 WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal
FROM orders""",
)
def placeholders(spark, sf):
    key = F.col("o_orderkey")
    name = F.when(F.col("o_custkey") % 2 == 1, F.col("o_orderpriority")).otherwise(F.lit(""))
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        clean.unknown_bib(key).alias("unknown"),
        clean.track_name(key).alias("track_name"),
        clean.runner_name(name).alias("runner"),
        clean.medal(F.col("o_custkey") % 4).alias("medal"),
    )


@query(
    "q_clock_text",
    """SELECT event_id, strftime(ts, '%I:%M:%S %p') AS wall FROM events""",
)
def clock_text(spark, sf):
    wall = times.fmt_clock(F.col("ts"))
    return v.table(spark, sf, "events").select("event_id", wall.alias("wall"))


@query(
    "q_finisher_id",
    "SELECT o_orderkey, sha256(o_custkey || '|' || o_orderkey) AS id FROM orders",
)
def finisher_id(spark, sf):
    made = clean.finisher_id(F.col("o_custkey"), F.col("o_orderkey"))
    return v.table(spark, sf, "orders").select("o_orderkey", made.alias("id"))


# Bodies as posted, many of them equal; each line is an event of its own.
@query(
    "q_intake",
    """SELECT CAST(user_id % 50 AS VARCHAR) AS bib_number,
  CAST(user_id % 3 * 1000 AS DOUBLE) AS finish_time_ms, count(*) AS events,
  count(*) AS ids, count(*) AS places, min(CAST(user_id % 3 AS VARCHAR)) AS team
FROM events GROUP BY user_id % 50, user_id % 3""",
)
def intake(spark, sf):
    u = F.col("user_id")
    body = F.struct(
        (u % 50).cast("string").alias("bibNumber"), (u % 3 * 1000).cast("double").alias("finishTime"),
        (u % 3).cast("string").alias("team"),
    )
    path = f"{shared_folder(spark)}/intake-{uuid.uuid4().hex}"
    v.table(spark, sf, "events").select(F.to_json(body).alias("value")).write.text(path)
    rows = feeds.read_finisher_events(spark, path)
    return rows.groupBy("bib_number", "finish_time_ms").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"),
        F.countDistinct("seq").alias("places"), F.min("team").alias("team"),
    )
