"""The command log: every kind of command, replayed over the results table."""

from pyspark.sql import functions as F

from ..operators import commands
from . import views as v
from .registry import query
from .results import g, strip

# A stand-in log from orders with odd keys; even keys are the results at its start.
# Blocks of 64 keys share a race, and commands aim at rows of their own block.  The log
# has four phases: a reorder ends the first and the third, an upload the second.
PHASE = 1 << 32
RACE = v.RACE_SQL.format("(o_orderkey // 64)")
LOG = f"""cmd AS (
  SELECT *, o_orderkey AS k, {RACE} AS race_id, (o_orderkey // 2) % 4 * {PHASE} + o_orderkey AS cmd_seq,
    CASE (o_orderkey // 8) % 8 WHEN 0 THEN 'add' WHEN 1 THEN 'add' WHEN 2 THEN 'quick_add' WHEN 6 THEN 'delete'
      WHEN 7 THEN 'clock' ELSE 'edit' END AS type,
    o_orderkey // 32 * 32 + 2 * ((o_orderkey // 2) % 2) AS target
  FROM orders WHERE o_orderkey % 2 = 1),
log AS (
  SELECT race_id, cmd_seq, type, k, CAST(cmd_seq AS DOUBLE) / 1000 AS ts_s,
    CASE type WHEN 'add' THEN 'a' || k WHEN 'quick_add' THEN 'q' || k WHEN 'delete' THEN CAST(target + 4 AS VARCHAR)
      WHEN 'edit' THEN CAST(target AS VARCHAR) END AS id,
    CASE WHEN type = 'clock' THEN CASE (k // 2) % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'edit' WHEN 2 THEN 'reset' ELSE 'start' END END AS action,
    CAST(k % 1000 AS DOUBLE) * 10 AS arg_ms,
    CASE WHEN type = 'quick_add' AND k % 5 < 3 OR type = 'add' AND k % 31 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS bib_number,
    CASE WHEN k % 3 = 0 THEN CAST(cmd_seq AS DOUBLE) / 1000 + 0.25 END AS wall_clock_s,
    CASE WHEN k % 3 = 1 THEN o_totalprice WHEN k % 5 > 0 THEN CAST(5 AS DOUBLE) END AS finish_time_ms,
    CASE WHEN (k // 8) % 8 = 5 THEN CAST(o_custkey AS VARCHAR) END AS new_bib,
    CASE WHEN (k // 8) % 8 = 5 AND k % 4 = 1 THEN 'Typed' END AS new_name,
    k % 5 = 0 AND type = 'edit' AS bad, k % 5 = 1 AS timed, k % 7 = 0 AS ranked, k % 3 = 0 AS gendered, k % 11 < 4 AS teamed
  FROM cmd),
races AS (SELECT DISTINCT race_id FROM log),
base AS (SELECT r.* REPLACE ({v.RACE_SQL.format("(r.seq // 64)")} AS race_id) FROM v_results r WHERE r.seq % 2 = 0),
file AS (SELECT race_id, bib_number, {strip("racer_name")} AS racer_name, {g("gender")} AS gender,
    nullif({strip("coalesce(team, '')")}, '') AS team, age, CAST(bib_number AS BIGINT) AS row_num
  FROM v_roster WHERE bib_number NOT LIKE 'G%'),
clk AS (SELECT *, count(*) FILTER (WHERE action IN ('start', 'reset')) OVER w AS gs,
    count(*) FILTER (WHERE action <> 'edit') OVER w AS gt, count(*) FILTER (WHERE action IN ('edit', 'reset')) OVER w AS go
  FROM log WHERE type IN ('add', 'quick_add', 'clock') WINDOW w AS (PARTITION BY race_id ORDER BY cmd_seq)),
st AS (SELECT *, max(CASE WHEN action = 'start' THEN ts_s END) OVER (PARTITION BY race_id, gs) AS s0,
    coalesce(max(CASE WHEN action = 'start' THEN 'running' WHEN action IN ('stop', 'reset') THEN 'stopped' END)
      OVER (PARTITION BY race_id, gt), 'stopped') AS status FROM clk),
ofs AS (SELECT *, coalesce(max(CASE WHEN action = 'reset' THEN CAST(0 AS DOUBLE) WHEN action = 'edit' THEN
    CASE WHEN s0 IS NULL THEN arg_ms ELSE arg_ms - (ts_s - s0) * 1000 END END) OVER (PARTITION BY race_id, go), 0) AS o FROM st),
asked AS (SELECT *, status = 'running' AND s0 IS NOT NULL AS runs FROM ofs WHERE type <> 'clock'),
fin AS (SELECT race_id, cmd_seq, type, id, bib_number,
    CASE WHEN type = 'quick_add' THEN CASE WHEN runs THEN floor((ts_s - s0) * 1000 + o + 0.5) ELSE o END
      WHEN wall_clock_s IS NOT NULL THEN (wall_clock_s - s0) * 1000 + o ELSE finish_time_ms END AS ms,
    CASE WHEN type = 'quick_add' THEN NULL WHEN bib_number IS NULL THEN 'bibNumber is required'
      WHEN wall_clock_s IS NOT NULL AND NOT runs THEN 'Race clock is not running. Please start the race clock first.'
      WHEN wall_clock_s IS NULL AND finish_time_ms IS NULL THEN 'Either wallClockTime or finishTime is required' END AS error
  FROM asked)"""


def _half(n: int, state: str, roster: str, mod: int) -> str:
    """Two phases with a reorder between them, from ``state`` to ``t{n}``."""
    lo, mark, hi = 2 * n * PHASE, (2 * n + 1) * PHASE - 1, 2 * (n + 1) * PHASE - 1
    here = f"cmd_seq > {lo} AND cmd_seq < {hi}"
    return f"""list{n} AS (SELECT DISTINCT race_id, id, k % 10 AS rank, {1 << 35} - k AS pos FROM (
    SELECT race_id, id, seq AS k FROM base UNION ALL
    SELECT race_id, id, k FROM log WHERE type IN ('add', 'quick_add') AND cmd_seq < {mark}) WHERE k % {mod} <> 0),
b{n} AS (SELECT race_id, id, -1 AS born, finish_time_ms AS ms FROM {state}
  UNION ALL SELECT race_id, id, cmd_seq, ms FROM fin WHERE error IS NULL AND {here}),
d{n} AS (SELECT b.race_id, b.id, min(l.cmd_seq) AS ts_at FROM b{n} b JOIN log l ON b.race_id = l.race_id AND b.id = l.id
  WHERE l.type = 'delete' AND {here} AND cmd_seq > born GROUP BY ALL),
life{n} AS (SELECT b.*, least(d.ts_at, CASE WHEN b.born < {mark} AND s.id IS NULL AND b.race_id IN (SELECT race_id FROM races) THEN {mark} END) AS died
  FROM b{n} b LEFT JOIN d{n} d ON b.race_id = d.race_id AND b.id = d.id
  LEFT JOIN list{n} s ON b.race_id = s.race_id AND b.id = s.id),
n{n} AS (SELECT race_id, ts_at, kind, sum(step) OVER (PARTITION BY race_id ORDER BY ts_at, kind) AS n FROM (
    SELECT race_id, born AS ts_at, 1 AS step, 1 AS kind FROM life{n} WHERE ms IS NOT NULL UNION ALL
    SELECT race_id, died, -1, 1 FROM life{n} WHERE ms IS NOT NULL AND died IS NOT NULL UNION ALL
    SELECT race_id, cmd_seq, 0, 0 FROM fin WHERE type = 'quick_add')),
in{n} AS (SELECT f.race_id, f.id, f.cmd_seq, f.ms, coalesce(f.bib_number, 'No-Bib-' || CAST(coalesce(n.n, 0) + 1 AS BIGINT)) AS bib
  FROM fin f LEFT JOIN n{n} n ON f.race_id = n.race_id AND f.cmd_seq = n.ts_at AND n.kind = 0 AND f.type = 'quick_add'
  WHERE f.error IS NULL AND {here}),
tab{n} AS (SELECT race_id, id, bib_number, racer_name, finish_time_ms, rank, gender, team, age, seq FROM {state} UNION ALL
  SELECT i.race_id, i.id, i.bib, coalesce(r.racer_name, 'Racer #' || i.bib), i.ms, NULL, {g("r.gender")}, {strip("nullif(r.team, '')")}, r.age,
    i.cmd_seq + {1 << 40} FROM in{n} i LEFT JOIN {roster} r ON i.race_id = r.race_id AND i.bib = r.bib_number),
ed{n} AS (SELECT l.* FROM log l JOIN life{n} f ON l.race_id = f.race_id AND l.id = f.id
  WHERE l.type = 'edit' AND NOT l.bad AND {here} AND cmd_seq > born AND (died IS NULL OR cmd_seq < died)),
bib{n} AS (SELECT *, lag(bib) OVER (PARTITION BY race_id, id ORDER BY cmd_seq) AS old FROM (
    SELECT race_id, id, cmd_seq, new_bib AS bib FROM ed{n} WHERE new_bib IS NOT NULL UNION ALL
    SELECT race_id, id, -1, bib_number FROM tab{n})),
ch{n} AS (SELECT b.race_id, b.id, b.cmd_seq, r.bib_number IS NOT NULL AS hit, r.racer_name, r.gender, r.team
  FROM bib{n} b LEFT JOIN {roster} r ON b.race_id = r.race_id AND b.bib = r.bib_number
  WHERE b.cmd_seq >= 0 AND b.bib <> b.old),
set{n} AS (SELECT e.*, c.id IS NOT NULL AS moved, coalesce(c.hit, false) AS hit, c.racer_name AS rn, nullif(c.gender, '') AS rg, nullif(c.team, '') AS rt
  FROM ed{n} e LEFT JOIN ch{n} c ON e.race_id = c.race_id AND e.id = c.id AND e.cmd_seq = c.cmd_seq),
f{n} AS (SELECT race_id, id, arg_max(new_bib, cmd_seq) AS bib,
    arg_max({{'v': CASE WHEN hit THEN coalesce(new_name, rn) WHEN moved THEN 'Racer #' || new_bib ELSE new_name END}}, cmd_seq)
      FILTER (WHERE moved OR new_name IS NOT NULL) AS name,
    max(cmd_seq) FILTER (WHERE timed) AS ts_at, max(cmd_seq) FILTER (WHERE ranked) AS ranked_at,
    arg_max({{'v': CASE WHEN gendered THEN 'W' ELSE rg END}}, cmd_seq) FILTER (WHERE hit OR gendered) AS gender,
    arg_max({{'v': CASE WHEN teamed THEN 't' ELSE rt END}}, cmd_seq) FILTER (WHERE hit OR teamed) AS team, bool_or(hit) AS aged
  FROM set{n} GROUP BY ALL),
la{n} AS (SELECT race_id, max(cmd_seq) AS a FROM in{n} GROUP BY race_id),
rk{n} AS (SELECT race_id, id, a, row_number() OVER (PARTITION BY race_id ORDER BY ms, place) AS r FROM (
    SELECT t.race_id, t.id, la.a, CASE WHEN e.ts_at IS NOT NULL THEN CAST(123050 AS DOUBLE) ELSE t.finish_time_ms END AS ms,
      CASE WHEN la.a > {mark} AND f.born < {mark} THEN s.pos ELSE t.seq END AS place
    FROM tab{n} t JOIN life{n} f ON t.race_id = f.race_id AND t.id = f.id JOIN la{n} la ON t.race_id = la.race_id
    LEFT JOIN list{n} s ON t.race_id = s.race_id AND t.id = s.id
    LEFT JOIN (SELECT s.race_id, s.id, max(cmd_seq) AS ts_at FROM set{n} s JOIN la{n} x ON s.race_id = x.race_id
      WHERE timed AND cmd_seq <= a GROUP BY ALL) e ON t.race_id = e.race_id AND t.id = e.id
    WHERE f.born <= la.a AND (f.died IS NULL OR f.died > la.a)) WHERE ms IS NOT NULL),
t{n} AS (SELECT t.race_id, t.id, coalesce(e.bib, t.bib_number) AS bib_number,
    CASE WHEN e.name IS NOT NULL THEN e.name.v ELSE t.racer_name END AS racer_name,
    CASE WHEN e.ts_at IS NOT NULL THEN CAST(123050 AS DOUBLE) ELSE t.finish_time_ms END AS finish_time_ms,
    CASE WHEN r.a IS NOT NULL AND coalesce(greatest(e.ranked_at, s.ts_at), -1) < r.a THEN r.r
      WHEN coalesce(e.ranked_at, -1) > coalesce(s.ts_at, -1) THEN 5 WHEN s.ts_at IS NOT NULL THEN s.rank ELSE t.rank END AS rank,
    CASE WHEN e.gender IS NOT NULL THEN e.gender.v ELSE t.gender END AS gender,
    CASE WHEN e.team IS NOT NULL THEN e.team.v ELSE t.team END AS team,
    CASE WHEN e.aged THEN NULL ELSE t.age END AS age, coalesce(s.pos, t.seq) AS seq
  FROM tab{n} t JOIN life{n} f ON t.race_id = f.race_id AND t.id = f.id
  LEFT JOIN f{n} e ON t.race_id = e.race_id AND t.id = e.id LEFT JOIN rk{n} r ON t.race_id = r.race_id AND t.id = r.id
  LEFT JOIN (SELECT *, {mark} AS ts_at FROM list{n}) s ON t.race_id = s.race_id AND t.id = s.id AND f.born < {mark}
  WHERE f.died IS NULL),
bad{n} AS (SELECT l.race_id, l.cmd_seq, l.type, CASE WHEN f.id IS NULL OR cmd_seq < born OR cmd_seq > coalesce(died, cmd_seq)
      THEN 'No such row' WHEN bad THEN 'Invalid time format. Use MM:SS.ms' END AS error
  FROM log l LEFT JOIN life{n} f ON l.race_id = f.race_id AND l.id = f.id WHERE l.type IN ('edit', 'delete') AND {here})"""


UPLOAD = """lst AS (SELECT *, row_number() OVER (PARTITION BY race_id, bib_number ORDER BY seq DESC) AS rn,
    min(seq) OVER (PARTITION BY race_id, bib_number) AS first_seq FROM t0),
mrg AS (SELECT coalesce(c.race_id, k.race_id) AS race_id, coalesce(c.id, k.bib_number) AS id,
    coalesce(c.bib_number, k.bib_number) AS bib_number, coalesce(k.racer_name, c.racer_name) AS racer_name, c.finish_time_ms, c.rank,
    coalesce(k.gender, c.gender) AS gender, coalesce(k.team, c.team) AS team, coalesce(k.age, c.age) AS age,
    coalesce(c.first_seq, 4503599627370496 + k.row_num) AS seq
  FROM (SELECT * FROM lst WHERE rn = 1) c FULL JOIN (SELECT * FROM file WHERE race_id IN (SELECT race_id FROM races)) k
  ON c.race_id = k.race_id AND c.bib_number = k.bib_number),
up AS (SELECT * REPLACE (row_number() OVER (PARTITION BY race_id ORDER BY finish_time_ms IS NULL,
    coalesce(nullif(finish_time_ms, 0), 'infinity'::DOUBLE), coalesce(TRY_CAST(bib_number AS DOUBLE), 'infinity'::DOUBLE), seq) AS seq) FROM mrg),
look AS (SELECT race_id, bib_number, racer_name, gender, team, age FROM up WHERE finish_time_ms IS NULL)"""
SQL = f"WITH {v.V_RESULTS}, {v.V_ROSTER}, {LOG}, {_half(0, 'base', 'v_roster', 13)}, {UPLOAD}, {_half(1, 'up', 'look', 17)} "


def _inputs(spark, sf):
    k = F.col("o_orderkey")
    race = lambda n: v.race_of(F.floor(n / 64).cast("bigint"))
    part = F.floor(k / 8) % 8
    kind = (
        F.when(part < 2, F.lit("add")).when(part == 2, F.lit("quick_add")).when(part == 6, F.lit("delete"))
        .when(part == 7, F.lit("clock")).otherwise(F.lit("edit"))
    )
    half, target = F.floor(k / 2), F.floor(k / 32) * 32 + 2 * (F.floor(k / 2) % 2)
    rows = v.table(spark, sf, "orders").where(k % 2 == 1)
    rows = rows.withColumns({"race_id": race(k), "cmd_seq": half % 4 * PHASE + k, "type": kind, "ts_s": (half % 4 * PHASE + k).cast("double") / 1000})
    bib, is_type, text = F.col("o_custkey").cast("string"), lambda t: F.col("type") == t, F.lit(None).cast("string")
    pair = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))
    edit = is_type("edit")
    fields = F.array(
        pair(edit & (part == 5), "bibNumber", bib), pair(edit & (part == 5) & (k % 4 == 1), "racerName", F.lit("Typed")),
        pair(edit & (k % 5 < 2), "finishTime", F.when(k % 5 == 0, F.lit("nope")).otherwise(F.lit("2:03.5"))),
        pair(edit & (k % 7 == 0), "rank", F.lit("5")), pair(edit & (k % 3 == 0), "gender", F.lit("woman")),
        pair(edit & (k % 11 < 4), "team", F.lit(" t ")),
    )
    added = F.when(is_type("add"), F.concat(F.lit("a"), k.cast("string"))).when(is_type("quick_add"), F.concat(F.lit("q"), k.cast("string")))
    aim = F.when(is_type("delete"), target + 4).when(edit, target).cast("bigint").cast("string")
    no_bib = (is_type("quick_add") & (k % 5 < 3)) | (is_type("add") & (k % 31 == 0))
    log = rows.select(
        "race_id", "cmd_seq", "type", "ts_s", F.coalesce(added, aim).alias("id"),
        F.map_from_entries(F.array_compact(fields)).alias("fields"),
        F.when(half % 5 == 0, "stop").when(half % 5 == 1, "edit").when(half % 5 == 2, "reset").otherwise("start").alias("action"),
        ((k % 1000).cast("double") * 10).alias("arg_ms"), F.when(~no_bib, bib).alias("bib_number"),
        F.when(k % 3 == 0, F.col("ts_s") + 0.25).alias("wall_clock_s"),
        F.when(k % 3 == 1, F.col("o_totalprice")).when(k % 5 > 0, F.lit(5.0)).cast("double").alias("finish_time_ms"),
        *[text.alias(c) for c in ("finish_time_str", "racer_name", "gender", "team", "age")],
    )
    races = rows.select("race_id").distinct()
    steps = F.array(*[F.struct(F.lit(n * PHASE - 1).alias("cmd_seq"), F.lit(t).alias("type")) for n, t in ((1, "reorder"), (2, "upload"), (3, "reorder"))])
    log = log.unionByName(races.select("race_id", F.inline(steps)), allowMissingColumns=True)

    results = v.v_results(spark, sf).where(F.col("seq") % 2 == 0).withColumn("race_id", race(F.col("seq")))
    entered = rows.where(is_type("add") | is_type("quick_add")).select("race_id", added.alias("id"), k.alias("k"), "cmd_seq")
    ids = results.select("race_id", "id", F.col("seq").alias("k"), F.lit(0).cast("bigint").alias("cmd_seq")).unionByName(entered)
    listed = [
        ids.where((F.col("cmd_seq") < mark) & (F.col("k") % mod != 0)).select(
            "race_id", F.lit(mark).cast("bigint").alias("cmd_seq"), "id", (F.col("k") % 10).alias("rank"), (F.lit(1 << 35) - F.col("k")).alias("pos")
        )
        for mark, mod in ((PHASE - 1, 13), (3 * PHASE - 1, 17))
    ]
    roster = v.v_roster(spark, sf)
    file = roster.where(~F.col("bib_number").startswith("G")).withColumns(
        {"cmd_seq": F.lit(2 * PHASE - 1).cast("bigint"), "row_num": F.col("bib_number").cast("bigint")}
    )
    return results, log, listed[0].unionByName(listed[1]), file, roster


@query("q_command_replay", SQL + "SELECT race_id, id, bib_number, racer_name, round(finish_time_ms, 3) AS finish_time_ms, rank, gender, team, age, seq FROM t1")
def command_replay(spark, sf):
    table, _ = commands.replay(*_inputs(spark, sf), stale_rank=True)
    return table.withColumn("finish_time_ms", F.round("finish_time_ms", 3))


@query(
    "q_command_rejected",
    SQL + """SELECT race_id, cmd_seq, type, error FROM (SELECT race_id, cmd_seq, type, error FROM fin UNION ALL
  SELECT * FROM bad0 UNION ALL SELECT * FROM bad1) WHERE error IS NOT NULL""",
)
def command_rejected(spark, sf):
    return commands.rejected(*_inputs(spark, sf))
