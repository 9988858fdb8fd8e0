"""Ranks, places, statistics and boards."""

from pyspark.sql import functions as F

from ..functions import clean, times
from ..operators import boards, feed, ranking
from ..operators import results as res
from . import views as v
from .registry import query

MS = "finish_time_ms"
FINISH = f"WITH {v.V_FINISH} "
RESULTS = f"WITH {v.V_RESULTS} "
PLACE_KEYS = "finish_time_ms IS NULL, coalesce(nullif(finish_time_ms, 0), 'infinity'::DOUBLE), seq"
NULLZERO = "coalesce(finish_time_ms, 0), seq"


@query(
    "q_rank_overall",
    FINISH
    + """SELECT race_id, id, finish_time_ms,
  CASE WHEN finish_time_ms IS NOT NULL THEN row_number() OVER
    (PARTITION BY race_id ORDER BY finish_time_ms IS NULL, finish_time_ms, seq) END AS rank
FROM v_finish""",
)
def rank_overall(spark, sf):
    return ranking.rank_overall(v.v_finish(spark, sf)).select("race_id", "id", MS, "rank")


@query(
    "q_global_rank",
    FINISH
    + """SELECT id, row_number() OVER (ORDER BY finish_time_ms, seq) AS rank
FROM v_finish WHERE finish_time_ms IS NOT NULL""",
)
def global_rank(spark, sf):
    done = ranking.finished(v.v_finish(spark, sf)).select("id", MS, "seq")
    return ranking.global_rank(done, ranking.finish_order()).select("id", "rank")


@query(
    "q_place_csv",
    FINISH
    + f"""SELECT race_id, id, row_number() OVER (PARTITION BY race_id ORDER BY {PLACE_KEYS})
  AS place FROM v_finish""",
)
def place_csv(spark, sf):
    rows = v.v_finish(spark, sf).select("race_id", "id", MS, "seq")
    return ranking.place_csv(rows).select("race_id", "id", "place")


@query(
    "q_provisional_rank",
    FINISH
    + """SELECT race_id, id, row_number() OVER (PARTITION BY race_id ORDER BY seq)
  AS provisional_rank FROM v_finish WHERE finish_time_ms IS NOT NULL""",
)
def provisional_rank(spark, sf):
    rows = v.v_finish(spark, sf).select("race_id", "id", MS, "seq")
    return ranking.provisional_rank(rows).select("race_id", "id", "provisional_rank")


@query(
    "q_display_position",
    FINISH
    + f"""SELECT race_id, id, row_number() OVER (PARTITION BY race_id ORDER BY {NULLZERO})
  AS position FROM v_finish""",
)
def display_position(spark, sf):
    rows = v.v_finish(spark, sf).select("race_id", "id", MS, "seq")
    return ranking.display_position(rows, ranking.nullzero_order()).select(
        "race_id", "id", "position"
    )


@query(
    "q_order_roster",
    RESULTS
    + """SELECT race_id, id, row_number() OVER (PARTITION BY race_id ORDER BY
  finish_time_ms IS NULL, coalesce(nullif(finish_time_ms, 0), 'infinity'::DOUBLE),
  coalesce(TRY_CAST(bib_number AS DOUBLE), 'infinity'::DOUBLE), seq) AS position
FROM v_results""",
)
def order_roster(spark, sf):
    rows = v.v_results(spark, sf).select("race_id", "id", "bib_number", MS, "seq")
    return ranking.display_position(rows, ranking.roster_order()).select(
        "race_id", "id", "position"
    )


@query(
    "q_first_finishers",
    FINISH
    + """SELECT race_id, id, finish_time_ms FROM v_finish WHERE finish_time_ms IS NOT NULL
ORDER BY finish_time_ms, seq LIMIT 100""",
)
def first_finishers(spark, sf):
    rows = ranking.finished(v.v_finish(spark, sf))
    return ranking.head_n(rows, ranking.finish_order(), 100).select("race_id", "id", MS)


@query(
    "q_results_read",
    FINISH + "SELECT race_id, id, finish_time_ms FROM v_finish WHERE finish_time_ms IS NOT NULL",
)
def results_read(spark, sf):
    return ranking.results_read(v.v_finish(spark, sf)).select("race_id", "id", MS)


@query(
    "q_finish_counts",
    FINISH
    + """SELECT race_id, count(*) AS total, count(finish_time_ms) AS finished
FROM v_finish GROUP BY race_id""",
)
def finish_counts(spark, sf):
    return ranking.finish_counts(v.v_finish(spark, sf))


STATS = (
    FINISH
    + """, w AS (SELECT *, min(finish_time_ms) OVER (PARTITION BY race_id) AS winner_ms
  FROM v_finish),
p AS (SELECT *, winner_ms / nullif(finish_time_ms, 0) AS pw FROM w),
s AS (SELECT race_id, min(winner_ms) AS winner_ms, count(finish_time_ms) AS finishers,
        avg(pw) AS mean_winning, median(pw) AS median_winning FROM p GROUP BY race_id) """
)


@query(
    "q_finish_stats",
    STATS
    + """SELECT race_id, winner_ms, finishers, round(mean_winning, 9) AS mean_winning,
  round(median_winning, 9) AS median_winning FROM s""",
)
def finish_stats(spark, sf):
    s = ranking.finish_stats(v.v_finish(spark, sf))
    return s.withColumns({c: F.round(c, 9) for c in ("mean_winning", "median_winning")})


# Winning times are moved off zero so the ratios are not all zero.
@query(
    "q_relative_stats",
    f"WITH {v.V_FINISH.replace('THEN 0.0', 'THEN -1000.0')}"
    + STATS[len(FINISH) :]
    + f"""SELECT p.race_id, id, row_number() OVER (PARTITION BY p.race_id ORDER BY {PLACE_KEYS})
    AS place,
  round(finish_time_ms - s.winner_ms, 3) AS diff_ms,
  round((finish_time_ms - s.winner_ms) / nullif(finish_time_ms, 0), 6) AS pct_back,
  round(pw, 6) AS pct_winning, round(pw - mean_winning, 6) AS pct_average,
  round(pw - median_winning, 6) AS pct_median
FROM p JOIN s ON p.race_id = s.race_id""",
)
def relative_stats(spark, sf):
    rows = v.v_finish(spark, sf)
    moved = F.when(F.col(MS) == 0, F.lit(-1000.0)).otherwise(F.col(MS))
    rows = ranking.relative_stats(rows.withColumn(MS, moved))
    ratios = [
        F.round(c, 6).alias(c) for c in ("pct_back", "pct_winning", "pct_average", "pct_median")
    ]
    return rows.select("race_id", "id", "place", F.round("diff_ms", 3).alias("diff_ms"), *ratios)


TIME_TEXT = """CASE WHEN {0} IS NULL THEN '' ELSE
  printf('%02d:%02d.%02d', CAST(floor(floor({0} / 1000) / 60) AS BIGINT),
         CAST(floor({0} / 1000) AS BIGINT) % 60,
         CAST(trunc(({0} % 1000) / 10) AS BIGINT)) END"""


@query(
    "q_leaderboard",
    RESULTS
    + f"""SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY {PLACE_KEYS}) AS "Place",
  bib_number AS "Bib", racer_name AS "Name", racer_name AS "First name", '' AS "Last name",
  age AS "Age", coalesce(gender, '') AS "Gender",
  {TIME_TEXT.format('finish_time_ms')} AS "Time",
  {TIME_TEXT.format('(finish_time_ms - min(finish_time_ms) OVER (PARTITION BY race_id))')}
    AS "Difference",
  coalesce(printf('%.6f', (finish_time_ms - min(finish_time_ms) OVER (PARTITION BY race_id))
    / nullif(finish_time_ms, 0)), '') AS "% Back",
  coalesce(printf('%.6f', min(finish_time_ms) OVER (PARTITION BY race_id)
    / nullif(finish_time_ms, 0)), '') AS "% Winning",
  coalesce(team, '') AS team
FROM v_results""",
)
def leaderboard(spark, sf):
    board = ranking.leaderboard(v.v_results(spark, sf))
    # The text of these two hangs on the last digit of a mean, so they stay out here;
    # q_relative_stats compares them as numbers.
    return board.drop("% Average", "% Median")


@query(
    "q_top3_gender",
    RESULTS
    + f"""SELECT race_id, gender, position, id, finish_time_ms,
  CASE position WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal
FROM (SELECT *, row_number() OVER (PARTITION BY race_id, gender ORDER BY {NULLZERO}) AS position
      FROM v_results WHERE gender IN ('M', 'W')) WHERE position <= 3""",
)
def top3_gender(spark, sf):
    top = boards.top_n_by(v.v_results(spark, sf))
    return top.select("race_id", "gender", "position", "id", MS, "medal")


TEAMS = (
    RESULTS
    + f""", t AS (SELECT * REPLACE ({v.STRIP_SQL.format('team')} AS team) FROM v_results
             WHERE {v.STRIP_SQL.format('team')} <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY race_id, team ORDER BY {NULLZERO}) AS runner_pos,
        count(*) OVER (PARTITION BY race_id, team) AS size FROM t),
f AS (SELECT race_id, team, size, row_number() OVER (PARTITION BY race_id ORDER BY {NULLZERO})
        AS team_pos FROM r WHERE runner_pos = 1) """
)


@query(
    "q_team_top3_first6",
    TEAMS
    + """SELECT r.race_id, r.team, team_pos, runner_pos, id, finish_time_ms,
  greatest(r.size - 3, 0) AS more
FROM r JOIN f ON r.race_id = f.race_id AND r.team = f.team
WHERE team_pos <= 6 AND runner_pos <= 3""",
)
def team_board(spark, sf):
    return boards.team_board(v.v_results(spark, sf)).drop("bib_number", "racer_name", "medal")


@query(
    "q_team_overflow",
    TEAMS + "SELECT race_id, team, size, size - 3 AS more FROM f WHERE size > 3",
)
def team_overflow(spark, sf):
    return boards.team_overflow(v.v_results(spark, sf))


@query(
    "q_team_groups", TEAMS + "SELECT race_id, team, id, runner_pos AS team_runner FROM r"
)
def team_groups(spark, sf):
    rows = v.v_results(spark, sf).select("race_id", "team", "id", MS, "seq")
    return boards.team_groups(rows).select("race_id", "team", "id", "team_runner")


def _dedupe_sql(order: str) -> str:
    return (
        FINISH
        + f"""SELECT race_id, bib_number, id, finish_time_ms FROM
  (SELECT *, row_number() OVER (PARTITION BY race_id, bib_number ORDER BY {order}) AS rn
   FROM v_finish) WHERE rn = 1"""
    )


@query("q_dedupe_fastest", _dedupe_sql(NULLZERO))
def dedupe_fastest(spark, sf):
    return boards.dedupe_board(v.v_finish(spark, sf)).drop("seq")


@query("q_dedupe_first_arrival", _dedupe_sql("seq"))
def dedupe_first_arrival(spark, sf):
    return boards.dedupe_board(v.v_finish(spark, sf), "first_arrival").drop("seq")


@query(
    "q_public_board_total",
    FINISH
    + """SELECT race_id, count(DISTINCT bib_number) AS total_finishers
FROM v_finish GROUP BY race_id""",
)
def public_board_total(spark, sf):
    rows = v.v_finish(spark, sf).withColumns(
        {"gender": F.lit("M"), "team": F.lit("a"), "racer_name": F.lit("")}
    )
    return boards.public_board(rows)["total"]


@query(
    "q_dup_flag",
    FINISH
    + """SELECT race_id, id, count(*) OVER (PARTITION BY race_id, bib_number) > 1 AS is_duplicate
FROM v_finish""",
)
def dup_flag(spark, sf):
    flagged = res.flag_duplicate_bibs(v.v_finish(spark, sf))
    return flagged.select("race_id", "id", "is_duplicate")


@query(
    "q_export_rows",
    RESULTS
    + f"""SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY {NULLZERO}) AS "Rank",
  bib_number AS "Bib Number", coalesce(nullif(racer_name, ''), 'Unknown Runner') AS "Racer Name",
  {TIME_TEXT.format('nullif(finish_time_ms, 0)')} AS "Finish Time",
  coalesce(gender, '') AS "Gender", coalesce(team, '') AS "Team" FROM v_results""",
)
def export_rows(spark, sf):
    return boards.export_rows(v.v_results(spark, sf))


# Change log: the n-th change of a bib updates its row.  Fields alternate.
CHANGES = (
    FINISH
    + """, log AS (SELECT race_id, seq AS change_seq, bib_number AS id,
    CASE WHEN seq % 3 <> 0 THEN finish_time_ms END AS finish_time_ms,
    CASE WHEN seq % 4 = 0 THEN 'name ' || seq END AS racer_name FROM v_finish
    WHERE seq % 13 <> 0) """
)


def change_log(spark, sf):
    f = v.v_finish(spark, sf)
    n = F.col("seq")
    null = F.lit(None)
    data = F.struct(
        F.col("bib_number"),
        F.when(n % 4 == 0, F.concat(F.lit("name "), n.cast("string"))).alias("racer_name"),
        F.when(n % 3 != 0, F.col(MS)).alias(MS),
        null.cast("string").alias("gender"),
        null.cast("string").alias("team"),
        null.cast("bigint").alias("rank"),
    )
    kind = F.when(n % 13 == 0, F.lit("reload")).when(n % 2 == 0, F.lit("add"))
    return f.select(
        "race_id",
        n.alias("change_seq"),
        kind.otherwise(F.lit("update")).alias("type"),
        F.col("bib_number").alias("id"),
        data.alias("data"),
    )


@query(
    "q_changelog_fold",
    CHANGES
    + """SELECT race_id, id, min(change_seq) AS seq,
  arg_max(finish_time_ms, change_seq) FILTER (WHERE finish_time_ms IS NOT NULL) AS finish_time_ms,
  arg_max(racer_name, change_seq) FILTER (WHERE racer_name IS NOT NULL) AS racer_name
FROM log GROUP BY race_id, id""",
)
def changelog_fold(spark, sf):
    folded = boards.live_board(change_log(spark, sf))
    return folded.select("race_id", "id", "seq", MS, "racer_name")


# A feed with everything that can happen to a row: adds, updates that clear a field or
# leave it out, deletes, and reloads of a race.
FEED_COLUMNS = ["race_id", "id", "bib_number", "racer_name", MS, "team", "age", "seq", "version"]
FEED = (
    FINISH
    + """, log AS (SELECT race_id, seq AS change_seq, seq % 997 AS k,
    CASE WHEN seq % 1499 = 0 THEN 'reload' WHEN seq % 11 = 0 THEN 'delete' ELSE 'add' END AS type,
    race_id || '-' || (seq % 700) AS id, bib_number, finish_time_ms, seq % 3 <> 0 AS has_time,
    CASE WHEN seq % 8 <> 0 THEN 'name ' || seq END AS racer_name, seq % 4 = 0 AS has_name,
    CASE WHEN seq % 14 <> 0 THEN 'team ' || seq % 5 END AS team, seq % 7 = 0 AS has_team,
    CASE WHEN seq % 10 <> 0 THEN CAST(seq % 90 AS VARCHAR) END AS age, seq % 5 = 0 AS has_age
  FROM v_finish),
reloads AS (SELECT race_id, max(change_seq) AS reload FROM log WHERE type = 'reload' GROUP BY 1),
deletes AS (SELECT race_id, id, max(change_seq) AS gone FROM log WHERE type = 'delete' GROUP BY 1, 2),
live AS (SELECT log.* FROM log LEFT JOIN reloads USING (race_id) LEFT JOIN deletes USING (race_id, id)
  WHERE type = 'add' AND change_seq > coalesce(reload, 0) AND change_seq > coalesce(gone, 0)) """
)


def change_feed(spark, sf):
    n = F.col("seq")
    row = {
        "bib_number": F.col("bib_number"),
        "racer_name": F.when(n % 8 != 0, F.concat(F.lit("name "), n.cast("string"))),
        MS: F.col(MS),
        "team": F.when(n % 14 != 0, F.concat(F.lit("team "), (n % 5).cast("string"))),
        "age": F.when(n % 10 != 0, (n % 90).cast("string")),
    }
    given = {"racer_name": n % 4 == 0, MS: n % 3 != 0, "team": n % 7 == 0, "age": n % 5 == 0}
    kind = F.when(n % 1499 == 0, F.lit("reload")).when(n % 11 == 0, F.lit("delete")).when(n % 2 == 0, F.lit("add"))
    return v.v_finish(spark, sf).select(
        "race_id",
        n.alias("change_seq"),
        kind.otherwise(F.lit("update")).alias("type"),
        F.concat_ws("-", "race_id", (n % 700).cast("string")).alias("id"),
        feed.fields_of(row, given).alias("fields"),
    )


def _last(column: str, given: str) -> str:
    return f"(arg_max(struct_pack(v := {column}), change_seq) FILTER (WHERE {given})).v AS {column}"


@query(
    "q_feed_fold",
    FEED
    + f"""SELECT race_id, id, {_last('bib_number', 'true')}, {_last('racer_name', 'has_name')},
  {_last('finish_time_ms', 'has_time')}, {_last('team', 'has_team')}, {_last('age', 'has_age')},
  min(change_seq) AS seq, max(change_seq) AS version FROM live GROUP BY race_id, id""",
)
def feed_fold(spark, sf):
    return feed.fold_feed(change_feed(spark, sf)).select(*FEED_COLUMNS)


# --- scalar queries ------------------------------------------------------------


@query(
    "q_fmt_time",
    f"""SELECT o_orderkey, {TIME_TEXT.format('o_totalprice')} AS mmss,
  {TIME_TEXT.format('o_totalprice')} AS mmss_ui
FROM orders""",
)
def fmt_time(spark, sf):
    ms = F.col("o_totalprice")
    return v.table(spark, sf, "orders").select(
        "o_orderkey", times.fmt_mmss(ms).alias("mmss"), times.fmt_mmss_ui(ms).alias("mmss_ui")
    )


@query(
    "q_signed_time",
    """WITH m AS (SELECT c_custkey, c_acctbal * 100 - 200000 AS ms,
    abs(c_acctbal * 100 - 200000) / 1000 AS s FROM customer)
SELECT c_custkey, CASE WHEN ms < 0 THEN '-' ELSE '' END ||
  printf('%02d:%02d.%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT),
         CAST(floor((s % 1) * 100) AS BIGINT)) AS signed,
  printf('%02d:%02d.%02d', CAST(floor(s / 60) AS BIGINT), CAST(trunc(s % 60) AS BIGINT),
         CAST(trunc((s - trunc(s)) * 100) AS BIGINT)) AS video,
  printf('%02d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(trunc(s % 60) AS BIGINT)) AS elapsed
FROM m""",
)
def signed_time(spark, sf):
    ms = F.col("c_acctbal") * 100 - 200000
    return v.table(spark, sf, "customer").select(
        "c_custkey",
        times.fmt_signed(ms).alias("signed"),
        times.fmt_video(F.abs(ms)).alias("video"),
        times.fmt_elapsed(F.abs(ms) / 1000).alias("elapsed"),
    )


TIME_TEXTS = """WITH x AS (SELECT o_orderkey, o_orderkey % 90 AS m, o_custkey % 60 AS s,
    o_orderkey % 1000 AS f FROM orders),
t AS (SELECT o_orderkey, m, s, f, CASE o_orderkey % 6 WHEN 0 THEN 'bad' WHEN 1 THEN m || ':' || s
    WHEN 2 THEN ' ' || m || ' : ' || s || '.' || f WHEN 3 THEN m || ':' || s || '.' || f
    WHEN 4 THEN '' ELSE m || ':' || s || '.' || f || ':1' END AS txt FROM x) """


def _time_texts(spark, sf):
    n = F.col("o_orderkey")
    m, s, f = ((c).cast("string") for c in (n % 90, F.col("o_custkey") % 60, n % 1000))
    c = F.concat
    txt = (
        F.when(n % 6 == 0, F.lit("bad"))
        .when(n % 6 == 1, c(m, F.lit(":"), s))
        .when(n % 6 == 2, c(F.lit(" "), m, F.lit(" : "), s, F.lit("."), f))
        .when(n % 6 == 3, c(m, F.lit(":"), s, F.lit("."), f))
        .when(n % 6 == 4, F.lit(""))
        .otherwise(c(m, F.lit(":"), s, F.lit("."), f, F.lit(":1")))
    )
    return v.table(spark, sf, "orders").select("o_orderkey", txt.alias("txt"))


@query(
    "q_parse_time",
    TIME_TEXTS
    + """SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 IN (2, 3) THEN CAST(m * 60000 + s * 1000 + f * 10 AS DOUBLE)
       ELSE CAST(-1 AS DOUBLE) END AS ms,
  o_orderkey % 6 IN (1, 2, 3, 4) AS cell_ok,
  CASE WHEN o_orderkey % 6 = 1 THEN CAST((m * 60 + s) * 1000 AS DOUBLE)
       WHEN o_orderkey % 6 IN (2, 3)
       THEN round((m * 60 + CAST(s || '.' || f AS DOUBLE)) * 1000, 3) END AS cell_ms
FROM t""",
)
def parse_time(spark, sf):
    txt = F.col("txt")
    cell = times.parse_cell(txt)
    return _time_texts(spark, sf).select(
        "o_orderkey",
        times.parse_mmss(txt).alias("ms"),
        cell["ok"].alias("cell_ok"),
        F.round(cell["ms"], 3).alias("cell_ms"),
    )


@query(
    "q_name_split",
    r"""WITH n AS (SELECT p_partkey, '  ' || replace(p_name, '#', '  ') || chr(9) AS name,
    regexp_split_to_array(trim(replace(p_name, '#', ' ')), '\s+') AS w FROM part)
SELECT p_partkey, w[1] AS first, array_to_string(w[2:], ' ') AS last FROM n""",
)
def name_split(spark, sf):
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit("#"), F.lit("  ")), F.lit("\t"))
    name = clean.split_name(spaced)
    return v.table(spark, sf, "part").select(
        "p_partkey", name["first"].alias("first"), name["last"].alias("last")
    )


@query(
    "q_gender_norm",
    f"""WITH g AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'male' WHEN 1 THEN 'Woman'
    WHEN 2 THEN 'f' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN ' m' ELSE c_mktsegment END AS g
  FROM customer)
SELECT c_custkey, {v.GENDER_SQL.format('g')} AS gender FROM g""",
)
def gender_norm(spark, sf):
    k = F.col("c_custkey") % 7
    g = (
        F.when(k == 0, F.lit("male")).when(k == 1, F.lit("Woman")).when(k == 2, F.lit("f"))
        .when(k == 3, F.lit("")).when(k == 4, F.lit(None)).when(k == 5, F.lit(" m"))
        .otherwise(F.col("c_mktsegment"))
    )
    return v.table(spark, sf, "customer").select("c_custkey", clean.norm_gender(g).alias("gender"))


@query(
    "q_age_band",
    """SELECT p_partkey, CASE WHEN a <= 9 THEN 'Age 7 - 9' WHEN a <= 12 THEN 'Age 10 - 12'
    WHEN a <= 15 THEN 'Age 13 - 15' WHEN a <= 19 THEN 'Age 16 - 18' ELSE 'Age 19 and up' END
    AS band, coalesce(a, 100) AS age
FROM (SELECT p_partkey, nullif(p_size, 7) AS a FROM part)""",
)
def age_band(spark, sf):
    age = F.nullif(F.col("p_size"), F.lit(7))
    return v.table(spark, sf, "part").select(
        "p_partkey", clean.age_band(age).alias("band"), clean.default_age(age).alias("age")
    )


@query(
    "q_normalize_epoch",
    """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL
      WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 1.6e12 + o_totalprice END AS ft FROM orders)
SELECT o_orderkey, CASE WHEN ft > 1e12
    THEN greatest(CAST(0 AS DOUBLE), floor(ft - 1600000000.0::DOUBLE * 1000 - 90000 + 0.5))
    ELSE coalesce(ft, 0) END AS ms FROM e""",
)
def normalize_epoch(spark, sf):
    n = F.col("o_orderkey") % 3
    ft = F.when(n == 1, F.col("o_totalprice")).when(n == 2, F.col("o_totalprice") + 1.6e12)
    ms = times.normalize_epoch(ft, F.lit(1.6e9), F.lit(90000.0), null_as=0)
    return v.table(spark, sf, "orders").select("o_orderkey", ms.alias("ms"))


@query(
    "q_race_time",
    """WITH c AS (SELECT o_orderkey, o_totalprice / 100 AS now_s,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(50 AS DOUBLE) END AS st,
    CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'stopped' END AS status,
    CAST(o_custkey AS DOUBLE) AS off FROM orders)
SELECT o_orderkey, CASE WHEN status = 'running' AND st IS NOT NULL
    THEN round((now_s - st) * 1000 + off, 3) ELSE off END AS shown,
  CASE WHEN status = 'running' AND st IS NOT NULL
    THEN floor((now_s - st) * 1000 + off + 0.5) ELSE off END AS quick,
  CASE WHEN status = 'running' AND st IS NOT NULL
    THEN round((now_s - st) * 1000 + off, 3) END AS official FROM c""",
)
def race_time(spark, sf):
    n = F.col("o_orderkey")
    args = (
        F.col("o_totalprice") / 100,
        F.when(n % 5 != 0, F.lit(50.0)),
        F.col("o_custkey").cast("double"),
        F.when(n % 2 == 0, F.lit("running")).otherwise(F.lit("stopped")),
    )
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        F.round(times.race_time(*args), 3).alias("shown"),
        times.quick_add_ms(*args).alias("quick"),
        F.round(times.official_ms(*args), 3).alias("official"),
    )
