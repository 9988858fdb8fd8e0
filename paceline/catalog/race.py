"""The composed race: events, results and rejected events from detections alone."""

from pyspark.sql import functions as F

from ..operators import race
from ..plans.tables import materialize
from . import detections as det
from . import results as res
from . import views as v
from .registry import query

# Processed frames by the idle machine as a recursive query; then the SQL of the single
# operators, over detections that carry the ordinals.
PROCESSED = (
    f"WITH RECURSIVE {v.V_RACE_DET}"
    + f""", shown AS (SELECT race_id, camera_id, frame_ord, any_value(wall_ts) AS wall_ts,
    bool_or(cls = 0 AND {det.IN_CORRIDOR}) AS has_person FROM v_race_det GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_ord) AS i FROM shown),
machine AS (SELECT camera_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_ord,
    false AS kept, 0 AS state FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.camera_id, n.i, n.frame_ord, m.state < 10,
    CASE WHEN m.state >= 40 THEN 0 WHEN m.state >= 10 THEN m.state + 1
         WHEN n.has_person THEN 0 ELSE m.state + 1 END
  FROM machine m JOIN numbered n ON n.camera_id = m.camera_id AND n.i = m.i + 1),
processed AS (SELECT s.race_id, s.camera_id, s.frame_ord AS source_ord, s.wall_ts AS sent_ts,
    row_number() OVER (PARTITION BY camera_id ORDER BY frame_ord) - 1 AS ordinal
  FROM shown s JOIN machine m USING (camera_id, frame_ord) WHERE m.kept),
v_det AS (SELECT d.* REPLACE (p.ordinal AS frame_ord), d.frame_ord AS source_ord
  FROM v_race_det d JOIN processed p ON d.camera_id = p.camera_id AND d.frame_ord = p.source_ord)"""
)
EVENTS = (
    det.EMITTED.replace(f"WITH {v.V_DET}", PROCESSED)
    + f""", hit AS (SELECT p.race_id, p.camera_id, p.frame_ord, p.track_id, b.det_seq, b.conf,
    b.source_ord, row_number() OVER (PARTITION BY p.race_id, p.camera_id, p.frame_ord, p.track_id
      ORDER BY b.det_seq) AS rn
  FROM persons p JOIN bibs b ON p.race_id = b.race_id AND p.camera_id = b.camera_id
    AND p.frame_ord = b.frame_ord AND p.x1 < (b.x1 + b.x2) / 2 AND (b.x1 + b.x2) / 2 < p.x2
    AND p.y1 < (b.y1 + b.y2) / 2 AND (b.y1 + b.y2) / 2 < p.y2),
early AS (SELECT h.race_id, h.camera_id, h.track_id, h.frame_ord, h.det_seq,
    CAST(10 + h.det_seq // 4 AS VARCHAR) AS bib,
    CAST(40 + (h.source_ord + h.det_seq) % 61 AS BIGINT) AS c
  FROM hit h JOIN emitted e USING (race_id, camera_id, track_id)
  WHERE rn = 1 AND conf > 0.7::DOUBLE AND h.frame_ord < emit_ord)"""
    + det.NAMED
    + """, sent AS (SELECT e.race_id, e.camera_id, e.track_id, cross_ord, emit_ord, source_ord,
    finish_wall_time, sent_ts, coalesce(n.bib, 'Unknown-' || e.track_id) AS bib_number,
    'Racer ' || e.track_id AS racer_name
  FROM emitted e JOIN (SELECT race_id, camera_id, ordinal AS emit_ord, source_ord, sent_ts
    FROM processed) p USING (race_id, camera_id, emit_ord)
  LEFT JOIN named n USING (race_id, camera_id, track_id)) """
)
EVENT = ["cross_ord", "emit_ord", "source_ord", "finish_wall_time", "sent_ts", "bib_number"]


def observed(spark, sf):
    """Detections, frames and reads of the stand-in race."""
    rows = materialize(v.v_race_det(spark, sf), "race_detections")
    frames = rows.groupBy(*det.CAM, "frame_ord").agg(F.first("wall_ts").alias("wall_ts"))
    return rows, frames, v.v_crop_read(rows)


@query(
    "q_race_events",
    EVENTS + f"SELECT race_id, camera_id, track_id, {', '.join(EVENT)} FROM sent",
)
def race_events(spark, sf):
    sent = race.finisher_events(*observed(spark, sf), *det._size())
    return sent.select(*det.CAM, "track_id", *EVENT)


# An event is timed by the last command up to the moment it was sent; the as-of SQL gets
# one state per moment, as its join takes any of several.
ARRIVED = """, v_arrival AS (SELECT race_id, camera_id || ':' || track_id AS event_id, bib_number,
    finish_wall_time AS wall_clock_s, CAST(NULL AS DOUBLE) AS finish_time_ms,
    CAST(NULL AS VARCHAR) AS finish_time_str, racer_name, sent_ts AS ts_s,
    row_number() OVER (PARTITION BY race_id ORDER BY sent_ts, camera_id, track_id) AS seq
  FROM sent), """
RACE = (
    EVENTS
    + ARRIVED
    + res.TIMED.replace(f"WITH {v.V_CLOCK}", v.V_RACE_CLOCK)
    .replace(f"{v.V_ARRIVAL},", "")
    .replace(
        "ASOF LEFT JOIN fold c",
        "ASOF LEFT JOIN (SELECT * FROM fold QUALIFY row_number() OVER"
        " (PARTITION BY race_id, ts_s ORDER BY seq DESC) = 1) c",
    )
)


def ranked_and_rejected(spark, sf):
    clock, roster = v.v_race_clock(spark, sf), v.v_roster(spark, sf)
    return race.race_results(*observed(spark, sf), clock, roster, *det._size())


@query(
    "q_race_pipeline",
    RACE
    + f""", {v.V_ROSTER}, ok AS (SELECT t.race_id, t.bib_number, t.seq, ms,
    coalesce(r.racer_name, t.racer_name) AS racer_name, {res.g('r.gender')} AS gender
  FROM timed t LEFT JOIN v_roster r
    ON t.race_id = r.race_id AND t.bib_number = r.bib_number WHERE error IS NULL)
SELECT race_id, bib_number, seq, round(ms, 3) AS finish_time_ms, racer_name, gender,
  row_number() OVER (PARTITION BY race_id ORDER BY ms, seq) AS rank FROM ok""",
)
def race_pipeline(spark, sf):
    ranked, _ = ranked_and_rejected(spark, sf)
    return ranked.select(
        "race_id", "bib_number", "seq", F.round(res.MS, 3).alias(res.MS), "racer_name", "gender",
        "rank",
    )


@query(
    "q_race_rejected",
    RACE + "SELECT race_id, event_id, bib_number, seq, error FROM timed WHERE error IS NOT NULL",
)
def race_rejected(spark, sf):
    _, rejected = ranked_and_rejected(spark, sf)
    return rejected.select("race_id", "event_id", "bib_number", "seq", "error")
