"""Geometry, bib assignment, crossings, emission, votes, frames and annotations."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import annotate, detections, frames, tracks, votes
from ..plans.tables import materialize
from . import views as v
from .registry import query

W, H = v.WIDTH, v.HEIGHT
CAM = ["race_id", "camera_id"]
KEY = [*CAM, "frame_ord", "track_id"]


def _size():
    return F.lit(v.WIDTH), F.lit(v.HEIGHT)


def in_view(det):
    return detections.persons_in_view(det, *_size())


@query(
    "q_camera_config",
    """SELECT p_partkey, width, height,
  (height * 0.78::DOUBLE - height * 1.09::DOUBLE) / CAST(width AS DOUBLE) AS m,
  height * 1.09::DOUBLE AS b, CAST(trunc(width * 0.285::DOUBLE) AS INTEGER) AS crop_x1,
  CAST(trunc(height * 0.49::DOUBLE * 0.9::DOUBLE) AS INTEGER) AS crop_y1,
  width AS crop_x2, height AS crop_y2,
  width * 0.31::DOUBLE AS gl_x1, CAST(height AS DOUBLE) AS gl_y1,
  width * 0.285::DOUBLE AS gl_x2, height * 0.49::DOUBLE AS gl_y2,
  CAST(width AS DOUBLE) AS gr_x1, height * 0.78::DOUBLE AS gr_y1,
  width * 0.32::DOUBLE AS gr_x2, height * 0.49::DOUBLE AS gr_y2
FROM (SELECT p_partkey, CAST(640 + p_size * 16 AS INTEGER) AS width,
        CAST(360 + p_size * 9 AS INTEGER) AS height FROM part)""",
)
def camera_config(spark, sf):
    size = F.col("p_size")
    cameras = v.table(spark, sf, "part").select(
        "p_partkey",
        (size * 16 + 640).cast("int").alias("width"),
        (size * 9 + 360).cast("int").alias("height"),
    )
    return geo.camera_config(cameras)


# SQL text of the geometry, with the same order of operations as the Columns.
D = "CAST({} AS DOUBLE)".format
LINE_M = f"(({D(H)} * 0.78::DOUBLE - {D(H)} * 1.09::DOUBLE) / {D(W)})"
LINE_B = f"({D(H)} * 1.09::DOUBLE)"
HORIZON = f"({D(H)} * 0.49::DOUBLE)"


def _x_at(x1: str, y1: str, x2: str, y2: str, y: str) -> str:
    return f"({x1} + ({y} - {y1}) / ({y2} - {y1}) * ({x2} - {x1}))"


def _between(x: str, y: str) -> str:
    left = _x_at(f"({D(W)} * 0.31::DOUBLE)", D(H), f"({D(W)} * 0.285::DOUBLE)", HORIZON, y)
    right = _x_at(D(W), f"({D(H)} * 0.78::DOUBLE)", f"({D(W)} * 0.32::DOUBLE)", HORIZON, y)
    return f"({x} BETWEEN least({left}, {right}) AND greatest({left}, {right}))"


CORNERS = [(x, y) for y in ("y1", "y2") for x in ("x1", "x2")]
IN_CORRIDOR = "(" + " OR ".join(_between(x, y) for x, y in CORNERS) + ")"
CROSSES = "(" + " OR ".join(f"{y} >= {LINE_M} * {x} + {LINE_B}" for x, y in CORNERS) + ")"

PERSONS = (
    f"WITH {v.V_DET}"
    + f""", corr AS (SELECT * FROM v_det WHERE cls = 0 AND {IN_CORRIDOR}),
persons AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER
    (PARTITION BY race_id, camera_id, frame_ord, track_id ORDER BY det_seq DESC) AS rn FROM corr)
  WHERE rn = 1),
bibs AS (SELECT * FROM v_det WHERE cls = 1) """
)


def decoded(spark, sf):
    """Detections decoded once into columns, as a detection table stores them.

    The operators below scan it several times; over the raw events every scan
    and every corner test would parse the JSON again.
    """
    return materialize(v.v_det(spark, sf), "detections")


def split(det):
    return detections.split_classes(det, *_size())


def frames_of(det):
    return det.select(*CAM, "frame_ord").distinct()


@query(
    "q_frame_coords",
    f"WITH {v.V_DET}"
    + " SELECT race_id, camera_id, frame_ord, det_seq, "
    + ", ".join(
        f"{axis}{k} / 0.5::DOUBLE + CAST(trunc({shift}) AS INTEGER) AS {axis}{k}"
        for axis, shift in (
            ("x", f"{D(W)} * 0.285::DOUBLE"), ("y", f"{D(H)} * 0.49::DOUBLE * 0.9::DOUBLE"),
        )
        for k in (1, 2)
    )
    + " FROM v_det",
)
def frame_coords(spark, sf):
    moved = geo.to_frame_coords(v.v_det(spark, sf), *_size())
    return moved.select(*CAM, "frame_ord", "det_seq", *geo.BOX)


@query(
    "q_corridor",
    PERSONS + "SELECT race_id, camera_id, frame_ord, track_id, det_seq, x1, y1 FROM persons",
)
def corridor(spark, sf):
    return split(decoded(spark, sf))[0].select(*KEY, "det_seq", "x1", "y1")


@query(
    "q_finish_cross",
    PERSONS
    + f"""SELECT race_id, camera_id, frame_ord, track_id, {CROSSES} AS crossed FROM persons""",
)
def finish_cross(spark, sf):
    line = geo.finish_line(*_size())
    crossed = geo.crosses(geo.box_columns(), line["m"], line["b"])
    return split(decoded(spark, sf))[0].select(*KEY, crossed.alias("crossed"))


CROSSED = (
    PERSONS
    + f""", crossing AS (SELECT race_id, camera_id, track_id, min(frame_ord) AS cross_ord,
    min(video_ms) AS finish_time_ms, min(wall_ts) AS finish_wall_time
  FROM persons WHERE {CROSSES} GROUP BY ALL) """
)


def crossings(persons):
    return tracks.line_crossings(persons, *_size())


@query("q_first_crossing", CROSSED + "SELECT * FROM crossing")
def first_crossing(spark, sf):
    return crossings(split(decoded(spark, sf))[0])


@query(
    "q_assign_bibs",
    PERSONS
    + """, pair AS (SELECT p.race_id, p.camera_id, p.frame_ord, p.track_id, b.det_seq,
    b.conf AS yolo_conf, row_number() OVER (PARTITION BY p.race_id, p.camera_id, p.frame_ord,
      p.track_id ORDER BY b.det_seq) AS rn
  FROM persons p JOIN bibs b ON p.race_id = b.race_id AND p.camera_id = b.camera_id
    AND p.frame_ord = b.frame_ord AND p.x1 < (b.x1 + b.x2) / 2 AND (b.x1 + b.x2) / 2 < p.x2
    AND p.y1 < (b.y1 + b.y2) / 2 AND (b.y1 + b.y2) / 2 < p.y2)
SELECT race_id, camera_id, frame_ord, track_id, det_seq, yolo_conf FROM pair
WHERE rn = 1 AND yolo_conf > 0.7::DOUBLE""",
)
def assign_bibs(spark, sf):
    persons, bibs = split(decoded(spark, sf))
    return detections.assign_bibs(persons, bibs).select(*KEY, "det_seq", "yolo_conf")


ISLANDS = (
    CROSSED
    + """, seen AS (SELECT DISTINCT race_id, camera_id, track_id, frame_ord FROM persons),
num AS (SELECT *, frame_ord - row_number() OVER (PARTITION BY race_id, camera_id, track_id
          ORDER BY frame_ord) AS run FROM seen),
island AS (SELECT race_id, camera_id, track_id, min(frame_ord) AS island_start,
    max(frame_ord) AS island_end, count(*) AS n_frames
  FROM num GROUP BY race_id, camera_id, track_id, run) """
)


@query("q_islands", ISLANDS + "SELECT * FROM island")
def islands(spark, sf):
    return tracks.track_islands(in_view(decoded(spark, sf)))


@query(
    "q_lost_tracks",
    ISLANDS
    + """SELECT race_id, camera_id, track_id, min(island_end) + 1 AS lost_ord
FROM island JOIN crossing USING (race_id, camera_id, track_id)
WHERE island_end >= cross_ord GROUP BY ALL""",
)
def lost_tracks(spark, sf):
    det = decoded(spark, sf)
    return tracks.lost_tracks(in_view(det), crossings(split(det)[0]))


@query(
    "q_set_changed",
    PERSONS
    + """, s AS (SELECT f.race_id, f.camera_id, f.frame_ord,
    coalesce(list_sort(list(DISTINCT p.track_id) FILTER (WHERE p.track_id IS NOT NULL)), []) AS ids
  FROM (SELECT DISTINCT race_id, camera_id, frame_ord FROM v_det) f
  LEFT JOIN persons p USING (race_id, camera_id, frame_ord) GROUP BY ALL)
SELECT race_id, camera_id, frame_ord FROM (SELECT *, lag(ids, 1, []) OVER
  (PARTITION BY race_id, camera_id ORDER BY frame_ord) AS before FROM s) WHERE ids <> before""",
)
def set_changed(spark, sf):
    det = decoded(spark, sf)
    return tracks.set_changed(in_view(det), frames_of(det))


EMITTED = (
    ISLANDS
    + """, last AS (SELECT race_id, camera_id, max(frame_ord) AS last_ord FROM v_det GROUP BY ALL),
emitted AS (SELECT c.*, least(cross_ord + 30, island_end + 1) AS emit_ord
  FROM crossing c JOIN island i USING (race_id, camera_id, track_id)
  JOIN last USING (race_id, camera_id)
  WHERE cross_ord BETWEEN island_start AND island_end
    AND least(cross_ord + 30, island_end + 1) <= last_ord) """
)


def emitted(det):
    return tracks.emissions(in_view(det), frames_of(det), crossings(split(det)[0]))


@query("q_emission", EMITTED + "SELECT * FROM emitted")
def emission(spark, sf):
    return emitted(decoded(spark, sf))


# Reads of a track in view: the assigned bib is read as the person's box number.
READS = """, read AS (SELECT race_id, camera_id, track_id, frame_ord, det_seq,
    CAST(10 + det_seq // 4 AS VARCHAR) AS bib, CAST(40 + (frame_ord + det_seq) % 61 AS BIGINT) AS c
  FROM persons)"""
NAMED = """, lock AS (SELECT race_id, camera_id, track_id,
    arg_min(bib, frame_ord * 100 + det_seq) AS bib
  FROM early WHERE c > 99 GROUP BY ALL),
score AS (SELECT race_id, camera_id, track_id, bib, sum(c) AS s,
    min(frame_ord * 100 + det_seq) AS t0 FROM early WHERE c > 40 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY race_id, camera_id, track_id
    ORDER BY s DESC, t0) AS rn FROM score),
named AS (SELECT race_id, camera_id, track_id, coalesce(l.bib, b.bib) AS bib
  FROM lock l FULL JOIN (SELECT * FROM best WHERE rn = 1) b
    USING (race_id, camera_id, track_id)) """
FINISHERS = (
    EMITTED
    + READS
    + """, early AS (SELECT r.*, e.emit_ord FROM read r
    JOIN emitted e USING (race_id, camera_id, track_id) WHERE frame_ord < emit_ord)"""
    + NAMED
    + """SELECT e.race_id, e.camera_id, e.track_id, emit_ord, finish_wall_time,
  coalesce(n.bib, 'Unknown-' || e.track_id) AS bib_number, 'Racer ' || e.track_id AS racer_name
FROM emitted e LEFT JOIN named n USING (race_id, camera_id, track_id)"""
)


def person_reads(persons):
    """One read per person and frame, derived from its position."""
    n = F.col("det_seq")
    return persons.select(
        *CAM,
        "track_id",
        "frame_ord",
        "det_seq",
        (F.lit(10) + F.floor(n / 4)).cast("string").alias("bib_read"),
        ((F.lit(40) + (F.col("frame_ord") + n) % 61) / 100).alias("ocr_conf"),
    )


@query(
    "q_track_board",
    CROSSED
    + READS
    + ", early AS (SELECT * FROM read)"
    + NAMED
    + """SELECT race_id, camera_id, track_id, finish_time_ms,
  coalesce(n.bib, 'No Bib') AS bib_number,
  row_number() OVER (PARTITION BY race_id, camera_id ORDER BY finish_time_ms, track_id)
  AS position FROM crossing LEFT JOIN named n USING (race_id, camera_id, track_id)""",
)
def track_board(spark, sf):
    persons, _ = split(decoded(spark, sf))
    board = tracks.track_board(crossings(persons), votes.vote(person_reads(persons)))
    return board.select(*CAM, "track_id", "finish_time_ms", "bib_number", "position")


@query("q_finisher_events", FINISHERS)
def finisher_events(spark, sf):
    det = decoded(spark, sf)
    sent = tracks.finishers(emitted(det), person_reads(split(det)[0]))
    return sent.select(
        *CAM, "track_id", "emit_ord", "finish_wall_time", "bib_number", "racer_name"
    )


# The machine as a recursive query: state < 10 counts empty frames, the rest drop.
@query(
    "q_idle_skip",
    f"WITH RECURSIVE {v.V_IDLE}"
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_ord) AS i
  FROM v_idle),
m AS (SELECT race_id, camera_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_ord,
    false AS kept, 0 AS state FROM n WHERE i = 1
  UNION ALL
  SELECT n.race_id, n.camera_id, n.i, n.frame_ord, m.state < 10,
    CASE WHEN m.state >= 40 THEN 0 WHEN m.state >= 10 THEN m.state + 1
         WHEN n.has_person THEN 0 ELSE m.state + 1 END
  FROM m JOIN n ON n.camera_id = m.camera_id AND n.i = m.i + 1)
SELECT race_id, camera_id, frame_ord FROM m WHERE kept""",
)
def idle_skip(spark, sf):
    return tracks.idle_skip(v.v_idle(spark, sf))


@query(
    "q_processed_ordinals",
    f"WITH {v.V_IDLE}"
    + """ SELECT race_id, camera_id, frame_ord,
  row_number() OVER (PARTITION BY camera_id ORDER BY frame_ord) - 1 AS ordinal FROM v_idle""",
)
def processed_ordinals(spark, sf):
    return tracks.processed_ordinals(v.v_idle(spark, sf)).drop("has_person")


# --- votes ---------------------------------------------------------------------------

ARRIVAL = "(frame_ord, det_seq)"
TALLY = (
    f"WITH {v.V_READ}"
    + """, good AS (SELECT race_id, camera_id, track_id, bib_read, sum(conf100) AS s,
    min((frame_ord, det_seq)) AS t0 FROM v_read
  WHERE length(bib_read) BETWEEN 2 AND 5 AND conf100 > 40 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY race_id, track_id ORDER BY s DESC, t0) AS rn
  FROM good),
locks AS (SELECT race_id, camera_id, track_id, arg_min(bib_read, (frame_ord, det_seq, bib_read))
    AS bib, min(frame_ord) AS locked_at FROM v_read WHERE conf100 > 99 GROUP BY ALL) """
)


@query(
    "q_vote",
    TALLY
    + """SELECT race_id, camera_id, track_id, bib_read AS final_bib, s / 100 AS score
FROM best WHERE rn = 1""",
)
def vote(spark, sf):
    low = v.v_read(spark, sf)
    # Without locks: the threshold is out of reach.
    opts = detections.Options(lock_conf=2.0)
    return votes.vote(low, opts).drop("locked")


@query(
    "q_vote_lock",
    TALLY
    + """SELECT coalesce(l.race_id, b.race_id) AS race_id, 'cam0' AS camera_id,
  coalesce(l.track_id, b.track_id) AS track_id, coalesce(l.bib, b.bib_read) AS final_bib,
  CASE WHEN l.bib IS NULL THEN s / 100 ELSE 1.0::DOUBLE END AS score, l.bib IS NOT NULL AS locked
FROM (SELECT * FROM best WHERE rn = 1) b FULL JOIN locks l
  ON b.race_id = l.race_id AND b.track_id = l.track_id""",
)
def vote_lock(spark, sf):
    return votes.vote(v.v_read(spark, sf))


@query(
    "q_lock_bibs",
    TALLY
    + """SELECT race_id, camera_id, track_id, bib AS final_bib, 1.0::DOUBLE AS score, locked_at
FROM locks""",
)
def lock_bibs(spark, sf):
    return votes.lock_bibs(v.v_read(spark, sf))


@query(
    "q_display_bib",
    TALLY
    + """, seen AS (SELECT race_id, camera_id, track_id, bib_read, count(*) AS n,
    min((frame_ord, det_seq)) AS t0 FROM v_read GROUP BY ALL),
mode AS (SELECT *, row_number() OVER (PARTITION BY race_id, track_id ORDER BY n DESC, t0) AS rn
  FROM seen)
SELECT m.race_id, m.camera_id, m.track_id, coalesce(l.bib, m.bib_read) AS display_bib,
  l.bib IS NOT NULL AS locked, 'Racer ID ' || m.track_id || ' | Bib: ' ||
  coalesce(l.bib || ' (1.00)', m.bib_read) AS label
FROM mode m LEFT JOIN locks l ON m.race_id = l.race_id AND m.track_id = l.track_id WHERE rn = 1""",
)
def display_bib(spark, sf):
    return votes.display_bib(v.v_read(spark, sf))


@query(
    "q_reads_by_track",
    f"WITH {v.V_READ}"
    + """ SELECT race_id, track_id, frame_ord, det_seq, bib_read,
  row_number() OVER (PARTITION BY race_id, track_id ORDER BY frame_ord, det_seq, bib_read)
  AS read_no FROM v_read""",
)
def reads_by_track(spark, sf):
    rows = votes.reads_by_track(v.v_read(spark, sf))
    return rows.select("race_id", "track_id", "frame_ord", "det_seq", "bib_read", "read_no")


@query(
    "q_with_bib",
    TALLY
    + """SELECT o_orderkey % 2 AS race_id, 'cam0' AS camera_id, o_orderkey AS track_id,
  coalesce(l.bib, b.bib_read, 'Unknown-' || o_orderkey) AS bib_number
FROM orders LEFT JOIN locks l ON o_orderkey = l.track_id
LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON o_orderkey = b.track_id""",
)
def with_bib(spark, sf):
    seen = v.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 2).alias("race_id"),
        F.lit("cam0").alias("camera_id"),
        F.col("o_orderkey").alias("track_id"),
    )
    return votes.with_bib(seen, votes.vote(v.v_read(spark, sf)))


@query(
    "q_best_candidate",
    """WITH c AS (SELECT l_orderkey AS crop_id, CAST(l_linenumber AS BIGINT) * 1000000000
    + l_partkey * 10000 + l_suppkey AS cand_seq, CASE WHEN l_suppkey % 5 = 0 THEN '  ' ELSE ' ' || l_suppkey END
    AS text, l_discount AS confidence FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY confidence DESC, cand_seq) AS rn
  FROM c)
SELECT crop_id, cand_seq, trim(text) AS text, confidence FROM b
WHERE rn = 1 AND trim(text) <> '' AND confidence <> 0""",
)
def best_candidate(spark, sf):
    sup = F.col("l_suppkey")
    c = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("crop_id"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 10000 + sup)
        .alias("cand_seq"),
        F.when(sup % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), sup.cast("string")))
        .alias("text"),
        F.col("l_discount").alias("confidence"),
    )
    return detections.best_candidate(c, ["crop_id"])


@query(
    "q_reliable_reads",
    f"WITH {v.V_READ}"
    + """ SELECT track_id, frame_ord, det_seq, bib_read FROM v_read
WHERE length(bib_read) BETWEEN 2 AND 5 AND conf100 > 40""",
)
def reliable_reads(spark, sf):
    rows = detections.reliable_reads(v.v_read(spark, sf))
    return rows.select("track_id", "frame_ord", "det_seq", "bib_read")


# --- boxes and frames -------------------------------------------------------------------


@query(
    "q_valid_box",
    f"WITH {v.V_DET}"
    + """ SELECT race_id, camera_id, frame_ord, det_seq FROM v_det
WHERE 0 <= trunc(x1 - 600) AND trunc(x1 - 600) < trunc(x2 - 600) AND trunc(x2 - 600) <= 900
  AND 0 <= trunc(y1) AND trunc(y1) < trunc(y2) AND trunc(y2) <= 1000""",
)
def valid_box(spark, sf):
    shifted = v.v_det(spark, sf).withColumns({c: F.col(c) - 600 for c in ("x1", "x2")})
    ok = geo.valid_box(geo.box_columns(), F.lit(900), F.lit(1000))
    return shifted.where(ok).select(*CAM, "frame_ord", "det_seq")


@query(
    "q_pad_crop",
    PERSONS
    + """, c AS (SELECT race_id, camera_id, frame_ord, det_seq,
  greatest(0, CAST(trunc(x1) AS INTEGER) - 15) AS cx1,
  greatest(0, CAST(trunc(y1) AS INTEGER) - 15) AS cy1,
  least(1920, CAST(trunc(x2) AS INTEGER) + 15) AS cx2,
  least(700, CAST(trunc(y2) AS INTEGER) + 15) AS cy2 FROM bibs)
SELECT * FROM c WHERE cx2 > cx1 AND cy2 > cy1""",
)
def pad_crop(spark, sf):
    cropped = detections.crops(split(decoded(spark, sf))[1], F.lit(W), F.lit(700))
    return cropped.select(
        *CAM, "frame_ord", "det_seq", *[F.col(f"crop.{c}").alias(f"c{c}") for c in geo.BOX]
    )


def _event_frames(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select(
        F.lit(0).cast("bigint").alias("race_id"),
        F.lit("cam0").alias("camera_id"),
        F.col("event_id").alias("frame_ord"),
    )


@query(
    "q_sample_frames",
    """SELECT event_id AS frame_ord,
  printf('frame_%06d_t%.3fs.jpg', event_id, event_id / 25.0::DOUBLE)
  AS name FROM events
WHERE event_id >= 50 AND (event_id - 50) % 7 = 0""",
)
def sample_frames(spark, sf):
    kept = frames.sample_frames(_event_frames(spark, sf), 7, 1 << 62, 25.0, 2.0)
    name = frames.frame_name(F.col("frame_ord"), F.lit(25.0))
    return kept.select("frame_ord", name.alias("name"))


# Four ranges per camera: the whole video, a cut of it, one that ends before it starts,
# one without an interval.  Race 0 has no frame rate; camera 2 has ranges and no video.
RANGES = """fr AS (SELECT CAST(user_id % 8 AS BIGINT) AS race_id, 'cam' || (user_id % 2) AS camera_id, event_id AS frame_ord,
  CAST(user_id % 8 AS DOUBLE) * 5 AS fps FROM events),
vid AS (SELECT race_id, camera_id, max(fps) AS fps, max(frame_ord) + 1 AS total FROM fr GROUP BY ALL),
cams AS (SELECT race_id, camera_id FROM vid UNION SELECT race_id, 'cam2' FROM vid),
rng AS (SELECT * FROM cams, (VALUES (0, 7, NULL, NULL), (1, 3, 2.5, 40.0), (2, 2, 30.0, 10.0), (3, 0, NULL, NULL)) AS r(range_no, every, start_s, end_s)),
res AS (SELECT r.*, greatest(0, coalesce(trunc(start_s::DOUBLE * fps), 0)) AS first, least(total, coalesce(trunc(end_s::DOUBLE * fps), total)) AS stop,
  CASE WHEN every < 1 THEN 'frame interval must be at least 1' WHEN total IS NULL THEN 'no such video'
    WHEN first >= stop THEN 'start time must be less than end time' END AS error
  FROM rng r LEFT JOIN vid v ON r.race_id = v.race_id AND r.camera_id = v.camera_id) """


def _ranges(spark, sf):
    u = F.col("user_id")
    rows = v.table(spark, sf, "events").select(
        (u % 8).alias("race_id"), F.concat(F.lit("cam"), (u % 2).cast("string")).alias("camera_id"),
        F.col("event_id").alias("frame_ord"), ((u % 8).cast("double") * 5).alias("fps"),
    )
    videos = materialize(rows.groupBy(*CAM).agg(F.max("fps").alias("fps"), (F.max("frame_ord") + 1).alias("total")), "videos")
    cameras = videos.select(*CAM).unionByName(videos.select("race_id", F.lit("cam2").alias("camera_id")).distinct())
    asked = [(0, 7, None, None), (1, 3, 2.5, 40.0), (2, 2, 30.0, 10.0), (3, 0, None, None)]
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("range_no"), F.lit(e).alias("every"), F.lit(a).cast("double").alias("start_s"), F.lit(b).cast("double").alias("end_s"))
            for n, e, a, b in asked
        ]
    )
    return rows.drop("fps"), cameras.select(*CAM, F.inline(entries)), videos


@query(
    "q_sample_ranges",
    f"WITH {RANGES}"
    + """SELECT f.race_id, f.camera_id, f.frame_ord, r.range_no FROM fr f JOIN res r ON f.race_id = r.race_id AND f.camera_id = r.camera_id
WHERE error IS NULL AND frame_ord >= first AND frame_ord < stop AND (frame_ord - first) % every = 0""",
)
def sample_ranges(spark, sf):
    return frames.sample_ranges(*_ranges(spark, sf))[0]


@query("q_sample_rejected", f"WITH {RANGES} SELECT race_id, camera_id, range_no, error FROM res WHERE error IS NOT NULL")
def sample_rejected(spark, sf):
    return frames.sample_ranges(*_ranges(spark, sf))[1].select(*CAM, "range_no", "error")


@query(
    "q_roi_frames",
    f"WITH {v.V_DET}"
    + """ SELECT DISTINCT race_id, camera_id, frame_ord FROM v_det
WHERE cls = 0 AND conf >= 0.97::DOUBLE AND (x1 + x2) / 2 >= 1920 * 0.5""",
)
def roi_frames(spark, sf):
    det = decoded(spark, sf)
    return frames.frames_with_person_in_roi(frames_of(det), det, F.lit(W), 0.97)


@query(
    "q_video_summary",
    """SELECT *, lpad(CAST(floor(duration_s / 60) AS INTEGER)::VARCHAR, 2, '0') || ':' ||
  lpad(CAST(trunc(duration_s % 60) AS INTEGER)::VARCHAR, 2, '0') AS duration
FROM (SELECT CAST(user_id % 8 AS BIGINT) AS race_id, 'cam' || (user_id % 2) AS camera_id,
  count(*) AS frames, CAST(user_id % 8 AS DOUBLE) * 5 AS fps,
  CASE WHEN user_id % 8 > 0 THEN count(*) / (CAST(user_id % 8 AS DOUBLE) * 5) ELSE 0 END
    AS duration_s
FROM events GROUP BY user_id % 8, user_id % 2)""",
)
def video_summary(spark, sf):
    u = F.col("user_id")
    rows = v.table(spark, sf, "events").select(
        (u % 8).alias("race_id"),
        F.concat(F.lit("cam"), (u % 2).cast("string")).alias("camera_id"),
        ((u % 8).cast("double") * 5).alias("fps"),
    )
    return frames.video_summary(rows)


# Every seventh detection stands for one that the tracker gave no id.
@query(
    "q_untracked",
    f"WITH {v.V_DET} SELECT race_id, camera_id, frame_ord, det_seq FROM v_det WHERE frame_ord % 7 <> 3",
)
def untracked(spark, sf):
    lost = F.when(F.col("frame_ord") % 7 != 3, F.col("track_id"))
    tracked = detections.drop_untracked(v.v_det(spark, sf).withColumn("track_id", lost))
    return tracked.select(*CAM, "frame_ord", "det_seq")


# --- annotations ------------------------------------------------------------------------


@query("q_yolo_norm", f"WITH {v.V_DOCS} SELECT * FROM v_label")
def yolo_norm(spark, sf):
    return annotate.labelme_to_yolo(v.v_docs(spark, sf))


@query(
    "q_label_text",
    f"WITH {v.V_DOCS}"
    + """ SELECT g.stem, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, cx, cy, w, h),
    chr(10) ORDER BY label_no), '') AS value
FROM v_good g LEFT JOIN v_label l ON g.stem = l.stem GROUP BY g.stem""",
)
def label_text(spark, sf):
    return annotate.label_text(v.v_docs(spark, sf))


@query("q_converted_count", f"WITH {v.V_DOCS} SELECT count(*) AS converted FROM v_good")
def converted_count(spark, sf):
    return annotate.converted_count(v.v_docs(spark, sf))


FILES = (
    f"WITH {v.V_LISTING}"
    + r""", j AS (SELECT path, regexp_extract(path, '([^/]+)\.[^.]*$', 1) AS stem FROM v_listing
  WHERE lower(path) LIKE '%.json'),
i AS (SELECT path, regexp_extract(path, '([^/]+)\.[^.]*$', 1) AS stem FROM v_listing
  WHERE path LIKE '%.jpg') """
)


@query(
    "q_pair_files",
    FILES + "SELECT j.stem, j.path AS json_path, i.path AS image_path FROM j JOIN i USING (stem)",
)
def pair_files(spark, sf):
    return annotate.pair_files(v.v_listing(spark, sf))


@query(
    "q_unpaired",
    FILES + "SELECT stem, path FROM j WHERE stem NOT IN (SELECT stem FROM i)",
)
def unpaired(spark, sf):
    return annotate.unpaired_files(v.v_listing(spark, sf))
