"""Input and output schemas, as Spark DDL."""

_CAMERA = "race_id bigint, camera_id string"

DETECTION = (
    f"{_CAMERA}, frame_ord bigint, video_ms double, wall_ts double, det_seq int, "
    "track_id bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
)
FRAME = (
    f"{_CAMERA}, frame_ord bigint, video_ms double, wall_ts double, width int, height int, "
    "fps double"
)
OCR_READ = (
    f"{_CAMERA}, track_id bigint, frame_ord bigint, det_seq int, bib_read string, "
    "ocr_conf double, yolo_conf double"
)
OCR_CANDIDATE = (
    f"{_CAMERA}, crop_id bigint, cand_seq int, text string, confidence double"
)
FRAME_FEED = (
    f"{_CAMERA}, frame_ord bigint, video_ms double, wall_ts double, width int, height int, "
    "detections array<struct<det_seq:int, track_id:bigint, cls:int, conf:double, "
    "x1:double, y1:double, x2:double, y2:double>>, "
    "reads array<struct<track_id:bigint, det_seq:int, bib_read:string, ocr_conf:double>>"
)
FINISHER_EVENT = (
    "race_id bigint, event_id string, bib_number string, wall_clock_s double, "
    "finish_time_ms double, finish_time_str string, racer_name string, gender string, "
    "team string, age string, arrival_ts timestamp"
)
RESULT = (
    "race_id bigint, id string, bib_number string, racer_name string, "
    "finish_time_ms double, rank bigint, gender string, team string, age string, seq bigint"
)
ROSTER = (
    "race_id bigint, bib_number string, racer_name string, gender string, team string, "
    "age string"
)
CLOCK_EVENT = "race_id bigint, ts_s double, seq bigint, action string, arg_ms double"
CHANGE = (
    "race_id bigint, change_seq bigint, type string, id string, "
    "data struct<bib_number:string, racer_name:string, finish_time_ms:double, "
    "gender:string, team:string, rank:bigint>"
)
EDIT = "race_id bigint, id string, fields map<string,string>"
ANNOTATION = (
    "imageWidth double, imageHeight double, "
    "shapes array<struct<label:string, shape_type:string, points:array<array<double>>>>"
)
STARTER_LIST = (
    "Bib double, `First Name` string, `Last Name` string, Gender string, Age double"
)
STAGE_TIMING = "stage string, seconds double"

RESULT_COLUMNS = (
    "race_id", "id", "bib_number", "racer_name", "finish_time_ms",
    "rank", "gender", "team", "age", "seq",
)
