"""Scalar rules on literal inputs, one row per quirk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.functions import clean, times


def evaluate(spark, expression, schema, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_parse_mmss(spark):
    cases = {
        "01:23.45": 83450.0, "1:2.5": 62050.0, "01:23.456": 87560.0, "bad": -1.0, "": -1.0,
        "1:2": -1.0, "1:2:3.4": -1.0, "1:2.3.4": -1.0, " 1 : 2 . 3 ": 62030.0, "-1:00.00": -60000.0,
        "99:99.99": 6039990.0, None: None,
    }
    assert evaluate(spark, times.parse_mmss, "string", list(cases)) == list(cases.values())
    strict = evaluate(spark, lambda c: times.parse_mmss(c, True), "string", ["1:2.5", "1:2.345"])
    assert strict == [62500.0, 62345.0]


def test_parse_edit_time(spark):
    got = evaluate(spark, times.parse_edit_time, "string", ["1:2.5", "1234.5", "-1:0.0", "x", None, "NaN", "5d", " 7 "])
    assert got == [62050.0, 1234.5, None, None, None, None, None, 7.0]


def test_parse_cell(spark):
    values = ["01:23.45", "1:2", "", " ", "90", "1:2:3", "x:1", "2m:3.5s"]
    got = [tuple(x) for x in evaluate(spark, times.parse_cell, "string", values)]
    assert got == [
        (True, 83450.0), (True, 62000.0), (True, None), (True, None), (False, None),
        (False, None), (True, None), (True, 123500.0),
    ]


def py_mmss(ms):
    if ms is None:
        return ""
    total = int(ms // 1000)
    return f"{total // 60:02d}:{total % 60:02d}.{int((ms % 1000) / 10):02d}"


def test_fmt_mmss(spark):
    values = [0.0, 321350.0, 83456.7, 6_000_000.0, -500.0, -61_234.0, None, 59_999.99]
    assert evaluate(spark, times.fmt_mmss, "double", values) == [py_mmss(v) for v in values]
    assert evaluate(spark, times.fmt_mmss_ui, "double", [321350.0, None, math.nan, -500.0]) == [
        "05:21.35", "00:00.00", "00:00.00", "-1:-1.-50",
    ]


def test_fmt_signed_and_elapsed(spark):
    assert evaluate(spark, times.fmt_signed, "double", [61500.0, -61500.0, 0.0]) == [
        "01:01.50", "-01:01.50", "00:00.00",
    ]
    assert evaluate(spark, times.fmt_elapsed, "double", [59.9, 3661.0]) == ["00:59", "61:01"]
    # Minutes have two digits at least, as the reference's ``:02d``; none is cut off.
    assert evaluate(spark, times.fmt_elapsed, "double", [7519.8, 60000.0]) == ["125:19", "1000:00"]
    assert evaluate(spark, times.fmt_video, "double", [1290.0, 4350.0]) == ["00:01.29", "00:04.34"]


def test_fixed_rounds_like_printf(spark):
    rng = random.Random(5)
    values = [0.1328125, 0.1234565, 0.0000005, -0.0000005, 1.0, 0.0, 2.5, 123.4565, -1e-9, 12345.6789]
    values += [rng.random() * 10 ** rng.randint(-6, 3) for _ in range(500)]
    values += [rng.randint(0, 10**7) / 2e6 for _ in range(500)]
    values += [rng.randint(0, 4096) / 4096 for _ in range(200)]
    for digits in (1, 3, 6):
        got = evaluate(spark, lambda c, d=digits: times.fixed(c, d), "double", values)
        assert got == [f"{v:.{digits}f}" for v in values]


def test_fixed_beyond_exact_integers(spark):
    values = [1e13, 9.1e15, 1e20, -1e13, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(times.fixed(F.col("v"), 6).alias("t"))
    assert [r.t for r in df.collect()] == [None if v is None else f"{v:.6f}" for v in values]


def test_normalize_epoch(spark):
    def rule(c):
        return times.normalize_epoch(c, F.lit(1.6e9), F.lit(500.0))

    values = [1.6e12 + 61000.4, 1.6e12 - 5.0, 42.0, None]
    assert evaluate(spark, rule, "double", values) == [60500.0, 0.0, 42.0, None]
    no_start = lambda c: times.normalize_epoch(c, F.lit(None), F.lit(0.0), null_as=0)
    assert evaluate(spark, no_start, "double", [2e12, None]) == [2e12, 0.0]


def test_clock_rules(spark):
    df = spark.createDataFrame(
        [("running", 10.0), ("stopped", 10.0), ("running", None)], "s string, st double"
    )
    args = (F.lit(12.5), F.col("st"), F.lit(7.0), F.col("s"))
    got = df.select(times.race_time(*args), times.quick_add_ms(*args), times.official_ms(*args))
    assert [tuple(r) for r in got.collect()] == [(2507.0, 2507.0, 2507.0), (7.0, 7.0, None), (7.0, 7.0, None)]


def test_lag(spark):
    df = spark.createDataFrame([(10.0, 4.0), (0.0, 4.0)], "e double, v double")
    got = df.select(times.lag_speed(F.col("e"), F.col("v"))["text"]).collect()
    assert [r[0] for r in got] == ["Lag: 6.0s (Speed: 0.4x)", "Lag: Calculating..."]


def test_gender_and_age(spark):
    values = ["man", "F", "woman", "x", "", None, " m"]
    assert evaluate(spark, clean.norm_gender, "string", values) == ["M", "W", "W", "X", None, None, " M"]
    ages = [9.0, 12.0, 15.0, 19.0, 20.0, None]
    assert evaluate(spark, clean.age_band, "double", ages) == [
        "Age 7 - 9", "Age 10 - 12", "Age 13 - 15", "Age 16 - 18", "Age 19 and up", "Age 19 and up",
    ]
    assert evaluate(spark, clean.default_age, "double", ages)[-1] == 100
    assert evaluate(spark, clean.recode_gender, "string", ["M", "F", "q", None]) == ["Male", "Female", "q", None]


@pytest.mark.parametrize(
    "name, want",
    [(" Ann  Mary\tLee ", ("Ann", "Mary Lee")), ("Bo", ("Bo", "")), ("", ("", "")), (None, ("", ""))],
)
def test_split_name(spark, name, want):
    assert tuple(evaluate(spark, clean.split_name, "string", [name])[0]) == want


def test_bib_sort_key(spark):
    got = evaluate(spark, clean.bib_sort_key, "string", [" 07 ", "+5", "Unknown-3", None, "9" * 20])
    assert got == [7.0, 5.0, math.inf, math.inf, 1e20]


def test_files_and_labels(spark):
    paths = ["/a/b/img.1.json", "x.JSON", "/a/none", "/a/.json"]
    assert evaluate(spark, clean.file_stem, "string", paths) == ["img.1", "x", "none", ".json"]
    assert evaluate(spark, clean.file_ext, "string", paths) == ["json", "JSON", "", ""]
    label = lambda c: clean.track_label(F.lit(7), F.lit("12"), c)
    assert evaluate(spark, label, "double", [0.995, None]) == [
        "Racer ID 7 | Bib: 12 (0.99)", "Racer ID 7 | Bib: 12",
    ]
    assert evaluate(spark, lambda c: clean.quick_bib(c, F.lit(4)), "string", [" 9 ", " "]) == ["9", "No-Bib-5"]
