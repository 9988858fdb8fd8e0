"""Chunked order: same result for any partitioning, hot keys included."""

import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import ranking
from paceline.plans.ordered import CHUNK, fill_forward, middle_rows, ordered_index, previous, running_sum, sorted_chunks
from paceline.plans.sizing import shuffle_settings
from paceline.plans.skew import spread_join
from paceline.plans.tables import materialize, release, shared_folder


@pytest.fixture(params=[1, 4, 50])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def hot_rows(spark, n=3000):
    """Key 0 holds most rows; one key is NULL."""
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, None]), rng.randint(0, 50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, seq bigint").repartition(7)


def test_ordered_index(spark, partitions):
    rows, df = hot_rows(spark)
    got = {r.seq: r.n for r in ordered_index(df, ["k"], [F.col("t"), F.col("seq")], "n").collect()}
    want = {}
    for key in (0, 1, None):
        group = sorted((t, s) for k, t, s in rows if k == key)
        want.update({s: i for i, (_, s) in enumerate(group, 1)})
    assert got == want


def test_hot_key_spreads_over_chunks(spark, partitions):
    _, df = hot_rows(spark)
    chunks = sorted_chunks(df, ["k"], [F.col("t"), F.col("seq")])
    used = chunks.where("k = 0").select(CHUNK).distinct().count()
    assert used > partitions / 3


def test_fill_forward(spark, partitions):
    rows, df = hot_rows(spark)
    chunks = sorted_chunks(df, ["k"], [F.col("seq")])
    filled = fill_forward(chunks, ["k"], {"v": F.when(F.col("t") == 7, F.col("seq"))})
    got = {r.seq: r.v for r in filled.collect()}
    last, want = {}, {}
    for k, t, s in rows:
        if t == 7:
            last[k] = s
        want[s] = last.get(k)
    assert got == want


@pytest.mark.parametrize("times", [[5.0], [4.0, 8.0, 10.0], [-10.0, -5.0, 5.0, 10.0, 0.0], [0.0, 3.0], [None]])
def test_stats_median(spark, times):
    import statistics

    df = spark.createDataFrame(
        [(0, t, i) for i, t in enumerate(times)], "race_id bigint, finish_time_ms double, seq bigint"
    )
    got = ranking.finish_stats(df).first()
    known = [t for t in times if t is not None]
    ratios = [min(known) / t for t in known if t]
    assert got.winner_ms == (min(known) if known else None)
    assert got.median_winning == (pytest.approx(statistics.median(ratios)) if ratios else None)
    assert got.mean_winning == (pytest.approx(sum(ratios) / len(ratios)) if ratios else None)


def test_middle_rows(spark):
    n = F.col("id")
    lo, hi = middle_rows(n)
    got = spark.range(1, 6).select(lo, hi).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]


def test_tables_live_in_the_session_folder(spark):
    table = materialize(spark.range(3), "t")
    assert table.inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(
        shared_folder(spark)
    )
    assert release(spark) > 0


def test_spread_join(spark):
    _, big = hot_rows(spark)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k bigint, name string")
    got = spread_join(big, small, ["k"], F.col("seq"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").select(*got.columns).collect()))


def test_shuffle_settings(spark):
    small, large = shuffle_settings(10**9, 8), shuffle_settings(100 * 10**12, 8000)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert (small[key], large[key]) == ("16", "50000")


def test_running_sum(spark, partitions):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, None]), n, rng.choice([1, -1, 0, None])) for n in range(400)]
    df = spark.createDataFrame(rows, "k bigint, n bigint, d bigint").repartition(7)
    got = {(r["k"], r["n"]): r["total"] for r in running_sum(df, ["k"], [F.col("n").asc()], "d", "total").collect()}
    sums, want = {}, {}
    for k, n, d in rows:
        want[(k, n)] = sums[k] = sums.get(k, 0) + (d or 0)
    assert got == want


def test_previous_is_the_row_before_across_chunks(spark, partitions):
    rng = random.Random(8)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 9), k, f"v{k}") for k in range(300)]
    rng.shuffle(rows)
    chunks = sorted_chunks(spark.createDataFrame(rows, "g long, n long, v string"), ["g"], [F.col("n").asc()])
    got = {(r["g"], r["n"]): r["p"] for r in previous(chunks, ["g"], "v", "p").collect()}
    want, last = {}, {}
    for g, n, v in sorted(rows):
        want[g, n] = last.get(g)
        last[g] = v
    assert got == want
