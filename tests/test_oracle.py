"""Every registered query against its SQL counterpart on the small tables."""

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as contract
from paceline.catalog import all_queries, all_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


# Plans that would not scale.  A single partition is right only for a handful of
# rows: chunk counts, a total over stages, a count, and a range-free top-n.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition")
ONE_PARTITION = {"q_global_rank", "q_timing_report", "q_converted_count", "q_first_finishers"}


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of every table written on the way to a result."""
    seen = []
    write = DataFrameWriter.parquet

    def recording(self, path, *args, **kwargs):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recording)
    return seen


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck, sf_dir, plans):
    df = QUERIES[name](spark, sf_dir)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    bad = [word for word in FORBIDDEN if any(word in plan for plan in plans)]
    assert not bad or (name in ONE_PARTITION and bad == ["SinglePartition"])
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize(
    "name",
    ["q_relative_stats", "q_clock_asof", "q_clock_asof_races", "q_finisher_events", "q_edit_apply",
     "q_team_top3_first6", "q_dup_flag", "q_idle_skip"],
)
def test_without_broadcast(name, spark, duck, sf_dir, plans):
    """The way beyond the broadcast threshold gives the same rows."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        test_query_matches_sql(name, spark, duck, sf_dir, plans)
        assert not any("BroadcastHashJoin" in plan for plan in plans)
        assert any("SortMergeJoin" in plan for plan in plans)
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.set(key, value)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
