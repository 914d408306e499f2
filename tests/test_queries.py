"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.queries import plans, relational, timelines

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**timelines.QUERIES, **relational.QUERIES, **plans.QUERIES}
SQL = {**timelines.SQL, **relational.SQL, **plans.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        text = df[c].dtype == object or str(df[c].dtype).startswith(("str", "bool"))
        df[c] = df[c].map(lambda x: None if pd.isna(x) else str(x)) if text else df[c].astype(float).round(6)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf, name):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-6)


def test_bootstrap_of_many_clusters(spark, tmp_path):
    """More clusters than the root of 2^31, whose squared numbers don't fit 32 bits."""
    events = "SELECT i AS event_id, i AS user_id, CAST(i * 37 % 101 AS DOUBLE) AS value FROM range(50000) r(i)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS {events}")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(SQL["bootstrap_stat"].replace("range(1000)", "range(5)")).df()
    pd.testing.assert_frame_equal(canonical(relational.bootstrap_stat(spark, str(tmp_path), rounds=5).toPandas()), canonical(want), check_dtype=False)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_of_rows_read_them_without_sorting(spark):
    """All checks of single rows in one pass, repeated keys by counting: no window sorts the wide rows once a check."""
    from tidemark.operators import quality
    from tidemark.schemas import COUNTERS

    base = {"season": 1, "gamecode": 1, "player_id": "a", "team_code": "T", "minutes": 5.0, "dnp": False, "points": 0} | {c: 0 for c in COUNTERS}
    changes = [{}, {}, {"player_id": None}, {"player_id": None}, {"player_id": "b", "points": 3}, {"player_id": "c", "minutes": 0.0}, {"player_id": "d", "dnp": True}, {"player_id": "e", "fg2_att": -1}]
    kinds = ", ".join(f"{k} {'string' if k.endswith(('_id', '_code')) else 'double' if k == 'minutes' else 'boolean' if k == 'dnp' else 'int'}" for k in base)
    found = quality.box_score_issues(spark.createDataFrame([tuple((base | c).values()) for c in changes], kinds))
    got = sorted((r.check, str(r.key)) for r in found.collect())
    want = [("duplicate_key", "None")] * 2 + [("duplicate_key", "a")] * 2 + [("missing_values", "")] * 2 + [("points_formula", "b"), ("zero_minutes_not_dnp", "c"), ("dnp_with_stats", "d"), ("made_exceeds_attempted", "e"), ("negative_stat", "e")]
    assert got == sorted(want)
    assert "Window" not in plan_of(found)


def test_written_rows_lie_in_bounded_files(spark, monkeypatch):
    from tidemark.operators import scratch

    monkeypatch.setattr(scratch, "FILE_ROWS", 100)
    before = spark.conf.get(scratch.CODE_LIMIT[0])
    df = scratch.written(spark.range(0, 1000, numPartitions=1), "bounded")
    assert len(df.inputFiles()) == 10 and df.count() == 1000 and spark.conf.get(scratch.CODE_LIMIT[0]) == before
