"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["asof_join", "asof_join_bounded", "caf_matrix", "derive_known_to", "resolve_sec_id", "known_split_count", "pit_indicators", "weekly_weights", "actionable_timestamp", "idempotent_anti_join"]


def plain(v):
    if v is None or v != v:
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    want = sorted(repr([plain(dict(zip(order, r))[c]) for c in names]) for r in cursor.fetchall())
    assert got == want


def test_every_query_has_sql():
    from tempora.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["sec_id", "observation_timestamp", "event_id", "purchase"]


def test_plans_use_hash_joins(spark, sf):
    plan = entry.queries()["caf_matrix"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = entry.queries()["momentum_topn"](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in top
