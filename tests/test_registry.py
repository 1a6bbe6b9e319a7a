"""Registered queries against DuckDB, and the shape of their plans."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from fieldwatch.plans.registry import ENTRIES

SF = os.environ.get("FIELDWATCH_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


COMPARED = [n for n, e in ENTRIES.items() if e.body]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x) if not isinstance(x, (int, float)) else "", x if isinstance(x, (int, float)) else 0) for x in r))


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, oracle, name):
    entry = ENTRIES[name]
    df = entry.run(spark, SF)
    cur = oracle.execute(entry.sql)
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = ordered([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])
    got = ordered([tuple(r[c] for c in cols) for r in df.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * max(1, abs(x)))
                   for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["g1_add_segments", "g5_hysteresis", "g8_threshold_labels", "w1_w3_state_features", "w13_number_episodes",
                                  "j3_asof_nearest", "a1_hourly_readings", "c3_dedupe_most_complete", "e4_threshold_episodes", "h17_health_scores"])
def test_no_single_task_sort(spark, name):
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["g1_add_segments", "g5_hysteresis", "g8_threshold_labels", "w1_w3_state_features", "g2_add_sequences",
                                  "w13_number_episodes"])
def test_raw_series_are_never_ordered_by_key_alone(spark, name):
    """Windows by key alone may only see one summary row per time block."""
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    orders = re.findall(r"\], \[site_id#\d+L\], \[(\w+)#", plan)
    assert orders and set(orders) == {"_block"}


@pytest.mark.parametrize("name", ["g1_add_segments", "g2_add_sequences", "g5_hysteresis", "g8_threshold_labels", "e4_threshold_episodes", "e6_refresh_status"])
def test_raw_rows_are_read_and_dealt_once_per_scan(spark, name):
    """After the stored block rows, only summaries and halo copies move: the events are not read again."""
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 1, plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = ENTRIES["s7_scan_since"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan
