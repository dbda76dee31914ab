"""Registered queries against their SQL. ALL_QUERIES=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as E
from check import compare, connect

SAMPLE = ["clean_category", "proxy_impact", "corridor_risk", "rank_corridors", "cause_medians", "simulate_impact",
          "recommend_batch", "validation_summary", "nearby_closure_share", "dbscan", "cluster_stats", "hot_cells",
          "quantile_spikes", "leaf_range_join", "stream_corridor_hour_counts", "auc_rank", "stratified_sample", "write_hotspots_geojson"]
NAMES = sorted(E.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    ok, message, _ = compare(spark, con, sf, name, E.queries()[name], E.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[0] == "corridor" or "risk_rank" in df.columns
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
