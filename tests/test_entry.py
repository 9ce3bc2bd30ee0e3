"""Driver contract and oracle equality on the smallest scale."""

import pytest

import __spark_entry__ as entry
from formbook.plans import registry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
CORE = ["deliveries_enriched", "batting_innings", "bowling_innings", "batting_form_recent",
        "bowling_form_t20_leagues", "bowler_profile", "batter_profile", "resolve_names", "league_summary",
        "bid_validation", "notes_validate", "activity_over_time", "similar_topk", "bronze_silver_roundtrip",
        "snapshot_diff", "log_sync", "manifest_skip", "partition_listing", "articles_append", "column_backfill",
        "case_folded_table", "tool_call_log", "squad_counts", "auction_targets_filtered", "role_inference",
        "franchise_squads", "competition_ingest", "inferred_matches", "event_time_sync", "event_time_progress",
        "typed_table"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["batter_key", "player_name", "innings", "runs", "balls_faced", "strike_rate",
                          "regressed_strike_rate"]


def test_every_query_has_oracle_or_is_declared():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", CORE)
def test_oracle_equal_sf0001(spark, name):
    qs, orc = entry.queries(), entry.oracle_sql()
    assert compare(spark, duck(SF), name, qs[name], orc[name], SF)


def test_no_cross_product_in_any_plan(spark):
    """Every registered query plans without CartesianProduct or
    BroadcastNestedLoopJoin."""
    bad = []
    for name, fn in sorted(registry.QUERIES.items()):
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        bad += [(name, op) for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
    assert bad == []
