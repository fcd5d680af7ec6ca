"""Queries against their SQL on the smallest tables: one query of each kind (all of them with ALL_QUERIES=1)."""

import os

import pytest

from panelforge.plans import registry

from .compare import oracle_rows, rows_of

SAMPLE = (
    "a1_hash_aggregate a6_quantiles c1_walk_forward c5_purged_kfold d1_ttm d20_short_positions d30_continuous_contract f6_normal f8_json g1_correlation_graph "
    "g7_components g8_pagerank g10_knn k6_dim_security j1_asof j3_asof_forward j5_intervals j6_statement_join k9_calendar_padding k11_business_days k18_action_adjustment k23_interval_coalescing "
    "m2_rank_ic m4_deciles m6_ndcg n4_score_ranges n5_range_evaluation p4_hysteresis p5_risk_neutralisation p8_long_short_returns p14_cost_aware_targets q1_newey_west "
    "r1_ema r9_atr r23_kama s5_month_shards s7_upsert t3_percentile_selection t6_feature_pairs u2_dedup_keep_last w4_left_closed_mean w8_left_closed_quantile "
    "d17_short_market d19_short_by_sector g9_closeness g11_peer_sets p16_portfolio_metrics q4_overfitting q7_granger s2_parse_quotes s5_shard_index x13_sector_aggregates x15_within_sector "
    "d15_margin_daily d15_margin_weekly r_technical_block r27_products d43_regime_block d44_coin_series p18_regime_signals "
    "w16_beta_alpha w29_price_freeze x1_average_rank x12_peers x20_target_encoding y8_parity y10_leak_checks"
).split()
NAMES = sorted(registry.oracles()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf, name):
    assert rows_of(registry.queries()[name](spark, sf)) == oracle_rows(registry.oracles()[name], sf)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(registry.queries()) - set(registry.oracles()) == {"n3_spectral_residual", "n7_platt", "g9_core_number"}
