"""Registered queries against their check queries at the smallest scale.

A spread of queries runs by default; TRAJLYTICS_ALL=1 runs every one of them.
"""

import os

import pytest

from oracle import compare, connect
from trajlytics.queries import catalog

SAMPLE = [
    "backtest_minimum_slice", "a3_curve_subset", "a5_merge_segments", "b1_cycle_contract", "b7_fill_ledger", "b12_fingerprint_table", "c1_stable_group_split", "c7_fold_statistics", "c16_support_classes",
    "d1_early_cycle_features", "d4_delta_q_features", "d7_first_crossings", "e1_e4_base_forecasts", "e8_power_law", "e18_activation_gate", "e22_nearest_robust", "e30_credible_forecast", "g1_trajectory_scores",
    "g12_day_metrics", "h1_conformal_radius", "h14_issuance_decisions", "k1_censoring_curve", "k3_ipcw_brier", "q1_envelope_decisions", "q6_risk_coverage_curve", "t6_exact_sign_flip", "t10_assignment_bounds",
    "u1_future_label_firewall", "u9_collision_report", "f6_offset_posteriors",
]
NAMES = list(catalog.REGISTRY) if os.environ.get("TRAJLYTICS_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), name, catalog.callables()[name], catalog.checks().get(name), sf_dir)
    assert ok, message


def test_every_query_has_a_stable_schema():
    assert set(catalog.checks()) <= set(catalog.callables())
    assert len(catalog.callables()) >= 180
