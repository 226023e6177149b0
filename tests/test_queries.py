"""Every registered query against its SQL; the core ones again in the blocked layout."""

import pytest
from compare import compare, connection

from seriesloom.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BLOCKED = [
    "w1_strongest_moments", "d1_smooth_modes", "d6_curvature_torsion", "w2_energy_ticks", "w5_two_rail_keyframes",
    "w9_leaky_sum", "w12_first_alarm", "w14_onset_estimate", "a6_decile_rates", "a8_error_summary", "f5_spectral_centre",
    "f11_peak_hold", "f16_tempo", "j1_as_of_join", "j2_two_sided_blend", "h2_bar_recall", "h3_h4_linked_ledger", "b3_impact_angle", "st1_tick_stream", "st4_cusum_stream",
]


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_oracle_names_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], con, SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_layout_equals_sql(spark, con, blocks, name):
    blocks(20)
    assert compare(spark, name, QUERIES[name], ORACLES[name], con, SF) is None


def test_rows_only_queries_do_not_depend_on_the_layout(spark, blocks):
    for name in ("f17_state_bands", "b12_monitor", "h6_greedy_pool", "h8_threshold_sweep"):
        blocks(1 << 20)
        plain = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str)
        blocks(20)
        assert sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str) == plain, name
