"""A cross-section of the registered queries against their SQL twins; ``tests/compare.py`` runs all of them."""

import pytest

from tests.compare import compare, connect
from tidemark.workloads import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "P5_dates", "P20_sample", "S5_split_sink", "S7_metric_report", "J1c_gifts", "U1_interactions", "J3_vectors",
    "A4_click_priority", "A13_accounting", "A17_profile", "E2_vocabulary", "E6_clip_std", "W3_click_user",
    "W13_click_room", "W21_events_streamer", "W23_recency_user_streamer", "J5_rule_candidates", "T7_retrieve",
    "T12_mmr_blended", "M1_auc", "M13_overlap", "R5_rebalance", "R6_hard_negatives",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_every_query_is_named_and_paired():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"R9_ranker"}
