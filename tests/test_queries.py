"""The driver contract, and a spread of registered queries against their check SQL at the smallest scale.

``python tests/oracle.py 0.01`` runs all of them.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["e3_average_precision", "e9_sweep_given_grid", "e13_evaluate_docs", "g6_loo_summary", "g6_warnings", "h2_paired_comparison", "b2_metric_contract",
          "b16_config_signature", "b20_config_violations", "c4_patches", "c6_stitched_map", "d4_stratified_batches", "f1_map_stats", "f2_components", "i12_selected_proposals",
          "i14_blockers", "i22_leaderboard", "i26_linked_loo", "j1_mined_tiles", "k1_streaming_dice", "l1_predicted_map"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 180
