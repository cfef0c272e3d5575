"""Registered queries must equal DuckDB.

A cross-section of the operator groups runs by default; BUSWARD_ALL=1 runs every query with SQL.
"""

import os

import pytest

from busward.catalog import QUERIES
from tests.compare import DATA, difference, duck

FOLDER = str(DATA / "sf0.01")
EVERY = [n for n, q in QUERIES.items() if q.body is not None]
SECTION = ("session_gate_metrics", "w1_count_windows", "w3_structural_features", "w5_timing_features", "w7_interval_phase",
           "w8_signature_match", "w10_content_hash", "w13_baseline_split", "w14_window_reducers", "v2_file_audit", "v8_inversions",
           "v11_class_coverage", "p2_hash_split", "p5_stratified_split", "p15_disjoint_allocation", "p17_contaminated_baselines",
           "p19_balanced_sample", "j1_ordinal_replay", "j6_alignment_audit", "j9_ego_neighbours", "a6_conformal_threshold", "a12_source_attribution",
           "a22_ecdf", "m4_roc_auc", "m7_best_f1_threshold", "m9_threshold_grid", "m10_quantile_threshold", "t1_motion", "t3_hysteresis",
           "t5_memory_rules", "t6_trust_memory", "t8_first_detection", "t3_streaming_monitor", "e9_reference_guard", "e18_access_decision",
           "e22_graded_policy", "e24_perturbed_evaluation", "e25_observability", "i1_bootstrap_interval", "i7_noninferiority", "i9_sparse_recall", "e27_rule_selection",
           "s2_variable_csv", "s5_typed_csv")
CHECKED = EVERY if os.environ.get("BUSWARD_ALL") else list(SECTION)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_duckdb(spark, name):
    problem = difference(QUERIES[name].run(spark, FOLDER), duck(FOLDER), QUERIES[name].sql())
    assert problem is None


def test_models_beat_chance_and_shuffled_labels_do_not(spark):
    fitted = QUERIES["l1_logistic_regression"].run(spark, FOLDER).first()
    assert fitted["roc_auc"] > 0.7
    precision = QUERIES["e10_precision_profile"].run(spark, FOLDER).collect()
    assert precision and all(0.0 <= r["shrinkage"] <= 1.0 for r in precision)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
