"""Rules, baselines and the primary summary are taken over all runs, not over some of them."""

from busward.catalog import inferential
from busward.operators import state


class Own:
    """Tables whose staged entities are given."""

    def __init__(self, **tables):
        self.tables = tables

    def staged(self, name, build):
        return self.tables[name]

    def context(self):
        return self.tables["context"]


def test_all_runs_count(spark):
    runs = range(11, 16)  # in the last two runs every rule misses the attack and alarms on a healthy row
    rows = [(run, "low_1_5", phase, int(phase == "error"), *[int((phase == "error") == (run < 14))] * len(state.MEMORY_RULES))
            for run in runs for phase in ("error", "view")]
    columns = ", ".join(f"policy__{r} int" for r in state.MEMORY_RULES)
    ruled = spark.createDataFrame(rows, f"run long, density_scenario string, phase string, ground_truth_attack int, {columns}")
    metric = spark.createDataFrame([(run, m, f1, fpr) for run in runs for m, f1, fpr in (
        ("a", 0.9 if run < 14 else 0.0, 0.0), ("b", 0.8, 0.0))], "run long, method string, f1 double, false_positive_rate double")
    t = Own(ruled=ruled, run_metrics=metric, context=ruled.select("run"))
    rules = inferential.e27(t).collect()
    assert len(rules) == len(state.MEMORY_RULES)
    assert all(r["runs"] == 5 and r["low_can_recall_mean"] == 0.6 and r["healthy_fpr_macro"] == 0.4 for r in rules)
    assert {r["method"]: r["selected"] for r in inferential.e28(t).collect()} == {"a": 0, "b": 1}
    summary = inferential.j7(t).first()
    assert (summary["runs"], summary["can_recall_mean"], summary["healthy_fpr_macro"]) == (5, 0.6, 0.4)
