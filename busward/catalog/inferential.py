"""Queries over run-level inference, rule selection and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.context import alarm_union, perturbed_runs, run_metrics
from busward.catalog.frames import rates_sql
from busward.catalog.registry import cte, query
from busward.catalog.statistics import clustered
from busward.operators import inference, metrics, policy, quality, resampling, splits, state, stats
from busward.operators.ordering import attach
from busward.plans import can_gate, replay
from busward.plans.replay import UNIT

_num = "('0x' || substr(md5({}), 1, 8))::BIGINT"
PROPOSED = "proposed_persistent_without_vehicle_state"
BASELINES = ("context_only_without_vehicle_state", "frozen_w100_persistent_without_vehicle_state", "legacy_weighted_threshold")
B = inference.BOOTSTRAP_REPLICATES


def _scrambled(table: str) -> str:
    """x of a table through the rounds of resampling.draw_numbers."""
    for constant in resampling.ROUNDS:
        p = resampling.PRIME
        table = f"""(SELECT * EXCLUDE (y, q), q * q % {p} * y % {p} AS x FROM (SELECT *, y * y % {p} AS q FROM (SELECT * EXCLUDE (x), (x + {constant}) % {p} AS y FROM {table})))"""
    return table


def boot_ctes(name: str, units: str, key: str, unit: str, value: str) -> None:
    """Bootstrap of `units` (a SELECT) by one key, from the same draws, for keys of one block; groups are joined by number."""
    p = resampling.PRIME
    replicate = _scrambled(f"(SELECT b, (17 + b) % {p} AS x FROM range({B}) r(b))")
    cte(**{
        f"{name}_u": f"SELECT {key}, {_num.format(f'{key}::VARCHAR')} AS cid, {unit} AS unit, {value} AS v FROM ({units}) WHERE {value} IS NOT NULL",
        f"{name}_n": f"""SELECT cid, v, row_number() OVER (PARTITION BY cid ORDER BY {_num.format("'17|unit|' || unit")}, unit) - 1 AS slot,
  count(*) OVER (PARTITION BY cid) AS n FROM {name}_u""",
        # A draw's number is the same for all keys, so it is made once for the most units of any.
        f"{name}_d": f"SELECT b, d, x FROM {_scrambled(f'(SELECT b, d, (x + d) % {p} AS x FROM {replicate}, range((SELECT max(n) FROM {name}_n)) u(d))')}",
        f"{name}_l": f"SELECT cid, list(v ORDER BY slot) AS vals FROM {name}_n GROUP BY cid",
        f"{name}_m": f"SELECT cid, b, avg(vals[x % len(vals) + 1]) AS m FROM {name}_l JOIN {name}_d ON d < len(vals) GROUP BY cid, b",
        f"{name}_ci": f"""SELECT {key}, n_units, mean, CASE WHEN n_units > 1 THEN lo END AS ci_low, CASE WHEN n_units > 1 THEN hi END AS ci_high FROM
  (SELECT {key}, cid, count(v) AS n_units, avg(v) AS mean FROM {name}_u GROUP BY {key}, cid) JOIN (SELECT cid, quantile_cont(m, 0.025::DOUBLE) AS lo,
    quantile_cont(m, 0.975::DOUBLE) AS hi FROM {name}_m GROUP BY cid) USING (cid)""",
    })


boot_ctes("boot_f1", "SELECT density_scenario || '/' || method AS cell, run, f1 FROM run_metrics", "cell", "run", "f1")


@query("i1_bootstrap_interval", "density_scenario method n_units:i mean:d ci_low:d ci_high:d", 
       "SELECT *, split_part(cell, '/', 1) AS density_scenario, split_part(cell, '/', 2) AS method FROM boot_f1_ci")
def i1(t):
    return inference.bootstrap_interval(run_metrics(t), ["density_scenario", "method"], "run", "f1")


boot_ctes("boot_cl", "SELECT binary_target, cluster, avg(multi_instant) AS rate FROM clustered GROUP BY 1, 2", "binary_target", "cluster", "rate")


@query("i2_cluster_bootstrap", "binary_target:i n_units:i mean:d ci_low:d ci_high:d", "SELECT * FROM boot_cl_ci")
def i2(t):
    clusters = clustered(t).groupBy("binary_target", "cluster").agg(F.avg("multi_instant").alias("rate"))
    return inference.bootstrap_interval(clusters, ["binary_target"], "cluster", "rate")


METRICS = ("f1", "recall", "false_positive_rate")
_long = ("SELECT run, source_file, density_scenario, method, p.m AS metric, p.v AS v FROM (SELECT *, unnest(["
         + ", ".join(f"{{'m': '{m}', 'v': {m}}}" for m in METRICS) + "]) AS p FROM run_metrics)")
cte(
    long_runs=_long,
    pairs=f"""SELECT a.run, a.source_file, a.density_scenario, a.metric, b.method AS baseline_method, a.v AS proposed, b.v AS baseline, a.v - b.v AS difference
  FROM long_runs a JOIN long_runs b ON a.run = b.run AND a.metric = b.metric AND a.method = '{PROPOSED}' AND b.method IN {BASELINES}""",
)


def pairs(t):
    return inference.paired(run_metrics(t), UNIT, "method", PROPOSED, BASELINES, METRICS)


@query("j10_paired_methods", "run:i source_file density_scenario metric baseline_method proposed:d baseline:d difference:d", "SELECT * FROM pairs")
def j10(t):
    return pairs(t)


def kept_pairs(t):
    """The pairs, staged for queries whose numbering, blocks and sizes each read them once more."""
    return t.staged("pairs", lambda: pairs(t))


def flip_p(t):
    return t.staged("flip_p", lambda: inference.sign_flip(
        kept_pairs(t), ["density_scenario", "metric", "baseline_method"], "run", "difference"))


@query("i3_sign_flip", "density_scenario metric baseline_method n_units:i observed:d p_two_sided:d p_one_sided:d", None)
def i3(t):
    return flip_p(t)


@query("i4_holm", "density_scenario metric baseline_method p_two_sided:d p_holm:d significant:i",
       None)
def i4(t):
    return inference.holm(flip_p(t), ["density_scenario", "metric"], "p_two_sided", "baseline_method")


@query("i5_summary_interval", "density_scenario method runs:i f1_mean:d ci_low:d ci_high:d",
       f"""SELECT *, f1_mean - c * f1_std / sqrt(runs) AS ci_low, f1_mean + c * f1_std / sqrt(runs) AS ci_high FROM (SELECT *,
    CASE WHEN runs BETWEEN 2 AND 31 THEN {[float(x) for x in inference.T_CRITICAL]}[runs - 1]::DOUBLE WHEN runs > 31 THEN 1.96e0 END AS c FROM (
      SELECT density_scenario, method, count(*) AS runs, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std FROM run_metrics GROUP BY 1, 2))""")
def i5(t):
    return inference.summary_interval(stats.run_summary(run_metrics(t), ["density_scenario", "method"], ["f1"]), "f1_mean", "f1_std", "runs")


@query("i6_paired_comparison", "density_scenario metric baseline_method n_pairs:i proposed_mean:d baseline_mean:d mean_difference:d benefit_effect:d "
       "standardized_effect:d ci_low:d ci_high:d p_two_sided:d",
       None)
def i6(t):
    keys = ["density_scenario", "metric", "baseline_method"]
    interval = inference.bootstrap_interval(kept_pairs(t), keys, "run", "difference").select(*keys, "ci_low", "ci_high")
    flips = flip_p(t).select(*keys, "p_two_sided")
    return inference.paired_effects(kept_pairs(t), ["density_scenario"]).join(interval, keys).join(flips, keys)


boot_ctes("boot_loss", "SELECT target || '/' || density_scenario AS cell, run, f1_loss FROM perturbed_runs WHERE scenario = 'missing_full_session'",
          "cell", "run", "f1_loss")
cte(
    loss_checks="""SELECT 'H4' AS hypothesis, 'missing_full_session' AS scenario, split_part(cell, '/', 1) AS target, split_part(cell, '/', 2) AS density_scenario,
  ci_high AS observed_value, CASE WHEN ci_high <= 0.1e0 THEN 1 ELSE 0 END AS passed FROM boot_loss_ci WHERE NOT starts_with(cell, 'can/')
  UNION ALL SELECT 'H5', scenario, target, density_scenario, sum(unsafe_allow_count) / greatest(sum(attack_rows), 1)::DOUBLE,
    CASE WHEN sum(unsafe_allow_count) = 0 AND sum(high_risk_allow_count) = 0 THEN 1 ELSE 0 END FROM perturbed_runs
    WHERE scenario IN ('compromised_detected_false_healthy', 'compromised_undetected_false_healthy', 'conflicting_high_risk') GROUP BY 1, 2, 3, 4""",
)


def loss_checks(t):
    runs = perturbed_runs(t)
    missing = runs.where(F.col("scenario") == "missing_full_session")
    h4 = inference.bootstrap_interval(missing, ["scenario", "target", "density_scenario"], "run", "f1_loss").where(
        F.col("target") != "can").select(F.lit("H4").alias("hypothesis"), "scenario", "target", "density_scenario",
                                         F.col("ci_high").alias("observed_value"),
                                         F.coalesce((F.col("ci_high") <= 0.10).cast("int"), F.lit(0)).alias("passed"))
    h5 = runs.where(F.col("scenario").isin("compromised_detected_false_healthy", "compromised_undetected_false_healthy",
                                           "conflicting_high_risk")).groupBy("scenario", "target", "density_scenario").agg(
        (F.sum("unsafe_allow_count") / F.greatest(F.sum("attack_rows"), F.lit(1))).alias("observed_value"),
        ((F.sum("unsafe_allow_count") == 0) & (F.sum("high_risk_allow_count") == 0)).cast("int").alias("passed"))
    return h4.unionByName(h5.select(F.lit("H5").alias("hypothesis"), "scenario", "target", "density_scenario", "observed_value", "passed"))


@query("i7_noninferiority", "hypothesis scenario target density_scenario observed_value:d passed:i", "SELECT * FROM loss_checks")
def i7(t):
    return loss_checks(t)


cte(
    endpoint=f"""SELECT avg(recall) FILTER (method = '{PROPOSED}') AS recall, avg(false_positive_rate) FILTER (method = '{PROPOSED}') AS fpr,
  max(false_positive_rate) FILTER (method = '{PROPOSED}') AS worst, count(*) FILTER (method = '{PROPOSED}') AS runs, count(DISTINCT run) AS units FROM run_metrics""",
    accept_rows="""SELECT 'overall_recall' AS criterion, recall AS observed_value, '>=' AS operator, 0.8e0 AS required_value, CASE WHEN recall >= 0.8e0 THEN 1 ELSE 0 END AS passed FROM endpoint
  UNION ALL SELECT 'macro_fpr', fpr, '<=', 0.05e0, CASE WHEN fpr <= 0.05e0 THEN 1 ELSE 0 END FROM endpoint
  UNION ALL SELECT 'missing_units', runs - units, '==', 0e0, CASE WHEN runs - units = 0 THEN 1 ELSE 0 END FROM endpoint""",
)


@query("i8_acceptance", "criterion observed_value:d operator required_value:d passed:i",
       """SELECT * FROM accept_rows UNION ALL SELECT 'all_criteria', min(passed)::DOUBLE, '==', 1e0, min(passed) FROM accept_rows""")
def i8(t):
    mine = F.col("method") == PROPOSED
    row = run_metrics(t).agg(
        F.avg(F.when(mine, F.col("recall"))).alias("recall"), F.avg(F.when(mine, F.col("false_positive_rate"))).alias("fpr"),
        F.sum(mine.cast("int")).alias("runs"), F.countDistinct("run").alias("units"))
    return inference.acceptance(row, {
        "overall_recall": (F.col("recall"), ">=", 0.80), "macro_fpr": (F.col("fpr"), "<=", 0.05),
        "missing_units": (F.col("runs") - F.col("units"), "==", 0)}, "all_criteria")


@query("i9_hypotheses", "hypothesis tests:i passed:i assessment", None)
def i9(t):
    n = F.count(F.lit(1)).alias("tests")
    h1 = inference.holm(flip_p(t), ["density_scenario", "metric"], "p_two_sided", "baseline_method").where(F.col("metric") == "f1").agg(
        n, F.sum(((F.col("significant") == 1) & (F.col("observed") > 0)).cast("int")).alias("passed")).withColumn("hypothesis", F.lit("H1"))
    primary = stats.run_summary(run_metrics(t).where(F.col("method") == PROPOSED), ["density_scenario"], ["f1", "false_positive_rate"])
    h2 = primary.agg(n, F.sum(((F.col("f1_mean") >= 0.9) & (F.col("false_positive_rate_mean") <= 0.05)).cast("int")).alias("passed")) \
        .withColumn("hypothesis", F.lit("H2"))
    rest = loss_checks(t).groupBy("hypothesis").agg(n, F.sum("passed").alias("passed"))
    h3 = sparse_recall(t).select(F.lit("H3").alias("hypothesis"), F.lit(1).cast("bigint").alias("tests"), F.col("passed").cast("bigint").alias("passed"))
    return h1.unionByName(h2).unionByName(rest).unionByName(h3).withColumn(
        "assessment", F.when(F.col("tests") == F.col("passed"), "supported").otherwise("not_supported"))


def sparse_recall(t):
    """H3, descriptive: the chosen memory rule against single windows at one to five attack frames of a hundred."""
    # Rules keep state within a run, so those of the development runs need no other rows.
    rows = t.staged("development", lambda: development(t, replay.decisions(t)))
    chosen = chosen_rule(with_rules(rows)).where(F.col("selected") == 1).select(
        "rule", F.col("low_can_recall_mean").alias("selected_recall"), F.col("overall_fpr_mean").alias("selected_fpr"))
    sparse = can_gate.multiscale(t).where(F.col("attack_frame_count").between(1, 5)).agg(F.avg("w100_instant").alias("window_recall"))
    better = (F.col("selected_recall") > F.col("window_recall")) & (F.col("selected_fpr") <= LIMIT)
    return attach(chosen, sparse, []).withColumn("passed", F.coalesce(better.cast("int"), F.lit(0)))


@query("i9_sparse_recall", "rule selected_recall:d selected_fpr:d window_recall:d passed:i", "SELECT * FROM sparse_recall")
def i9_sparse(t):
    return sparse_recall(t)


@query("i10_run_table", "unit_id method rows:i",
       """SELECT 'seed=' || run || '|source=' || source_file || '|density=' || density_scenario AS unit_id, method, count(*) AS rows FROM run_metrics
  GROUP BY 1, 2""")
def i10(t):
    unit = F.concat(F.lit("seed="), F.col("run"), F.lit("|source="), F.col("source_file"), F.lit("|density="), F.col("density_scenario"))
    return run_metrics(t).withColumn("unit_id", unit).groupBy("unit_id", "method").agg(F.count(F.lit(1)).alias("rows"))


@query("i10_duplicate_runs", "unit_id method rows:i",
       """SELECT 'seed=' || run AS unit_id, 'any' AS method, count(*) AS rows FROM run_metrics GROUP BY 1, 2 HAVING count(*) > 1""")
def i10_duplicates(t):
    named = run_metrics(t).withColumn("unit_id", F.concat(F.lit("seed="), F.col("run"))).withColumn("method", F.lit("any"))
    return quality.duplicate_keys(named, ["unit_id", "method"])


LIMIT = 0.05
_rules = list(state.MEMORY_RULES)
cte(
    ruled="SELECT d.*, " + ", ".join(f"greatest(m.can__{r}, no_state) AS policy__{r}" for r in _rules) + " FROM decisions d JOIN memory m USING (run, seq)",
    dev_runs="SELECT DISTINCT run FROM context ORDER BY run LIMIT 3",
    ruled_dev="SELECT * FROM ruled JOIN dev_runs USING (run)",
)


def rule_ctes(table: str, prefix: str = "") -> None:
    """Run and phase metrics and summary of the memory rules over a table of ruled rows, and the rule chosen from them."""
    p, own = prefix, {r: f"policy__{r}" for r in _rules}
    cte(**{
        f"{p}rule_runs": "SELECT *, method AS rule FROM (" + rates_sql(alarm_union(own, "run, density_scenario", table)) + ")",
        f"{p}rule_phases": "SELECT *, method AS rule FROM (" + rates_sql(alarm_union(own, "run, density_scenario, phase", table)) + ")",
        f"{p}rule_summary": f"""SELECT rule, count(*) AS runs, avg(f1) AS f1_mean, avg(false_positive_rate) AS overall_fpr_mean, any_value(low) AS low_can_recall_mean,
  any_value(hf) AS healthy_fpr_macro FROM {p}rule_runs LEFT JOIN (SELECT rule, avg(recall) AS low FROM {p}rule_phases WHERE density_scenario = 'low_1_5' AND phase = 'error' GROUP BY 1)
    USING (rule) LEFT JOIN (SELECT rule, avg(false_positive_rate) AS hf FROM {p}rule_phases WHERE phase IN ('view', 'signup') GROUP BY 1) USING (rule) GROUP BY 1""",
        f"{p}chosen_all": f"""SELECT *, CASE WHEN rule = coalesce((SELECT rule FROM {p}rule_summary WHERE overall_fpr_mean <= {LIMIT}e0 AND healthy_fpr_macro <= {LIMIT}e0
    AND rule <> 'instant_advisory_reference' ORDER BY round(low_can_recall_mean, 9) DESC, round(f1_mean, 9) DESC, round(overall_fpr_mean, 9), rule LIMIT 1), 'strict_consecutive_2') THEN 1 ELSE 0 END AS selected,
  CASE WHEN overall_fpr_mean <= {LIMIT}e0 AND healthy_fpr_macro <= {LIMIT}e0 AND rule <> 'instant_advisory_reference' THEN 1 ELSE 0 END AS eligible FROM {p}rule_summary""",
    })


# Rules are compared over all runs; H3 takes the rule chosen on the development runs.
rule_ctes("ruled", "all_")
rule_ctes("ruled_dev")
cte(chosen_rule="SELECT * FROM chosen_all WHERE selected = 1")


def development(t, rows):
    """The rows of the development runs."""
    runs = splits.run_partitions(t.staged("context", t.context), "run", 3, 2).where(F.col("partition") == "development").select("run")
    return rows.join(runs, "run")


def with_rules(rows):
    return state.memory_rules(rows, ["run"], "seq", "multi_instant").withColumns({
        f"policy__{r}": F.greatest(F.col(f"can__{r}"), F.col("context_only_no_state_alarm")) for r in _rules})


def ruled(t):
    return t.staged("ruled", lambda: with_rules(replay.decisions(t)))


def rule_tables(rows):
    methods = {r: f"policy__{r}" for r in _rules}
    runs = metrics.with_rates(metrics.confusion(rows, ["run", "density_scenario"], "ground_truth_attack", methods))
    phases = metrics.with_rates(metrics.confusion(rows, ["run", "density_scenario", "phase"], "ground_truth_attack", methods))
    return runs.withColumnRenamed("method", "rule"), phases.withColumnRenamed("method", "rule")


def rule_summary(rows):
    runs, phases = rule_tables(rows)
    low = phases.where((F.col("density_scenario") == "low_1_5") & (F.col("phase") == "error")).groupBy("rule").agg(
        F.avg("recall").alias("low_can_recall_mean"))
    healthy = phases.where(F.col("phase").isin("view", "signup")).groupBy("rule").agg(F.avg("false_positive_rate").alias("healthy_fpr_macro"))
    return runs.groupBy("rule").agg(F.count(F.lit(1)).alias("runs"), F.avg("f1").alias("f1_mean"),
                                    F.avg("false_positive_rate").alias("overall_fpr_mean")).join(low, "rule", "left").join(healthy, "rule", "left")


cte(sparse_recall=f"""SELECT rule, low_can_recall_mean AS selected_recall, overall_fpr_mean AS selected_fpr, w AS window_recall,
  CASE WHEN low_can_recall_mean > w AND overall_fpr_mean <= 0.05e0 THEN 1 ELSE 0 END AS passed
  FROM chosen_rule, (SELECT avg(w100_instant) AS w FROM parents WHERE attack_frame_count BETWEEN 1 AND 5)""")


@query("e27_rule_selection", "rule runs:i f1_mean:d overall_fpr_mean:d low_can_recall_mean:d healthy_fpr_macro:d eligible:i selected:i",
       "SELECT * FROM all_chosen_all")
def e27(t):
    return chosen_rule(ruled(t))


def chosen_rule(rows):
    ok = (F.col("overall_fpr_mean") <= LIMIT) & (F.col("healthy_fpr_macro") <= LIMIT) & (F.col("rule") != "instant_advisory_reference")
    order = [F.round("low_can_recall_mean", 9).desc(), F.round("f1_mean", 9).desc(), F.round("overall_fpr_mean", 9).asc(), F.col("rule")]
    return inference.select_eligible(rule_summary(rows), ok, order, "rule", "strict_consecutive_2")


cte(base_summary="SELECT method, avg(f1) AS f1_mean, avg(false_positive_rate) AS fpr_mean FROM run_metrics GROUP BY 1")


@query("e28_baseline_selection", "method f1_mean:d fpr_mean:d eligible:i selected:i",
       f"""SELECT *, CASE WHEN fpr_mean <= {LIMIT}e0 THEN 1 ELSE 0 END AS eligible, CASE WHEN method = (SELECT method FROM base_summary WHERE fpr_mean <= {LIMIT}e0
  ORDER BY round(f1_mean, 9) DESC, method LIMIT 1) THEN 1 ELSE 0 END AS selected FROM base_summary""")
def e28(t):
    table = run_metrics(t).groupBy("method").agg(
        F.avg("f1").alias("f1_mean"), F.avg("false_positive_rate").alias("fpr_mean"))
    return inference.select_eligible(table, F.col("fpr_mean") <= LIMIT, [F.round("f1_mean", 9).desc(), F.col("method")], "method")


@query("j7_primary_summary", "density_scenario runs:i f1_mean:d can_recall_mean:d healthy_fpr_macro:d",
       """SELECT r.density_scenario, runs, f1_mean, can_recall_mean, healthy_fpr_macro FROM (SELECT density_scenario, count(*) AS runs, avg(f1) AS f1_mean FROM all_rule_runs
    WHERE rule = 'strict_consecutive_2' GROUP BY 1) r LEFT JOIN (SELECT density_scenario, avg(recall) AS can_recall_mean FROM all_rule_phases WHERE rule = 'strict_consecutive_2'
    AND phase = 'error' GROUP BY 1) USING (density_scenario) LEFT JOIN (SELECT density_scenario, avg(false_positive_rate) AS healthy_fpr_macro FROM all_rule_phases
    WHERE rule = 'strict_consecutive_2' AND phase IN ('view', 'signup') GROUP BY 1) USING (density_scenario)""")
def j7(t):
    runs, phases = (x.where(F.col("rule") == "strict_consecutive_2") for x in rule_tables(ruled(t)))
    primary = runs.groupBy("density_scenario").agg(F.count(F.lit(1)).alias("runs"), F.avg("f1").alias("f1_mean"))
    can = phases.where(F.col("phase") == "error").groupBy("density_scenario").agg(F.avg("recall").alias("can_recall_mean"))
    healthy = phases.where(F.col("phase").isin("view", "signup")).groupBy("density_scenario").agg(F.avg("false_positive_rate").alias("healthy_fpr_macro"))
    return primary.join(can, "density_scenario", "left").join(healthy, "density_scenario", "left")
