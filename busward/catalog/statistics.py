"""Queries over robust statistics, metrics, thresholds and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.context import alarm_union, attack_runs, latencies, run_metrics
from busward.catalog.frames import RATE_COLUMNS, counts_sql, div, rates_sql
from busward.catalog.leakage import poisoned, roles100
from busward.catalog.registry import cte, query
from busward.functions.columns import EPSILON, deviation_trust, row_quantile, split_sources, two_sided_ratio
from busward.operators import guards, metrics, policy, stats, windows
from busward.operators.ordering import previous
from busward.plans import can_gate, replay
from busward.plans.adapters import HEALTHY
from busward.plans.replay import UNIT

S = windows.STRUCTURAL
ALL = (*windows.STRUCTURAL, *windows.PAYLOAD)


def each_feature(sql: str, features) -> str:
    return " UNION ALL ".join(sql.format(f=f) for f in features)


def healthy_micro(t):
    return can_gate.micro_windows(t).where(F.col("capture") == HEALTHY)


cte(
    healthy20=f"SELECT * FROM w20 WHERE capture = '{HEALTHY}'",
    healthy_mad=each_feature("SELECT '{f}' AS feature, m AS center, 1.4826e0 * median(abs({f} - m)) AS mad_scale, stddev_pop({f}) AS sd "
                             "FROM healthy20, (SELECT median({f}) AS m FROM healthy20) GROUP BY m", S),
)


@query("a1_median_mad", "session_id center:d mad_scale:d",
       """SELECT session_id, m AS center, 1.4826e0 * median(abs(identifier_log_odds - m)) AS mad_scale FROM (SELECT *, median(identifier_log_odds)
  OVER (PARTITION BY session_id) AS m FROM parent_sessions WHERE session_position < 5) GROUP BY 1, 2""")
def a1(t):
    sessions = windows.pseudo_sessions(can_gate.parent_windows(t), can_gate.PARENT_SESSION, HEALTHY)
    base = sessions.where(F.col("session_position") < can_gate.PARENT_BOOT)
    return stats.median_mad(base, ["session_id"], "identifier_log_odds")


@query("a2_scale_fallback", "feature center:d mad_scale:d standard_deviation:d scale_used:d fallback_used:i",
       """SELECT *, sd AS standard_deviation, CASE WHEN mad_scale > 1e-12 THEN mad_scale WHEN sd > 1e-12 THEN sd ELSE 1e0 END AS scale_used,
  CASE WHEN mad_scale <= 1e-12 THEN 1 ELSE 0 END AS fallback_used FROM healthy_mad""")
def a2(t):
    return stats.scale_with_fallback(healthy_micro(t), S)


@query("a3_three_way_scale", "feature center:d scale:d",
       each_feature("SELECT '{f}' AS feature, m AS center, greatest(1.4826e0 * median(abs({f} - m)), (quantile_cont({f}, 0.75::DOUBLE) - "
                    "quantile_cont({f}, 0.25::DOUBLE)) / 1.349e0, 0.05e0, 1e-4 * greatest(abs(m), 1e0)) AS scale FROM signals, "
                    "(SELECT median({f}) AS m FROM signals) GROUP BY m", ("s1", "s2", "s3", "s4")))
def a3(t):
    counted = t.staged("signal_value_counts", lambda: stats.value_counts(
        stats.long_features(t.signals(), [], ["s1", "s2", "s3", "s4"]), ["feature"], "value"))
    return stats.three_way_scale_of(counted, ["feature"], "value")


@query("a4_scale_floors", "feature floor:d", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, l_{f} AS floor FROM micro_floor" for f in S).replace("micro_floor", "(SELECT DISTINCT * FROM micro_floor)"))
def a4(t):
    fitted = stats.scale_floors(healthy_micro(t), can_gate.STRUCTURAL_FLOORS)
    return stats.feature_rows(t.spark, list(fitted.items()), "feature string, floor double")


FPRS = (0.01, 0.02, 0.05, 0.10)


@query("a5_quantile_thresholds", "target_fpr:d threshold:d windows:i",
       " UNION ALL ".join(f"SELECT {f}e0 AS target_fpr, quantile_cont(deviation, {1 - f!r}::DOUBLE) AS threshold, count(*) AS windows "
                          "FROM parent_scored WHERE role = 'calibration'" for f in FPRS))
def a5(t):
    scores = can_gate.parent_scores(t).where(F.col("role") == "calibration")
    fitted = stats.fit_quantiles(scores, ["deviation"], {str(f): 1 - f for f in FPRS})["deviation"]
    n = scores.count()
    return stats.feature_rows(t.spark, [(f, fitted[str(f)], n) for f in FPRS], "target_fpr double, threshold double, windows bigint")


@query("a6_conformal_threshold", "role n:i rank:i threshold:d",
       """SELECT role, n, r AS rank, deviation AS threshold FROM (SELECT role, deviation, count(*) OVER (PARTITION BY role) AS n,
  row_number() OVER (PARTITION BY role ORDER BY deviation) AS r FROM micro_scored) WHERE r = least(n, ceil((n + 1) * 0.95e0))""")
def a6(t):
    return stats.conformal_threshold(can_gate.micro_scores(t), ["role"], "deviation", 0.05)


cte(gate_counts=f"SELECT capture, {counts_sql('binary_target', 'alarm_instant')} FROM micro_gate GROUP BY 1")


def gate_counts(t):
    return metrics.confusion(can_gate.micro_gate(t), ["capture"], "binary_target", {"instant": "alarm_instant"})


_W = "1.959963984540054e0"
_wp, _wn = "(fp / n)", "n"


@query("a7_wilson_interval", "capture fp:i benign:i wilson_low:d wilson_high:d",
       f"""SELECT capture, fp, n::BIGINT AS benign, greatest(0e0, (p + {_W} * {_W} / (2e0 * n)) / (1e0 + {_W} * {_W} / n) - {_W} *
    sqrt(p * (1e0 - p) / n + {_W} * {_W} / (4e0 * n * n)) / (1e0 + {_W} * {_W} / n)) AS wilson_low,
  least(1e0, (p + {_W} * {_W} / (2e0 * n)) / (1e0 + {_W} * {_W} / n) + {_W} *
    sqrt(p * (1e0 - p) / n + {_W} * {_W} / (4e0 * n * n)) / (1e0 + {_W} * {_W} / n)) AS wilson_high
  FROM (SELECT *, fp / n AS p FROM (SELECT capture, fp, (fp + tn)::DOUBLE AS n FROM gate_counts))""")
def a7(t):
    return stats.with_wilson(gate_counts(t).withColumn("benign", F.col("fp") + F.col("tn")), "fp", "benign")


_SUM = " ".join(f"{m}_{s}:d" for m in ("recall", "f1", "false_positive_rate") for s in ("mean", "std", "min", "max"))


def _summary_sql(std: str) -> str:
    cols = ", ".join(f"avg({m}) AS {m}_mean, {std}({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max"
                     for m in ("recall", "f1", "false_positive_rate"))
    return f"SELECT density_scenario, method, count(*) AS runs, {cols} FROM run_metrics GROUP BY 1, 2"


@query("a8_run_summary_population", f"density_scenario method runs:i {_SUM}", _summary_sql("stddev_pop"))
def a8(t):
    return stats.run_summary(run_metrics(t), ["density_scenario", "method"], ["recall", "f1", "false_positive_rate"])


@query("a8_run_summary_sample", f"density_scenario method runs:i {_SUM}", _summary_sql("stddev_samp"))
def a8_sample(t):
    return stats.run_summary(run_metrics(t), ["density_scenario", "method"], ["recall", "f1", "false_positive_rate"], sample=True)


@query("a9_macro_pooled_worst", "method groups:i macro_rate:d pooled_rate:d worst_rate:d",
       f"""SELECT method, count(*) AS groups, avg({div('fp', 'fp + tn')}) AS macro_rate, {div('sum(fp)', 'sum(fp + tn)')} AS pooled_rate,
  max({div('fp', 'fp + tn')}) AS worst_rate FROM run_metrics GROUP BY 1""")
def a9(t):
    return stats.macro_pooled_worst(run_metrics(t).withColumn("benign", F.col("fp") + F.col("tn")), ["method"], "fp", "benign")


@query("a10_descriptive", "density_scenario method n_units:i mean:d standard_deviation:d median:d q1:d q3:d",
       """SELECT density_scenario, method, count(f1) AS n_units, avg(f1) AS mean, stddev_samp(f1) AS standard_deviation, median(f1) AS median,
  quantile_cont(f1, 0.25::DOUBLE) AS q1, quantile_cont(f1, 0.75::DOUBLE) AS q3 FROM run_metrics GROUP BY 1, 2""")
def a10(t):
    return stats.descriptive(run_metrics(t), ["density_scenario", "method"], "f1")


@query("a11_phase_summary", "source_file density_scenario phase first_seen:i ground_truth_attack:i rows:i alarm_rate:d fallback_rate:d allow:i monitor:i "
       "mean_trust:d min_trust:d",
       """SELECT source_file, density_scenario, phase, min(seq) AS first_seen, arg_min(ground_truth_attack, seq) AS ground_truth_attack,
  count(*) AS rows, avg(persistent_no_state_alarm) AS alarm_rate, avg(CASE WHEN graded_local = 'SAFE_FALLBACK' THEN 1 ELSE 0 END) AS fallback_rate,
  count(*) FILTER (graded_local = 'ALLOW') AS allow, count(*) FILTER (graded_local = 'MONITOR_VERIFY') AS monitor,
  avg(continuous_trust) AS mean_trust, min(continuous_trust) AS min_trust FROM decisions GROUP BY 1, 2, 3""")
def a11(t):
    action = F.col("graded_local")
    return stats.phase_summary(
        replay.decisions(t), ["source_file", "density_scenario"], "phase", "seq", "ground_truth_attack",
        {"alarm_rate": F.col("persistent_no_state_alarm"), "fallback_rate": action == "SAFE_FALLBACK"},
        {"allow": action == "ALLOW", "monitor": action == "MONITOR_VERIFY"},
        {"mean_trust": "continuous_trust"}, {"min_trust": "continuous_trust"})


@query("a12_source_attribution", "run:i active_source active_rows:i attack_rows:i benign_rows:i",
       """SELECT run, active_source, count(*) AS active_rows, sum(ground_truth_attack) AS attack_rows, sum(1 - ground_truth_attack) AS benign_rows
  FROM (SELECT run, ground_truth_attack, unnest(string_split(active_noncan_sources, ';')) AS active_source FROM decisions
    WHERE active_noncan_sources <> '') GROUP BY 1, 2""")
def a12(t):
    return stats.source_attribution(replay.decisions(t), ["run"], split_sources(F.col("active_noncan_sources")), "ground_truth_attack")


@query("a13_decision_distribution", "run:i source_file density_scenario graded_local rows:i percentage:d",
       """SELECT run, source_file, density_scenario, graded_local, count(*) AS rows,
  100e0 * count(*) / sum(count(*)) OVER (PARTITION BY run) AS percentage FROM decisions GROUP BY 1, 2, 3, 4""")
def a13(t):
    return stats.share_within(replay.decisions(t), UNIT, "graded_local")


@query("a14_density_recall", "attack_frames_per_window windows:i recall:d mean_score:d",
       """SELECT b AS attack_frames_per_window, count(capture) AS windows, avg(multi_instant) AS recall, avg(deviation_max) AS mean_score
  FROM (VALUES ('1', 1, 1), ('2-5', 2, 5), ('6-20', 6, 20), ('21-50', 21, 50), ('51-99', 51, 99), ('100', 100, 100)) v(b, lo, hi)
  LEFT JOIN parents ON attack_frame_count BETWEEN lo AND hi GROUP BY 1""")
def a14(t):
    return stats.density_recall(can_gate.multiscale(t), "attack_frame_count", "multi_instant", "deviation_max")


cte(shift=each_feature(
    "SELECT '{f}' AS feature, tm AS train_mean, ts AS train_std, tn AS train_min, tx AS train_max, avg({f}) AS external_mean, "
    "stddev_pop({f}) AS external_std, min({f}) AS external_min, max({f}) AS external_max, avg(CASE WHEN {f} < tn OR {f} > tx THEN 1 ELSE 0 END) "
    "AS fraction_outside_train_range, CASE WHEN ts > 0 THEN (avg({f}) - tm) / ts END AS standardized_mean_difference FROM w100, "
    f"(SELECT avg({{f}}) AS tm, stddev_pop({{f}}) AS ts, min({{f}}) AS tn, max({{f}}) AS tx FROM w100 WHERE capture = '{HEALTHY}') "
    f"WHERE capture <> '{HEALTHY}' GROUP BY tm, ts, tn, tx", ALL))


def shift(t):
    w = can_gate.parent_windows(t)
    return stats.domain_shift(w.where(F.col("capture") == HEALTHY), w.where(F.col("capture") != HEALTHY), ALL)


@query("a15_domain_shift", "feature train_mean:d train_std:d train_min:d train_max:d external_mean:d external_std:d external_min:d external_max:d "
       "standardized_mean_difference:d fraction_outside_train_range:d", "SELECT * FROM shift")
def a15(t):
    return shift(t)


@query("a16_family_shift", "feature_family features:i mean_absolute_shift:d max_absolute_shift:d most_shifted_feature mean_fraction_outside:d",
       """SELECT CASE WHEN starts_with(feature, 'id_') OR starts_with(feature, 'frame_') OR starts_with(feature, 'dominant_id_')
      OR starts_with(feature, 'consecutive_frame_') THEN 'identifier_and_frame_structure'
    WHEN ends_with(feature, '_zero_fraction') OR ends_with(feature, '_ff_fraction') THEN 'payload_extremes'
    WHEN ends_with(feature, '_mean_abs_change') THEN 'payload_dynamics' ELSE 'payload_statistics' END AS feature_family, count(*) AS features,
  avg(abs(standardized_mean_difference)) AS mean_absolute_shift, max(abs(standardized_mean_difference)) AS max_absolute_shift,
  arg_max(feature, coalesce(abs(standardized_mean_difference), -1)) AS most_shifted_feature, avg(fraction_outside_train_range) AS mean_fraction_outside
  FROM shift GROUP BY 1""")
def a16(t):
    return stats.family_shift(shift(t))


@query("a19_latency_summary", "method attack_runs:i detected_runs:i missed_runs:i run_detection_rate:d latency_mean:d latency_max:d latency_median:d latency_p95:d",
       """SELECT method, count(*) AS attack_runs, count(latency) AS detected_runs, count(*) - count(latency) AS missed_runs,
  count(latency) / count(*)::DOUBLE AS run_detection_rate, avg(latency) AS latency_mean, max(latency) AS latency_max,
  median(latency) AS latency_median, quantile_cont(latency::DOUBLE, 0.95::DOUBLE) AS latency_p95 FROM latencies GROUP BY 1""")
def a19(t):
    return stats.latency_summary(latencies(t), ["method"], "latency")


cte(rounded="SELECT role, window_index, round(deviation + 1e-10, 6) AS deviation FROM micro_scored")


@query("a22_ecdf", "role deviation:d ecdf:d",
       """SELECT DISTINCT v.role, v.deviation, (SELECT count(*) FROM rounded r WHERE r.role = v.role AND r.window_index % 2 = 0
    AND r.deviation <= v.deviation) / (SELECT count(*) FROM rounded r WHERE r.role = v.role AND r.window_index % 2 = 0)::DOUBLE AS ecdf
  FROM rounded v""")
def a22(t):
    scores = can_gate.micro_scores(t).withColumn("deviation", F.round(F.col("deviation") + 1e-10, 6))
    return stats.ecdf(scores.where(F.col("window_index") % 2 == 0), scores, ["role"], "deviation")


@query("a23_tail_score", "session_id window_index:i tail_score:d",
       """SELECT session_id, window_index, (ln(1e0 + deviation) - c) / greatest(q - c, m, 1e-6) AS tail_score FROM micro_scored,
  (SELECT c, q, 1.4826e0 * median(abs(x - c)) AS m FROM (SELECT ln(1e0 + deviation) AS x FROM micro_scored WHERE role = 'calibration'),
    (SELECT median(ln(1e0 + deviation)) AS c, quantile_cont(ln(1e0 + deviation), 0.95::DOUBLE) AS q FROM micro_scored WHERE role = 'calibration')
    GROUP BY c, q)""")
def a23(t):
    scores = can_gate.micro_scores(t)
    center, scale = stats.tail_parameters(scores.where(F.col("role") == "calibration"), ["deviation"])["deviation"]
    return scores.withColumn("tail_score", stats.tail_score(F.col("deviation"), center, scale))


@query("a24_order_statistics", "capture window_index:i risk_any:d risk_consensus:d risk_context:d",
       """SELECT capture, window_index, s[3] AS risk_any, s[2] AS risk_consensus, (s[3] + s[2]) / 2e0 AS risk_context FROM (SELECT *,
  list_sort([frame_unique_fraction, dominant_id_fraction, id_change_rate]) AS s FROM w20)""")
def a24(t):
    return stats.risk_columns(can_gate.micro_windows(t), ["frame_unique_fraction", "dominant_id_fraction", "id_change_rate"])


@query("a25_row_quantile", "capture seq:i p90:d",
       """SELECT capture, seq, CASE WHEN len(s) > 0 THEN s[floor((len(s) - 1) * 0.9e0)::INTEGER + 1] + (s[ceil((len(s) - 1) * 0.9e0)::INTEGER + 1]
    - s[floor((len(s) - 1) * 0.9e0)::INTEGER + 1]) * ((len(s) - 1) * 0.9e0 - floor((len(s) - 1) * 0.9e0)) END AS p90
  FROM (SELECT capture, seq, list_sort(list_filter([s1, s2, s3, s4], lambda x: x IS NOT NULL)) AS s FROM signals)""")
def a25(t):
    return t.signals().select("capture", "seq", row_quantile(F.array("s1", "s2", "s3", "s4"), 0.9).alias("p90"))


# --- metrics ---------------------------------------------------------------------------------------

@query("m1_confusion_counts", "run:i source_file density_scenario method tp:i fp:i tn:i fn:i", "SELECT * FROM run_metrics")
def m1(t):
    return run_metrics(t)


@query("m2_rates", f"run:i source_file density_scenario method {RATE_COLUMNS}", "SELECT * FROM run_metrics")
def m2(t):
    return run_metrics(t)


@query("m3_balanced_mcc", "run:i method balanced_accuracy:d mcc:d",
       """SELECT run, method, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2e0 END AS balanced_accuracy,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN CASE WHEN (tp + fp) * (tn + fn) = 0 THEN 0e0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) /
    sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END END AS mcc FROM run_metrics""")
def m3(t):
    return metrics.with_balanced(run_metrics(t))


cte(
    scored=f"SELECT CASE WHEN capture = '{HEALTHY}' THEN 'healthy' ELSE capture END AS capture, binary_target AS y, round(attack_probability + 1e-11, 9) AS s FROM p100",
    score_levels="SELECT capture, s, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1, 2",
    points="""SELECT *, CASE WHEN p = 0 THEN 0e0 ELSE tp / p::DOUBLE END AS tpr, CASE WHEN n = 0 THEN 0e0 ELSE fp / n::DOUBLE END AS fpr,
  tp / (tp + fp)::DOUBLE AS prec FROM (SELECT capture, s, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY capture) AS p, sum(neg) OVER (PARTITION BY capture) AS n FROM score_levels
    WINDOW w AS (PARTITION BY capture ORDER BY s DESC))""",
    f1_points="SELECT *, CASE WHEN prec + tpr = 0 THEN 0e0 ELSE 2e0 * prec * tpr / (prec + tpr) END AS f1 FROM points",
    aucs="""SELECT capture, p AS positives, n AS negatives, CASE WHEN p > 0 AND n > 0 THEN area / (p::DOUBLE * n) END AS roc_auc FROM (SELECT capture,
  sum(pos) AS p, sum(neg) AS n, sum(pos * (below + neg / 2e0)) AS area FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY capture ORDER BY s
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM score_levels) GROUP BY 1)""",
)


def scored(t):
    return can_gate.parent_windows(t).select(
        F.when(F.col("capture") == HEALTHY, "healthy").otherwise(F.col("capture")).alias("capture"), "binary_target",
        F.round(F.col("attack_probability") + 1e-11, 9).alias("attack_probability"))


def points(t):
    return metrics.curve(scored(t), ["capture"], "binary_target", "attack_probability")


@query("m4_roc_auc", "capture positives:i negatives:i roc_auc:d", "SELECT * FROM aucs")
def m4(t):
    return metrics.roc_auc(scored(t), ["capture"], "binary_target", "attack_probability")


@query("m5_average_precision", "capture pr_auc:d",
       "SELECT capture, CASE WHEN max(p) > 0 THEN sum(pos / p::DOUBLE * prec) END AS pr_auc FROM points GROUP BY 1")
def m5(t):
    return metrics.average_precision(points(t), ["capture"])


@query("m6_curve_points", "capture threshold:d tp:i fp:i tpr:d fpr:d precision:d",
       "SELECT capture, s AS threshold, tp, fp, tpr, fpr, prec AS precision FROM points")
def m6(t):
    return points(t)


@query("m7_best_f1_threshold", "capture lowest:d highest:d best_f1:d",
       """SELECT capture, min(s) AS lowest, max(s) AS highest, max(f1) AS best_f1 FROM (SELECT *, max(f1) OVER (PARTITION BY capture) AS m FROM f1_points)
  WHERE f1 >= m - 1e-12 GROUP BY 1""")
def m7(t):
    p = points(t)
    low = metrics.best_f1_threshold(p, ["capture"], highest=False).withColumnRenamed("threshold", "lowest")
    high = metrics.best_f1_threshold(p, ["capture"], highest=True).select("capture", F.col("threshold").alias("highest"))
    return low.join(high, "capture")


@query("m8_fpr_limited_threshold", "capture threshold:d best_recall:d",
       """SELECT capture, max(s) AS threshold, max(tpr) AS best_recall FROM (SELECT *, max(tpr) OVER (PARTITION BY capture) AS m FROM points WHERE fpr <= 0.05e0)
  WHERE tpr >= m - 1e-12 GROUP BY 1""")
def m8(t):
    return metrics.fpr_limited_threshold(points(t), ["capture"], 0.05)


cte(
    risks_cal="SELECT session_id, session_position, 1e0 - can_trust AS risk FROM micro_gate WHERE role = 'calibration'",
    risks_two="""SELECT session_id, least(risk, coalesce(lag(risk) OVER (PARTITION BY session_id ORDER BY session_position), 0e0)) AS risk FROM risks_cal""",
    grid9="""SELECT g, CASE WHEN g = 2000 THEN 1.000001e0 ELSE 0.5e0 + g * ((1.000001e0 - 0.5e0) / 2000e0) END AS threshold FROM range(2001) r(g)""",
    grid_rates="""SELECT threshold, sum(a) / sum(n)::DOUBLE AS pooled_fpr, avg(a / n::DOUBLE) AS macro_fpr, max(a / n::DOUBLE) AS worst_fpr, sum(n) AS windows
  FROM (SELECT g, threshold, session_id, count(*) FILTER (risk >= threshold) AS a, count(*) AS n FROM grid9, risks_two GROUP BY 1, 2, 3) GROUP BY 1""",
    grid_rates_single="""SELECT threshold, sum(a) / sum(n)::DOUBLE AS pooled_fpr, avg(a / n::DOUBLE) AS macro_fpr, max(a / n::DOUBLE) AS worst_fpr, sum(n) AS windows
  FROM (SELECT g, threshold, session_id, count(*) FILTER (risk >= threshold) AS a, count(*) AS n FROM grid9, risks_cal GROUP BY 1, 2, 3) GROUP BY 1""",
)


def risks(t, persistence):
    rows = can_gate.micro_gate(t).where(F.col("role") == "calibration").withColumn("risk", 1.0 - F.col("can_trust"))
    if persistence == 2:
        rows = previous(rows, ["session_id"], "session_position", {"_r": (F.col("risk"), 1, None)})
        rows = rows.withColumn("risk", F.least("risk", F.coalesce("_r", F.lit(0.0))))
    return rows


@query("m9_threshold_grid", "threshold:d pooled_fpr:d macro_fpr:d worst_fpr:d windows:i",
       """SELECT * FROM grid_rates WHERE pooled_fpr <= 0.05e0 AND macro_fpr <= 0.05e0 AND worst_fpr <= 0.1e0 ORDER BY threshold LIMIT 1""")
def m9(t):
    return metrics.first_allowed(metrics.grid_operating_points(risks(t, 2), "session_id", "risk"))


@query("m9_single_threshold", "threshold:d pooled_fpr:d macro_fpr:d worst_fpr:d windows:i",
       """SELECT * FROM grid_rates_single WHERE pooled_fpr <= 0.05e0 AND macro_fpr <= 0.05e0 AND worst_fpr <= 0.1e0 ORDER BY threshold LIMIT 1""")
def m9_single(t):
    return metrics.first_allowed(metrics.grid_operating_points(risks(t, 1), "session_id", "risk"))


@query("m9_grid_points", "threshold:d pooled_fpr:d macro_fpr:d worst_fpr:d windows:i", "SELECT * FROM grid_rates")
def m9_points(t):
    return metrics.grid_operating_points(risks(t, 2), "session_id", "risk")


@query("m10_quantile_threshold", "threshold:d pooled_fpr:d macro_fpr:d worst_fpr:d windows:i",
       """SELECT threshold, sum(a) / sum(n)::DOUBLE AS pooled_fpr, avg(a / n::DOUBLE) AS macro_fpr, max(a / n::DOUBLE) AS worst_fpr, sum(n) AS windows FROM (
    SELECT threshold, strict, session_id, count(*) FILTER (CASE WHEN strict = 1 THEN risk > threshold ELSE risk >= threshold END) AS a, count(*) AS n
    FROM risks_cal, (SELECT DISTINCT unnest(quantile_cont(risk, (SELECT list(i / 2000e0 ORDER BY i) FROM range(2001) r(i)))) AS threshold FROM risks_cal),
      (SELECT unnest([0, 1]) AS strict) GROUP BY 1, 2, 3) GROUP BY threshold, strict
  HAVING sum(a) / sum(n)::DOUBLE <= 0.05e0 AND avg(a / n::DOUBLE) <= 0.05e0 AND max(a / n::DOUBLE) <= 0.1e0 ORDER BY threshold, strict LIMIT 1""".replace(
           "(SELECT list(i / 2000e0 ORDER BY i) FROM range(2001) r(i))", "[" + ", ".join(f"{i / 2000!r}::DOUBLE" for i in range(2001)) + "]"))
def m10(t):
    rows = risks(t, 1)
    candidates = metrics.quantile_candidates(rows, "risk")
    return metrics.first_allowed(metrics.candidate_operating_points(rows, "session_id", "risk", candidates))


_scopes = ("capture", "density_band", "binary_target")


@query("m11_scoped_metrics", f"scope scope_value method tp:i fp:i tn:i fn:i {RATE_COLUMNS}",
       rates_sql(" UNION ALL ".join(
           f"SELECT '{s}' AS scope, {v} AS scope_value, '{m}' AS method, {counts_sql('binary_target', c)} FROM parents GROUP BY ALL"
           for s, v in (("overall", "'all'"), ("capture", "capture"), ("role", "role"))
           for m, c in (("w100", "w100_instant"), ("multiscale", "multi_instant")))))
def m11(t):
    return metrics.scoped_metrics(can_gate.multiscale(t), ["capture", "role"], "binary_target",
                                  {"w100": "w100_instant", "multiscale": "multi_instant"})


@query("m12_score_orientation", "capture roc_auc:d orientation oriented_roc_auc:d",
       """SELECT capture, roc_auc, CASE WHEN roc_auc IS NULL THEN 'not_applicable_single_class' WHEN roc_auc >= 0.5e0 THEN 'attack_if_high'
  ELSE 'attack_if_low_inverted' END AS orientation, CASE WHEN roc_auc >= 0.5e0 THEN roc_auc ELSE 1e0 - roc_auc END AS oriented_roc_auc FROM aucs""")
def m12(t):
    rows = scored(t)
    auc = metrics.roc_auc(rows, ["capture"], "binary_target", "attack_probability")
    turned = rows.join(auc.select("capture", "roc_auc"), "capture").withColumn(
        "oriented", F.when(F.col("roc_auc") < 0.5, 1.0 - F.col("attack_probability")).otherwise(F.col("attack_probability")))
    again = metrics.roc_auc(turned, ["capture"], "binary_target", "oriented").select("capture", F.col("roc_auc").alias("oriented_roc_auc"))
    return auc.join(again, "capture").withColumn(
        "orientation", F.when(F.col("roc_auc").isNull(), "not_applicable_single_class")
        .when(F.col("roc_auc") >= 0.5, "attack_if_high").otherwise("attack_if_low_inverted"))


cte(clustered="""SELECT p.capture, binary_target, multi_instant, id_unique_count || '/' || frame_unique_count AS cluster FROM parents p JOIN w100 w
  ON w.capture = p.capture AND w.window_index = p.parent_window_index""".replace("binary_target, multi", "p.binary_target, multi"))


def clustered(t):
    w = can_gate.parent_windows(t).select("capture", F.col("window_index").alias("parent_window_index"),
                                          F.concat_ws("/", "id_unique_count", "frame_unique_count").alias("cluster"))
    return can_gate.multiscale(t).join(w, ["capture", "parent_window_index"])


@query("m13_cluster_macro", "binary_target:i clusters:i cluster_macro_rate:d",
       """SELECT binary_target, count(*) AS clusters, avg(m) AS cluster_macro_rate FROM (SELECT binary_target, cluster, avg(multi_instant) AS m
  FROM clustered GROUP BY 1, 2) GROUP BY 1""")
def m13(t):
    return metrics.cluster_macro(clustered(t), ["binary_target"], "cluster", "multi_instant")


cte(pooled_methods=rates_sql(alarm_union(policy.POLICY_METHODS, "has_noncan >= 0 AS everything").replace("GROUP BY has_noncan >= 0 AS everything", "GROUP BY everything").replace("SELECT has_noncan >= 0 AS everything, p.m", "SELECT everything, p.m")))


@query("m14_method_comparison", f"method tp:i fp:i tn:i fn:i {RATE_COLUMNS}", "SELECT * FROM pooled_methods")
def m14(t):
    return metrics.with_rates(metrics.confusion(replay.decisions(t), [], "ground_truth_attack", policy.POLICY_METHODS)).orderBy(
        F.col("f1").desc(), "method")


# --- evidence and guards ---------------------------------------------------------------------------

@query("e1_log_odds", "capture window_index:i attack_probability:d identifier_log_odds:d", "SELECT * FROM p100")
def e1(t):
    return can_gate.parent_windows(t)


def drift_gate(t, fpr=0.05):
    """Two-sided score ratio and robust distance, each over its own healthy limit, and their maximum."""
    rows = roles100(t)
    reference = rows.where(F.col("evaluation_role") == "healthy_reference")
    fitted = {r["feature"]: (r["center"], r["scale_used"]) for r in stats.scale_with_fallback(reference, S).collect()}
    z = F.array(*[F.least(F.abs((F.col(f) - F.lit(c)) / F.lit(s)), F.lit(1000.0)) for f, (c, s) in fitted.items()])
    rows = rows.withColumn("feature_distance", row_quantile(z, 0.75))
    calibration = rows.where(F.col("evaluation_role") == "healthy_calibration")
    lim = stats.fit_quantiles(calibration, ["identifier_log_odds"], {"c": 0.5, "lo": fpr / 2, "hi": 1 - fpr / 2})["identifier_log_odds"]
    far = stats.fit_quantiles(calibration, ["feature_distance"], {"t": 1 - fpr})["feature_distance"]["t"]
    rows = rows.withColumn("two_sided_ratio", two_sided_ratio(F.col("identifier_log_odds"), F.lit(lim["c"]), F.lit(lim["lo"]), F.lit(lim["hi"])))
    rows = rows.withColumn("distance_ratio", F.col("feature_distance") / max(far, EPSILON))
    rows = rows.withColumn("combined_raw", F.greatest("two_sided_ratio", "distance_ratio"))
    limit = stats.fit_quantiles(rows.where(F.col("evaluation_role") == "healthy_calibration"), ["combined_raw"], {"t": 1 - fpr})["combined_raw"]["t"]
    rows = rows.withColumn("combined_risk", F.col("combined_raw") / max(limit, EPSILON))
    return rows.withColumn("can_trust", deviation_trust(F.col("combined_risk"), F.lit(1.0)))


_ref = ", ".join(f"median({f}) AS c_{f}" for f in S)
_mad = ", ".join(f"CASE WHEN 1.4826e0 * median(abs({f} - c_{f})) > 1e-12 THEN 1.4826e0 * median(abs({f} - c_{f})) WHEN stddev_pop({f}) > 1e-12 "
                 f"THEN stddev_pop({f}) ELSE 1e0 END AS s_{f}" for f in S)
_z = ", ".join(f"least(abs(({f} - c_{f}) / s_{f}), 1000e0)" for f in S)
cte(
    drift_c=f"SELECT {_ref} FROM roles100 WHERE evaluation_role = 'healthy_reference'",
    drift_s=f"SELECT {_mad} FROM roles100, drift_c WHERE evaluation_role = 'healthy_reference'",
    drift_d=f"""SELECT capture, window_index, evaluation_role, identifier_log_odds, z[5] + (z[6] - z[5]) * 0.5e0 AS feature_distance
  FROM (SELECT *, list_sort([{_z}]) AS z FROM roles100, drift_c, drift_s)""",
    drift_l="""SELECT median(identifier_log_odds) AS c, quantile_cont(identifier_log_odds, 0.025::DOUBLE) AS lo, quantile_cont(identifier_log_odds, 0.975::DOUBLE) AS hi,
  quantile_cont(feature_distance, 0.95::DOUBLE) AS far FROM drift_d WHERE evaluation_role = 'healthy_calibration'""",
    drift_r="""SELECT *, greatest(two_sided_ratio, distance_ratio) AS combined_raw FROM (SELECT d.*, CASE WHEN identifier_log_odds < c THEN
    (c - identifier_log_odds) / greatest(c - lo, 1e-12) ELSE (identifier_log_odds - c) / greatest(hi - c, 1e-12) END AS two_sided_ratio,
    feature_distance / greatest(far, 1e-12) AS distance_ratio FROM drift_d d, drift_l)""",
    drift_gate="""SELECT *, combined_raw / greatest(t, 1e-12) AS combined_risk, 1e0 / (1e0 + (combined_raw / greatest(t, 1e-12)) * (combined_raw / greatest(t, 1e-12)))
  AS can_trust FROM drift_r, (SELECT quantile_cont(combined_raw, 0.95::DOUBLE) AS t FROM drift_r WHERE evaluation_role = 'healthy_calibration')""",
)


@query("e2_two_sided_ratio", "capture window_index:i evaluation_role two_sided_ratio:d", "SELECT * FROM drift_gate")
def e2(t):
    return drift_gate(t)


@query("e3_robust_distance", "capture window_index:i evaluation_role feature_distance:d distance_ratio:d", "SELECT * FROM drift_gate")
def e3(t):
    return drift_gate(t)


@query("e4_drift_aware_gate", "capture window_index:i evaluation_role combined_raw:d combined_risk:d can_trust:d", "SELECT * FROM drift_gate")
def e4(t):
    return drift_gate(t)


def _spread_sql(table: str, features, k: int) -> str:
    return each_feature(
        "SELECT session_id, '{f}' AS feature, median({f}) AS center, any_value(m_{f}) AS scale, abs(median({f}) FILTER (session_position < " + str(k // 2) +
        ") - median({f}) FILTER (session_position >= " + str(k // 2) + ")) AS half_gap, max({f}) - min({f}) AS range FROM " + table +
        f"_sessions JOIN {table}_scale USING (session_id) WHERE session_position < {k} GROUP BY session_id", features)


cte(spread_parent=_spread_sql("parent", ["identifier_log_odds"], 5), spread_micro=_spread_sql("micro", S, 25))


def _guard_sql(table: str, cols, one_sided: bool = False, where: str = "starts_with(session_id, 'N_F#')") -> str:
    med = ", ".join(f"median({c}) AS c_{c}" for c in cols)
    mad = ", ".join(f"CASE WHEN 1.4826e0 * median(abs({c} - c_{c})) > 1e-12 THEN 1.4826e0 * median(abs({c} - c_{c})) WHEN stddev_pop({c}) > 1e-12 "
                    f"THEN stddev_pop({c}) ELSE 1e0 END AS s_{c}" for c in cols)
    z = ", ".join((f"({c} - c_{c}) / s_{c}" if one_sided else f"abs(({c} - c_{c}) / s_{c})") for c in cols)
    return (f"SELECT t.*, greatest({z}) AS guard_score FROM {table} t, (SELECT {med} FROM {table} WHERE {where}) c, "
            f"(SELECT {mad} FROM {table}, (SELECT {med} FROM {table} WHERE {where}) WHERE {where}) s")


def healthy_sessions(df):
    return df.where(F.col("session_id").startswith(f"{HEALTHY}#"))


def baselines(t, kind):
    if kind == "parent":
        sessions = windows.pseudo_sessions(can_gate.parent_windows(t), can_gate.PARENT_SESSION, HEALTHY)
        return sessions.where(F.col("session_position") < can_gate.PARENT_BOOT)
    sessions = windows.pseudo_sessions(can_gate.micro_windows(t), can_gate.MICRO_SESSION, HEALTHY)
    return sessions.where(F.col("session_position") < can_gate.MICRO_BOOT)


def scalar_guard(t):
    spread = t.staged("scalar_spread", lambda: guards.startup_spread(
        baselines(t, "parent"), ["session_id"], "session_position", ["identifier_log_odds"], can_gate.PARENT_BOOT))
    fitted = guards.fit_guard(healthy_sessions(spread), ["scale", "half_gap", "range"])
    scored_ = spread.withColumn("guard_score", guards.guard_score(fitted))
    limit = stats.fit_quantiles(healthy_sessions(scored_), ["guard_score"], {"t": 0.95})["guard_score"]["t"]
    return scored_, fitted, limit


cte(
    guard_scalar_s=_guard_sql("spread_parent", ("scale", "half_gap", "range")),
    guard_scalar="""SELECT *, CASE WHEN guard_score >= guard_threshold - 1e-9 THEN 1 ELSE 0 END AS guard_rejected FROM guard_scalar_s,
  (SELECT quantile_cont(guard_score, 0.95::DOUBLE) AS guard_threshold FROM guard_scalar_s WHERE starts_with(session_id, 'N_F#'))""",
    ratio_micro=f"""SELECT session_id, quantile_cont(scale / fl, 0.75::DOUBLE) AS scale, quantile_cont(half_gap / fl, 0.75::DOUBLE) AS half_gap,
  quantile_cont(range / fl, 0.75::DOUBLE) AS range FROM spread_micro JOIN ({each_feature("SELECT DISTINCT '{f}' AS feature, l_{f} AS fl FROM micro_floor", S)})
  USING (feature) GROUP BY 1""",
    guard_multi_s=_guard_sql("ratio_micro", ("scale", "half_gap", "range")),
    guard_multi="""SELECT *, CASE WHEN guard_score >= guard_threshold - 1e-9 THEN 1 ELSE 0 END AS guard_rejected FROM guard_multi_s,
  (SELECT quantile_cont(guard_score, 0.95::DOUBLE) AS guard_threshold FROM guard_multi_s WHERE starts_with(session_id, 'N_F#'))""",
)


@query("e7_startup_guard_scalar", "session_id scale:d half_gap:d range:d guard_score:d guard_threshold:d guard_rejected:i", "SELECT * FROM guard_scalar")
def e7(t):
    rows, _, limit = scalar_guard(t)
    return rows.withColumn("guard_threshold", F.lit(limit)).withColumn("guard_rejected", (F.col("guard_score") >= limit - 1e-9).cast("int"))


def micro_spread(t):
    return t.staged("micro_spread", lambda: guards.startup_spread(
        baselines(t, "micro"), ["session_id"], "session_position", S, can_gate.MICRO_BOOT))


@query("e8_startup_guard_multivariate", "session_id scale:d half_gap:d range:d guard_score:d guard_threshold:d guard_rejected:i", "SELECT * FROM guard_multi")
def e8(t):
    floors = stats.scale_floors(healthy_micro(t), can_gate.STRUCTURAL_FLOORS)
    ratios = guards.across_features(micro_spread(t), ["session_id"], floors)
    fitted = guards.fit_guard(healthy_sessions(ratios), ["scale", "half_gap", "range"])
    rows = ratios.withColumn("guard_score", guards.guard_score(fitted))
    limit = stats.fit_quantiles(healthy_sessions(rows), ["guard_score"], {"t": 0.95})["guard_score"]["t"]
    return rows.withColumn("guard_threshold", F.lit(limit)).withColumn("guard_rejected", (F.col("guard_score") >= limit - 1e-9).cast("int"))


GUARD9 = ("scale", "half_gap", "range", "center_shift", "window_deviation_q90", "window_deviation_max", "outlier_fraction")
_rc = ", ".join(f"median({f}) AS rc_{f}" for f in S)
_rs = ", ".join(f"greatest(1.4826e0 * median(abs({f} - rc_{f})), l_{f}) AS rs_{f}" for f in S)
_rz = ", ".join(f"abs({f} - rc_{f}) / greatest(rs_{f}, 1e-12)" for f in S)
cte(
    ref_c=f"SELECT {_rc} FROM micro_sessions WHERE session_block < session_blocks // 2",
    ref_s=f"SELECT {_rs} FROM micro_sessions, ref_c, (SELECT DISTINCT * FROM micro_floor) WHERE session_block < session_blocks // 2 GROUP BY "
          + ", ".join(f"l_{f}" for f in S),
    ref_w=f"""SELECT session_id, z[5] + (z[6] - z[5]) * 0.5e0 AS d FROM (SELECT session_id, list_sort([{_rz}]) AS z FROM micro_sessions, ref_c, ref_s
  WHERE session_position < 25)""",
    ref_f=f"""SELECT r.*, center_shift, window_deviation_q90, window_deviation_max, outlier_fraction FROM ratio_micro r JOIN (SELECT session_id,
    quantile_cont(abs(center - rc) / greatest(rs, 1e-12), 0.75::DOUBLE) AS center_shift FROM spread_micro JOIN ({each_feature(
      "SELECT '{f}' AS feature, rc_{f} AS rc, rs_{f} AS rs FROM ref_c, ref_s", S)}) USING (feature) GROUP BY 1) USING (session_id)
  JOIN (SELECT session_id, quantile_cont(d, 0.9::DOUBLE) AS window_deviation_q90, max(d) AS window_deviation_max,
    avg(CASE WHEN d >= 3e0 THEN 1 ELSE 0 END) AS outlier_fraction FROM ref_w GROUP BY 1) USING (session_id)""",
    ref_cal="SELECT DISTINCT session_id FROM micro_sessions WHERE session_block < session_blocks // 2",
    guard_ref_s=_guard_sql("ref_f", GUARD9, True, "session_id IN (SELECT session_id FROM ref_cal)"),
    guard_ref="""SELECT *, CASE WHEN guard_score > guard_threshold THEN 1 ELSE 0 END AS guard_rejected FROM guard_ref_s, (SELECT guard_score AS guard_threshold
  FROM (SELECT guard_score, row_number() OVER (ORDER BY guard_score) AS r, count(*) OVER () AS n FROM guard_ref_s JOIN ref_cal USING (session_id))
  WHERE r = least(n, ceil((n + 1) * 0.95e0)))""",
)


@query("e9_reference_guard", "session_id " + " ".join(f"{c}:d" for c in GUARD9) + " guard_score:d guard_threshold:d guard_rejected:i", "SELECT * FROM guard_ref")
def e9(t):
    sessions = windows.pseudo_sessions(can_gate.micro_windows(t), can_gate.MICRO_SESSION, HEALTHY)
    first_half = F.col("session_block") < F.floor(F.col("session_blocks") / 2)
    floors = stats.scale_floors(healthy_micro(t), can_gate.STRUCTURAL_FLOORS)
    robust = stats.fit_median_mad(sessions.where(first_half), S)
    reference = {f: (c, max(m, floors[f])) for f, (c, m) in robust.items()}
    base = baselines(t, "micro")
    rows = t.staged("reference_guard", lambda: guards.reference_features(
        base, micro_spread(t), ["session_id"], floors, reference, 3.0))
    calibration = rows.join(sessions.where(first_half).select("session_id").distinct(), "session_id", "left_semi")
    fitted = guards.fit_guard(calibration, GUARD9)
    score = guards.guard_score(fitted, one_sided=True)
    limit = stats.conformal_threshold(calibration.withColumn("guard_score", score), [], "guard_score", 0.05).first()["threshold"]
    return rows.withColumn("guard_score", score).withColumn("guard_threshold", F.lit(limit)).withColumn(
        "guard_rejected", (F.col("guard_score") > limit).cast("int"))


cte(
    poison_center="SELECT capture, contaminated, repetition, median(identifier_log_odds) AS c FROM poisoned GROUP BY 1, 2, 3",
    poison_scale="""SELECT capture, contaminated, repetition, c, greatest(1.4826e0 * median(abs(identifier_log_odds - c)), any_value(l_identifier_log_odds)) AS s
  FROM poisoned JOIN poison_center USING (capture, contaminated, repetition), (SELECT DISTINCT * FROM parent_floor) GROUP BY 1, 2, 3, 4""",
    poison_runs=f"""SELECT *, {div('tp', 'tp + fn')} AS recall, {div('fp', 'fp + tn')} AS fpr FROM (SELECT capture, contaminated, repetition,
    {counts_sql('binary_target', 'alarm')} FROM (SELECT p.capture, contaminated, repetition, binary_target, CASE WHEN abs(identifier_log_odds - c) /
      greatest(s, 1e-12) >= threshold THEN 1 ELSE 0 END AS alarm FROM p100 p JOIN poison_scale USING (capture), parent_limit WHERE window_index >= 5)
    GROUP BY 1, 2, 3)""",
)


@query("a18_failure_boundary", "capture first_recall_below:i first_fpr_above:i",
       """SELECT capture, min(CASE WHEN recall < 0.9e0 THEN contaminated END) AS first_recall_below, min(CASE WHEN fpr > 0.05e0 THEN contaminated END)
  AS first_fpr_above FROM (SELECT capture, contaminated, avg(recall) AS recall, avg(fpr) AS fpr FROM poison_runs GROUP BY 1, 2) GROUP BY 1""")
def a18(t):
    keys = ["capture", "contaminated", "repetition"]
    least = stats.scale_floors(can_gate.parent_windows(t).where(F.col("capture") == HEALTHY), can_gate.LOG_ODDS_FLOOR)["identifier_log_odds"]
    fitted = stats.median_mad(poisoned(t), keys, "identifier_log_odds").withColumn("_s", F.greatest("mad_scale", F.lit(least)))
    calibration = can_gate.parent_scores(t).where(F.col("role") == "calibration")
    limit = stats.fit_quantiles(calibration, ["deviation"], {"t": 0.95})["deviation"]["t"]
    rows = can_gate.parent_windows(t).where(F.col("window_index") >= can_gate.PARENT_BOOT).join(fitted, "capture")
    off = F.abs(F.col("identifier_log_odds") - F.col("center")) / F.greatest("_s", F.lit(EPSILON))
    counted = metrics.with_rates(metrics.confusion(rows.withColumn("alarm", (off >= limit).cast("int")), keys, "binary_target", {"instant": "alarm"}))
    means = stats.run_summary(counted, ["capture", "contaminated"], ["recall", "false_positive_rate"])
    return stats.first_reaching(means, ["capture"], "contaminated", {
        "first_recall_below": F.col("recall_mean") < 0.90, "first_fpr_above": F.col("false_positive_rate_mean") > 0.05})
