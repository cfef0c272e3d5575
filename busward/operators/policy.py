"""Evidence scores, trust fusion and graded decisions as column expressions over ordered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from busward.functions.columns import clamp, has_any

# Evidence weights of the trust engine.
WEIGHTS = {
    "identity": 0.15, "device_posture": 0.13, "can_behavior": 0.20, "gnss_imu_consistency": 0.17,
    "v2x_consistency": 0.10, "sensor_control_consistency": 0.20, "freshness": 0.05,
}
# Monitor thresholds and persistence.
SOURCE_THRESHOLDS = {"gnss": 0.30, "v2x": 0.30, "sensor_control": 0.35}
ATTACK_ROWS, RECOVERY_ROWS = 2, 3
IDENTITY_CAP, POSTURE_CAP = 0.25, 0.35
# Names of the compared methods, sources and scenarios.
POLICY_METHODS = {
    "legacy_weighted_threshold": "legacy_alarm",
    "hard_startup_guard": "hard_guard_alarm",
    "context_only_without_vehicle_state": "context_only_no_state_alarm",
    "frozen_w100_persistent_without_vehicle_state": "w100_persistent_no_state_alarm",
    "advisory_instant_without_vehicle_state": "advisory_instant_no_state_alarm",
    "proposed_persistent_without_vehicle_state": "persistent_no_state_alarm",
    "persistent_with_vehicle_state_ablation": "persistent_with_state_alarm",
}
SOURCES = ("can", "gnss", "v2x", "identity", "device_posture")
CRITICAL = ("can", "gnss", "identity", "device_posture")
SCENARIOS = ("missing_full_session", "stale_delay_5", "compromised_detected_false_healthy",
             "compromised_undetected_false_healthy", "conflicting_high_risk")


def fuse(evidence: Mapping[str, tuple[Column, Column]], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Reliability-weighted fusion of (score, quality) pairs, scaled by the covered weight."""
    weighted, active = F.lit(0.0), F.lit(0.0)
    for source, weight in weights.items():
        score, quality = evidence[source]
        weighted = weighted + weight * quality * score
        active = active + weight * quality
    total = sum(weights.values())
    return F.when(active > 0, weighted / F.when(active > 0, active)).otherwise(0.0) * (active / total)


def contributions(evidence: Mapping[str, tuple[Column, Column]], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted share of each source as a map."""
    names = F.array(*[F.lit(s) for s in weights])
    values = F.array(*[w * evidence[s][1] * evidence[s][0] for s, w in weights.items()])
    return F.map_from_arrays(names, values)


def failure_cap(identity_failure: Column, device_failure: Column) -> Column:
    """Cap a hard failure puts on trust, null without one."""
    return F.when(identity_failure == 1, IDENTITY_CAP).when(device_failure == 1, POSTURE_CAP)


def access_decision(trust: Column, critical: Column, safety_critical: Column, high_privilege: Column,
                    allow: float = 0.75, privileged: float = 0.85, restrict: float = 0.50) -> Column:
    """Decision on one request; the first rule that holds wins."""
    required = F.when(high_privilege, privileged).otherwise(allow)
    return (
        F.when(critical & safety_critical, "SAFE_FALLBACK").when(critical, "DENY")
        .when(trust >= required, "ALLOW")
        .when(safety_critical, "SAFE_FALLBACK")
        .when(high_privilege & (trust >= allow), "STEP_UP_VERIFY")
        .when(trust >= restrict, "RESTRICT")
        .otherwise("DENY")
    )


def source_policy(active: Column) -> tuple[Column, Column, Column]:
    """Local control, cooperative action and telemetry from the set of active sources."""
    none = F.size(active) == 0
    local = (F.when(none, "ALLOW")
             .when(has_any(active, ("identity", "device_posture", "can", "sensor_control", "gnss")), "SAFE_FALLBACK")
             .otherwise("ALLOW_LOCAL_ONLY"))
    cooperative = (F.when(none, "ALLOW").when(has_any(active, ("v2x",)), "DENY_COOPERATIVE_ACTION")
                   .otherwise("REQUIRE_REVERIFICATION"))
    telemetry = (F.when(none, "ALLOW").when(has_any(active, ("identity", "device_posture")), "DENY")
                 .otherwise("RESTRICT"))
    return local, cooperative, telemetry


def guarded_policy(noncan: Column, instant: Column, persistent: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """The same with bus alarms and a startup guard that overrides everything."""
    silent = (F.size(noncan) == 0) & (instant == 0)
    local = (
        F.when(rejected == 1, "SAFE_FALLBACK").when(silent, "ALLOW")
        .when((persistent == 1) | has_any(noncan, ("identity", "device_posture", "gnss", "sensor_control")),
              "SAFE_FALLBACK")
        .when(instant == 1, "VERIFY_RESTRICT").otherwise("ALLOW_LOCAL_ONLY"))
    cooperative = (
        F.when(rejected == 1, "DENY_COOPERATIVE_ACTION").when(silent, "ALLOW")
        .when(has_any(noncan, ("v2x",)), "DENY_COOPERATIVE_ACTION").otherwise("REQUIRE_REVERIFICATION"))
    telemetry = (
        F.when(rejected == 1, "DENY").when(silent, "ALLOW")
        .when(has_any(noncan, ("identity", "device_posture")), "DENY").otherwise("RESTRICT"))
    return local, cooperative, telemetry


def soft_guard_policy(noncan: Column, instant: Column, persistent: Column, warning: Column,
                      identity_failure: Column, device_failure: Column) -> dict[str, Column]:
    """A startup warning alone restricts; together with bus evidence it forces the fallback."""
    critical = has_any(noncan, ("identity", "device_posture", "gnss", "sensor_control"))
    hard = (persistent == 1) | critical
    v2x = has_any(noncan, ("v2x",))

    def choose(values: Sequence[str]) -> Column:
        return (F.when(hard, values[0]).when((warning == 1) & (instant == 1), values[1])
                .when(instant == 1, values[2]).when(warning == 1, values[3]).when(v2x, values[4])
                .otherwise(values[5]))

    return {
        "local_control_action": choose(("SAFE_FALLBACK", "SAFE_FALLBACK", "VERIFY_RESTRICT",
                                        "ALLOW_LOCAL_RESTRICTED", "ALLOW_LOCAL_ONLY", "ALLOW")),
        "local_action_basis": choose((
            "persistent_or_independent_critical_evidence", "startup_warning_plus_can_evidence",
            "single_multiscale_can_evidence", "startup_quality_warning_only", "v2x_evidence",
            "no_active_evidence")),
        "cooperative_action": F.when(v2x | (identity_failure == 1) | (device_failure == 1), "DENY_COOPERATIVE_ACTION")
        .when(warning == 1, "REQUIRE_REVERIFICATION").otherwise("ALLOW"),
        "telemetry_action": F.when(has_any(noncan, ("identity", "device_posture")), "DENY")
        .when((warning == 1) | (instant == 1), "RESTRICT").otherwise("ALLOW"),
        "operating_mode": F.when(warning == 1, "BASELINE_UNTRUSTED").otherwise("BASELINE_ACCEPTED"),
    }


def graded_policy(rows: DataFrame, noncan: str, instant: str, persistent: str, w100_persistent: str,
                  warning: str) -> DataFrame:
    """Seven alarm variants and the graded actions; the vehicle-state source never decides."""
    names = F.col(noncan)
    stateless = F.array_except(names, F.array(F.lit("sensor_control")))
    with_state = (F.size(names) > 0).cast("int")
    no_state = (F.size(stateless) > 0).cast("int")
    critical = has_any(stateless, ("identity", "device_posture", "gnss"))
    v2x = has_any(stateless, ("v2x",))
    i, p, w = F.col(instant), F.col(persistent), F.col(warning)

    def choose(values: Sequence[str]) -> Column:
        return (F.when((p == 1) | critical, values[0]).when(i == 1, values[1]).when(w == 1, values[2])
                .when(v2x, values[3]).otherwise(values[4]))

    return (
        rows.withColumn("hard_guard_alarm", F.greatest(w, p, no_state))
        .withColumn("context_only_no_state_alarm", no_state)
        .withColumn("w100_persistent_no_state_alarm", F.greatest(F.col(w100_persistent), no_state))
        .withColumn("advisory_instant_no_state_alarm", F.greatest(i, no_state))
        .withColumn("persistent_no_state_alarm", F.greatest(p, no_state))
        .withColumn("persistent_with_state_alarm", F.greatest(p, with_state))
        .withColumn("graded_local", choose(("SAFE_FALLBACK", "MONITOR_VERIFY", "DEGRADED_MONITORING",
                                            "ALLOW_LOCAL_ONLY", "ALLOW")))
        .withColumn("graded_basis", choose((
            "persistent_can_or_independent_critical_context", "instant_can_advisory",
            "startup_quality_warning_only", "v2x_context_only", "no_active_evidence")))
        .withColumn("graded_cooperative", F.when(v2x, "DENY_COOPERATIVE_ACTION")
                    .when(w == 1, "REQUIRE_REVERIFICATION").otherwise("ALLOW"))
        .withColumn("graded_telemetry", F.when(has_any(stateless, ("identity", "device_posture")), "DENY")
                    .when((i == 1) | (w == 1), "RESTRICT").otherwise("ALLOW")))


def gate_action(instant: Column, persistent: Column) -> Column:
    return F.when(persistent == 1, "SAFE_FALLBACK").when(instant == 1, "VERIFY_RESTRICT").otherwise("ALLOW")


def context_scores(gnss_error: Column, imu_gap: Column, v2x_rmse: Column, neighbours: Column,
                   acceleration_error: Column, acceleration: Column, speed: Column) -> dict[str, Column]:
    """Consistency scores of the context sources; a vehicle alone gets a low-quality V2X score."""
    alone = neighbours == 0
    return {
        "gnss_imu_score": clamp(F.exp(-gnss_error / 7.0) * F.exp(-imu_gap / 3.0)),
        "v2x_score": F.when(alone, 0.85).otherwise(clamp(F.exp(-v2x_rmse / 6.0))),
        "v2x_quality": F.when(alone, 0.45).otherwise(1.0),
        "sensor_score": clamp(F.exp(-acceleration_error / 2.5)),
        "can_score": clamp(0.98 - 0.03 * F.greatest(F.lit(0.0), F.abs(acceleration) - 4.5)
                           - 0.02 * F.greatest(F.lit(0.0), speed - 14.0)),
    }


def neighbour_summary(reports: DataFrame, ego: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Neighbours of the one ego vehicle per time step: linear in the reports, never vehicle pairs.

    `ego` has one row per key (x, y); `reports` rows carry x, y, speed and the reported rx, ry.
    """
    near = reports.join(ego.select(*keys, F.col("x").alias("ego_x"), F.col("y").alias("ego_y")), list(keys))
    dx, dy = F.col("x") - F.col("ego_x"), F.col("y") - F.col("ego_y")
    ex, ey = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    near = near.withColumn("_d", F.sqrt(dx * dx + dy * dy)).withColumn("_e2", ex * ex + ey * ey)
    inside = F.col("_d") <= radius
    return near.groupBy(*keys).agg(
        F.sum(inside.cast("int")).alias("neighbours"),
        F.coalesce(F.min(F.when(inside, F.col("_d"))), F.lit(-1.0)).alias("nearest_distance"),
        F.coalesce(F.avg(F.when(inside, F.col("speed"))), F.lit(0.0)).alias("mean_neighbour_speed"),
        F.coalesce(F.sqrt(F.avg(F.when(inside, F.col("_e2")))), F.lit(0.0)).alias("position_rmse"))


def attack_overlay(phase: Column, offset: Column) -> dict[str, Column]:
    """Attack controls of a phase at an offset: bias ramp, false reports, bus probability, failures."""
    gps, both = phase == "gps_spoofing", phase == "combined_attack"
    v2x = phase == "v2x_falsification"
    return {
        "gnss_bias_x": F.when(gps, 20.0 + 0.55 * offset).when(both, 55.0 + 0.35 * offset).otherwise(0.0),
        "gnss_bias_y": F.when(gps, 12.0 + 0.20 * offset).when(both, -35.0).otherwise(0.0),
        "sybil_messages": F.when(v2x, 6).when(both, 8).otherwise(0),
        "v2x_false_offset": F.when(v2x, 65.0).when(both, 90.0).otherwise(0.0),
        "can_attack_probability": F.when(phase == "can_injection", 0.98).when(both, 0.99).otherwise(0.02),
        "identity_failure": (phase == "identity_compromise").cast("int"),
        "device_failure": both.cast("int"),
    }


def perturbations(scenarios: Sequence[str] = SCENARIOS, sources: Sequence[str] = SOURCES) -> Column:
    """All (scenario, target) variants and the undisturbed reference, as an array to explode."""
    pairs = [("reference", "none"), *[(s, x) for s in scenarios for x in sources]]
    return F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(x).alias("target")) for s, x in pairs])


def perturb(rows: DataFrame, instant: str, late: str = "_late") -> DataFrame:
    """Risk of every source, instant alarm and quality flag under each variant.

    `rows` carries 0/1 columns risk_<source>, the instant alarm, and each of them delayed (suffix).
    """
    varied = rows.withColumn("_v", F.explode(perturbations()))
    scenario, target = F.col("_v.scenario"), F.col("_v.target")
    silenced = scenario.isin("missing_full_session", "compromised_detected_false_healthy",
                             "compromised_undetected_false_healthy")

    def under(column: str, source: str) -> Column:
        hit = target == source
        return (F.when(hit & silenced, 0).when(hit & (scenario == "stale_delay_5"), F.col(f"{column}{late}"))
                .when(hit & (scenario == "conflicting_high_risk"), 1).otherwise(F.col(column)))

    quality = F.when(scenario.isin("reference", "compromised_undetected_false_healthy"), 0).otherwise(1)
    kept = [c for c in rows.columns if not c.startswith("risk_") and c != instant and not c.endswith(late)]
    return varied.select(
        *kept, scenario.alias("scenario"), target.alias("target"),
        *[under(f"risk_{s}", s).alias(f"risk_{s}") for s in SOURCES],
        under(instant, "can").alias("instant"), quality.alias("quality_issue"))


def perturbed_actions(rows: DataFrame) -> DataFrame:
    """Prediction and the one action each perturbed row receives."""
    prediction = F.greatest(*[F.col(f"risk_{s}") for s in SOURCES])
    critical = F.greatest(*[F.col(f"risk_{s}") for s in CRITICAL])
    return rows.withColumn("prediction", prediction).withColumn(
        "action", F.when(critical == 1, "SAFE_FALLBACK").when(F.col("instant") == 1, "MONITOR_VERIFY")
        .when(F.col("quality_issue") == 1, "VERIFY_RESTRICT").when(F.col("risk_v2x") == 1, "ALLOW_LOCAL_ONLY")
        .otherwise("ALLOW"))


def counted_rows(rows: DataFrame, unit: Sequence[str], others: Sequence[str], instant: str, late: str = "_late") -> DataFrame:
    """Rows that agree in unit, 0/1 columns and `others`, counted as `_rows`: what perturb needs, in few rows."""
    bits = [c for c in rows.columns if c.startswith("risk_") or c == instant or c.endswith(late)]
    return rows.groupBy(*dict.fromkeys([*unit, *others, *bits])).agg(F.count(F.lit(1)).alias("_rows"))


def perturbed_run_metrics(rows: DataFrame, unit: Sequence[str], truth: str) -> DataFrame:
    """Counts, unsafe allows and restriction per unit and variant, with the F1 loss to the reference.

    A row stands for `_rows` rows.
    """
    from busward.operators.metrics import with_rates
    from busward.functions.columns import safe_divide

    attack, alarm = F.col(truth) == 1, F.col("prediction") == 1
    allow = F.col("action") == "ALLOW"

    def n(c: Column) -> Column:
        return F.sum(F.col("_rows") * c.cast("int"))

    counted = rows.groupBy(*unit, "scenario", "target").agg(
        n(attack & alarm).alias("tp"), n(~attack & alarm).alias("fp"), n(~attack & ~alarm).alias("tn"),
        n(attack & ~alarm).alias("fn"), n(attack).alias("attack_rows"), n(~attack).alias("benign_rows"),
        n(attack & allow).alias("unsafe_allow_count"), n(alarm & allow).alias("high_risk_allow_count"),
        n((F.col("quality_issue") == 1) & allow).alias("quality_issue_allow_count"),
        n(~attack & ~allow).alias("_restricted"), (n(allow) / F.sum("_rows")).alias("full_allow_rate"),
        (n(F.col("action") == "SAFE_FALLBACK") / F.sum("_rows")).alias("safe_fallback_rate"))
    rated = with_rates(counted).withColumn(
        "unsafe_allow_rate", safe_divide(F.col("unsafe_allow_count"), F.col("attack_rows"))).withColumn(
        "benign_restriction_rate", safe_divide(F.col("_restricted"), F.col("benign_rows"))).drop("_restricted")
    reference = rated.where(F.col("scenario") == "reference").select(*unit, F.col("f1").alias("reference_f1"))
    return rated.join(reference, list(unit)).withColumn("f1_loss", F.col("reference_f1") - F.col("f1"))


def observability(rows: DataFrame, unit: Sequence[str], truth: str, instant: str, warning: str) -> DataFrame:
    """What remains visible when one source reports healthy: shared codes, silent rows, Bayes error.

    Rows that agree in all bits are counted first; each of those few becomes a bit code of its visible evidence.
    """
    bits = [*[f"risk_{s}" for s in SOURCES], instant, warning]
    rows = rows.groupBy(*unit, *bits).agg(F.sum(truth).alias("_attacks"), F.sum(1 - F.col(truth)).alias("_benign"))
    views = F.array(*[F.struct(F.lit(s).alias("target"), F.lit(w).alias("with_warning"))
                      for s in SOURCES for w in (0, 1)])
    seen = rows.withColumn("_v", F.explode(views))
    target = F.col("_v.target")
    code = F.lit(0)
    for bit, source in enumerate(SOURCES):
        code = code.bitwiseOR(F.when(target == source, 0).otherwise(F.shiftleft(F.col(f"risk_{source}"), bit)))
    code = code.bitwiseOR(F.when(target == "can", 0).otherwise(F.shiftleft(F.col(instant), 5)))
    code = code.bitwiseOR(F.shiftleft(F.col(warning) * F.col("_v.with_warning"), 6))
    codes = seen.groupBy(*unit, target.alias("target"), F.col("_v.with_warning").alias("with_warning"),
                         code.alias("code")).agg(F.sum("_attacks").alias("_a"), F.sum("_benign").alias("_b"))
    shared = (F.col("_a") > 0) & (F.col("_b") > 0)
    return codes.groupBy(*unit, "target", "with_warning").agg(
        F.sum("_a").alias("attack_rows"), F.sum("_b").alias("benign_rows"),
        F.sum(shared.cast("int")).alias("shared_signatures"),
        F.sum(F.when(shared, F.col("_a")).otherwise(0)).alias("ambiguous_attack_rows"),
        F.sum(F.when(shared, F.col("_b")).otherwise(0)).alias("ambiguous_benign_rows"),
        F.sum(F.when(F.col("code") == 0, F.col("_a")).otherwise(0)).alias("silent_attack_rows"),
        F.sum(F.when(F.col("code") == 0, F.col("_b")).otherwise(0)).alias("silent_benign_rows"),
        F.sum(F.least("_a", "_b")).alias("bayes_error_count"))
