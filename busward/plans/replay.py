"""Context monitors, window replay and the policy decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busward.functions.columns import digest_number, split_sources
from busward.operators import policy
from busward.operators.ordering import number_by_hash, number_rows
from busward.operators.state import hysteresis, persistent_2, trust_memory
from busward.plans.adapters import Tables
from busward.plans.can_gate import multiscale

ATTACK_CAPTURES = ("A_F", "A_O", "N_O", "R_F", "R_O")
WARNED = ("R_O",)
DENSITIES = ("representative_all", "low_1_5", "medium_6_20", "high_21_100")
CAN_PHASE = "error"
UNIT = ["run", "source_file", "density_scenario"]
SEED = 7


def evidence(rows: DataFrame) -> dict[str, tuple[Column, Column]]:
    one = F.lit(1.0)
    return {
        "identity": (F.col("identity_score"), one), "device_posture": (F.col("device_score"), one),
        "can_behavior": (F.col("can_score"), F.lit(0.9)), "gnss_imu_consistency": (F.col("gnss_score"), one),
        "v2x_consistency": (F.col("v2x_score"), one), "sensor_control_consistency": (F.col("sensor_score"), one),
        "freshness": (F.col("freshness_score"), one),
    }


def monitored(context: DataFrame, thresholds=policy.SOURCE_THRESHOLDS, attack: int = policy.ATTACK_ROWS,
              recovery: int = policy.RECOVERY_ROWS) -> DataFrame:
    """Persistent monitors of the scores and latches of the failures, with the sorted active names."""
    scores = {"gnss": "gnss_score", "v2x": "v2x_score", "sensor_control": "sensor_score"}
    monitors = {f"m_{s}": (F.col(scores[s]) < limit, attack, recovery) for s, limit in thresholds.items()}
    monitors["m_identity"] = (F.col("identity_failure") == 1, 1, recovery)
    monitors["m_device_posture"] = (F.col("device_failure") == 1, 1, recovery)
    out = hysteresis(context, ["run"], "seq", monitors)
    names = [F.when(F.col(f"m_{s}") == 1, s) for s in ("device_posture", "gnss", "identity", "sensor_control", "v2x")]
    return out.withColumn("active_noncan_sources", F.concat_ws(";", *names))


def trusted(context: DataFrame) -> DataFrame:
    """Instantaneous and continuous trust; the legacy alarm is low trust or a hard failure."""
    cap = policy.failure_cap(F.col("identity_failure"), F.col("device_failure"))
    fused = context.withColumn("fused", policy.fuse(evidence(context)))
    out = trust_memory(fused, ["run"], "seq", F.col("fused"), cap)
    low = (F.col("continuous_trust") < 0.75) | (F.col("identity_failure") == 1) | (F.col("device_failure") == 1)
    return out.withColumn("instantaneous_trust", F.least(F.col("fused"), F.coalesce(cap, F.lit(1.0)))).withColumn(
        "security_alarm", low.cast("int"))


def pools(parents: DataFrame) -> DataFrame:
    """Windows a replay may draw: benign, every attack window, and attack windows by density band."""
    count = F.col("attack_frame_count")
    names = F.when(F.col("binary_target") == 0, F.array(F.lit("benign"))).otherwise(F.array(
        F.lit("representative_all"),
        F.when(count <= 5, "low_1_5").when(count <= 20, "medium_6_20").otherwise("high_21_100")))
    rows = parents.where(F.col("role") == "attack_capture").select(
        F.col("capture").alias("source_file"), F.explode(names).alias("pool"), "parent_window_index",
        count.alias("replayed_attack_frames"), "w100_instant", "multi_instant", "multi_trust")
    digest = digest_number(SEED, F.col("source_file"), F.col("parent_window_index").cast("string"))
    return number_by_hash(rows, ["source_file", "pool"], digest, ["parent_window_index"], "pick")


def with_units(context: DataFrame) -> DataFrame:
    """One source capture and one density scenario per run."""
    source = F.element_at(F.array(*[F.lit(c) for c in ATTACK_CAPTURES]), (F.col("run") % 5 + 1).cast("int"))
    density = F.element_at(F.array(*[F.lit(d) for d in DENSITIES]),
                           (F.floor(F.col("run") / 5) % 4 + 1).cast("int"))
    return context.withColumn("source_file", source).withColumn("density_scenario", density)


def replayed(context: DataFrame, pool: DataFrame) -> DataFrame:
    """Give the k-th row of each kind the k-th drawn window of that kind.

    The pool has one hashed order; a unit draws a slice of it from its own offset. Draws repeat only
    when a unit needs more windows than the pool holds.
    """
    units = with_units(context).withColumn(
        "pool", F.when(F.col("phase") == CAN_PHASE, F.col("density_scenario")).otherwise("benign"))
    ranked = number_rows(units, [*UNIT, "pool"], ["seq"], F.floor(F.col("seq") / 65_536), "k_th")
    size = pool.groupBy("source_file", "pool").agg(F.count(F.lit(1)).alias("pool_windows"))
    offset = digest_number(SEED, F.col("run").cast("string"), F.col("pool"))
    asked = ranked.join(size, ["source_file", "pool"], "left").withColumn(
        "pick", F.pmod(offset + F.col("k_th"), F.col("pool_windows")))
    return asked.join(pool, ["source_file", "pool", "pick"], "left").fillna(
        0, ["multi_instant", "w100_instant", "replayed_attack_frames"])


def decisions(t: Tables) -> DataFrame:
    return t.staged("decisions", lambda: decide(t))


def decide(t: Tables) -> DataFrame:
    """Every context row with its replayed bus evidence, alarm variants and graded actions."""
    # Staged, since every ordered step reads its rows once more for what it carries.
    context = t.staged("context", t.context)
    watched = t.staged("watched", lambda: trusted(monitored(context)))
    rows = replayed(watched, pools(multiscale(t)))
    rows = persistent_2(rows, UNIT, "seq", {"multi_persistent_2": "multi_instant", "w100_persistent_2": "w100_instant"})
    rows = rows.withColumn("startup_quality_warning", F.col("source_file").isin(*WARNED).cast("int")).withColumn(
        "legacy_alarm", F.col("security_alarm")).withColumn("noncan", split_sources(F.col("active_noncan_sources")))
    soft = policy.soft_guard_policy(F.col("noncan"), F.col("multi_instant"), F.col("multi_persistent_2"),
                                    F.col("startup_quality_warning"), F.col("identity_failure"), F.col("device_failure"))
    graded = policy.graded_policy(rows.select("*", *[c.alias(n) for n, c in soft.items()]), "noncan", "multi_instant",
                                  "multi_persistent_2", "w100_persistent_2", "startup_quality_warning")
    return graded.withColumn("has_noncan", (F.size("noncan") > 0).cast("int"))
