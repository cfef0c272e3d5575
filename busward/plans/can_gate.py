"""The session-normalized gate: baseline, deviation, threshold, alarms and trust."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from busward.functions.columns import EPSILON, MAD_TO_SIGMA, deviation_trust, log_odds, logistic, row_quantile
from busward.operators.state import persistent_2
from busward.operators.stats import fit_quantiles, scale_floors
from busward.operators.windows import STRUCTURAL, pseudo_sessions, rollup_to_parent, window_features
from busward.plans.adapters import HEALTHY, Tables

MICRO, PARENT = 20, 100
MICRO_BOOT, PARENT_BOOT = 25, 5
MICRO_SESSION, PARENT_SESSION = 50, 10
# Absolute scale floors of count, rate, log-odds and timing features.
STRUCTURAL_FLOORS = {f: 0.25 if f in ("id_unique_count", "frame_unique_count") else 0.01 for f in STRUCTURAL}
LOG_ODDS_FLOOR = {"identifier_log_odds": 0.05}
TIMING_FLOOR, TIMING_FRACTION_FLOOR = 0.01, 0.005
# Coefficients of the identifier model used where no fitted model is given.
WEIGHTS = (-0.02, -0.5, 6.0, -0.01, -1.0, 0.5, 3.0)
INTERCEPT = 3.0


def session_scores(windows: DataFrame, floors: Mapping[str, float], boot: int, session_size: int,
                   healthy: str = HEALTHY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deviation of each window from its own session's first `boot` windows, plus the protocol role."""
    features = list(floors)
    sessions = pseudo_sessions(windows, session_size, healthy)
    base = sessions.where(F.col("session_position") < boot)
    centers = base.groupBy("session_id").agg(*[F.percentile(f, F.lit(0.5)).alias(f"c_{f}") for f in features])
    scales = base.select("session_id", *features).join(centers, "session_id").groupBy("session_id").agg(*[
        (MAD_TO_SIGMA * F.percentile(F.abs(F.col(f) - F.col(f"c_{f}")), F.lit(0.5))).alias(f"m_{f}") for f in features])
    fitted = scale_floors(windows.where(F.col("capture") == healthy), floors)
    baseline = centers.join(scales, "session_id").select(
        "session_id", *[f"c_{f}" for f in features],
        *[F.greatest(F.col(f"m_{f}"), F.lit(fitted[f])).alias(f"s_{f}") for f in features])
    scored = sessions.where(F.col("session_position") >= boot).join(baseline, "session_id")
    z = F.array(*[F.abs(F.col(f) - F.col(f"c_{f}")) / F.greatest(F.col(f"s_{f}"), F.lit(EPSILON)) for f in features])
    role = (F.when(F.col("session_block").isNull(), "attack_capture")
            .when(F.col("session_block") < F.floor(F.col("session_blocks") / 2), "calibration").otherwise("holdout"))
    return scored.select(
        "session_id", "capture", "window_index", "session_position", "start_row", "binary_target",
        "attack_frame_count", role.alias("role"), row_quantile(z, 0.75).alias("deviation"), *keep)


def with_alarms(scored: DataFrame, target_fpr: float) -> DataFrame:
    """Threshold at the calibration quantile, instant and two-in-a-row alarms, trust."""
    limit = fit_quantiles(scored.where(F.col("role") == "calibration"), ["deviation"], {"t": 1.0 - target_fpr})
    limit = F.lit(limit["deviation"]["t"] if limit else None).cast("double")
    alarmed = scored.withColumn("threshold", limit).withColumn(
        "alarm_instant", F.coalesce((F.col("deviation") >= F.col("threshold")).cast("int"), F.lit(0)))
    alarmed = persistent_2(alarmed, ["session_id"], "session_position", {"alarm_persistent_2": "alarm_instant"})
    return alarmed.withColumn("can_trust", deviation_trust(F.col("deviation"), F.col("threshold")))


def counted_frames(t: Tables) -> tuple[DataFrame, int]:
    """The frames, numbered once for both window sizes, and how many they are."""
    frames = t.staged("frames", t.frames)
    return frames, frames.count()


def micro_windows(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        frames, rows = counted_frames(t)
        return window_features(frames, MICRO, rows=rows)
    return t.staged("micro_windows", build)


def parent_windows(t: Tables) -> DataFrame:
    """100-frame windows, payload features and all, with the identifier model's log-odds."""
    def build() -> DataFrame:
        frames, rows = counted_frames(t)
        probability = logistic([F.col(f) for f in STRUCTURAL], WEIGHTS, INTERCEPT)
        return (window_features(frames, PARENT, payload=True, rows=rows)
                .withColumn("attack_probability", probability)
                .withColumn("identifier_log_odds", log_odds(F.col("attack_probability"))))
    return t.staged("parent_windows", build)


def micro_scores(t: Tables) -> DataFrame:
    return t.staged("micro_scores", lambda: session_scores(
        micro_windows(t), STRUCTURAL_FLOORS, MICRO_BOOT, MICRO_SESSION))


def parent_scores(t: Tables) -> DataFrame:
    return t.staged("parent_scores", lambda: session_scores(
        parent_windows(t), LOG_ODDS_FLOOR, PARENT_BOOT, PARENT_SESSION))


def micro_gate(t: Tables, target_fpr: float = 0.01) -> DataFrame:
    return with_alarms(micro_scores(t), target_fpr)


def parent_gate(t: Tables, target_fpr: float = 0.05) -> DataFrame:
    return with_alarms(parent_scores(t), target_fpr)


def multiscale(t: Tables) -> DataFrame:
    return t.staged("multiscale", lambda: fuse_scales(micro_gate(t), parent_gate(t)))


def fuse_scales(micro_gated: DataFrame, parent_gated: DataFrame) -> DataFrame:
    """Parent windows with both gates: the 100-frame gate or any of the five 20-frame windows."""
    micro = rollup_to_parent(micro_gated, ["alarm_instant", "alarm_persistent_2"], ["deviation"], ["deviation"],
                             ["can_trust"])
    parent = parent_gated.select(
        "capture", F.col("window_index").alias("parent_window_index"), "role", "binary_target", "attack_frame_count",
        F.col("alarm_instant").alias("w100_instant"), F.col("alarm_persistent_2").alias("w100_persistent_2"),
        F.col("can_trust").alias("w100_trust"))
    both = micro.join(parent, ["capture", "parent_window_index"])
    return (both.withColumn("multi_instant", F.greatest("w100_instant", "any_alarm_instant"))
            .withColumn("multi_persistent_2", F.greatest("w100_persistent_2", "any_alarm_persistent_2"))
            .withColumn("multi_trust", F.least("w100_trust", "can_trust_min")))
