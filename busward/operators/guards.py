"""Startup guards: is a session's trusted baseline itself plausible?

A baseline has a fixed number of windows, so its medians and quantiles are small aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from busward.functions.columns import EPSILON, MAD_TO_SIGMA, row_quantile
from busward.operators.stats import fit_median_mad, long_features


def startup_spread(baseline: DataFrame, keys: Sequence[str], position: str, features: Sequence[str], k: int) -> DataFrame:
    """Per session and feature: centre, MAD scale, gap between the half medians, range."""
    rows = long_features(baseline, [*keys, position], features)
    half = F.col(position) < k // 2
    middle = rows.groupBy(*keys, "feature").agg(
        F.percentile("value", F.lit(0.5)).alias("center"),
        F.percentile(F.when(half, F.col("value")), F.lit(0.5)).alias("_a"),
        F.percentile(F.when(~half, F.col("value")), F.lit(0.5)).alias("_b"),
        (F.max("value") - F.min("value")).alias("range"))
    spread = rows.join(middle, [*keys, "feature"]).groupBy(*keys, "feature").agg(
        (MAD_TO_SIGMA * F.percentile(F.abs(F.col("value") - F.col("center")), F.lit(0.5))).alias("scale"))
    return middle.join(spread, [*keys, "feature"]).withColumn("half_gap", F.abs(F.col("_a") - F.col("_b"))).drop("_a", "_b")


def across_features(spread: DataFrame, keys: Sequence[str], floors: Mapping[str, float]) -> DataFrame:
    """p75 over the features of scale, half gap and range, each over its floor."""
    floor = F.create_map(*[x for f, v in floors.items() for x in (F.lit(f), F.lit(max(float(v), EPSILON)))])
    return spread.withColumn("_f", floor[F.col("feature")]).groupBy(*keys).agg(*[
        F.percentile(F.col(c) / F.col("_f"), F.lit(0.75)).alias(c) for c in ("scale", "half_gap", "range")])


def reference_features(baseline: DataFrame, spread: DataFrame, keys: Sequence[str], floors: Mapping[str, float],
                       reference: Mapping[str, tuple[float, float]], threshold: float) -> DataFrame:
    """Seven guard features: internal spread plus distance from the healthy reference (centre, scale)."""
    inner = across_features(spread, keys, floors)
    shift = F.create_map(*[x for f, (c, _) in reference.items() for x in (F.lit(f), F.lit(c))])
    width = F.create_map(*[x for f, (_, s) in reference.items() for x in (F.lit(f), F.lit(max(s, EPSILON)))])
    moved = spread.groupBy(*keys).agg(F.percentile(
        F.abs(F.col("center") - shift[F.col("feature")]) / width[F.col("feature")], F.lit(0.75)).alias("center_shift"))
    z = F.array(*[F.abs(F.col(f) - F.lit(c)) / F.lit(max(s, EPSILON)) for f, (c, s) in reference.items()])
    per_window = baseline.select(*keys, row_quantile(z, 0.75).alias("_d")).groupBy(*keys).agg(
        F.percentile("_d", F.lit(0.90)).alias("window_deviation_q90"), F.max("_d").alias("window_deviation_max"),
        F.avg((F.col("_d") >= threshold).cast("int")).alias("outlier_fraction"))
    return inner.join(moved, list(keys)).join(per_window, list(keys))


def fit_guard(metrics: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Centre and scale of each guard feature over healthy sessions: MAD, else deviation, else one."""
    robust = fit_median_mad(metrics, columns)
    spread = metrics.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return {c: (m, s if s > EPSILON else spread[c] if spread[c] > EPSILON else 1.0) for c, (m, s) in robust.items()}


def guard_score(fitted: Mapping[str, tuple[float, float]], one_sided: bool = False) -> Column:
    """Largest standardized guard feature, two-sided or upward only."""
    parts = [(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()]
    parts = parts if one_sided else [F.abs(p) for p in parts]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]
