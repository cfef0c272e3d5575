"""Validated joins, audits of joins, and parameter expansions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from busward.functions.columns import clamp
from busward.operators.metrics import confusion, with_rates
from busward.operators.ordering import last_known, streaks


def lookup(rows: DataFrame, parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach parameters by key; whether that side is broadcast is left to Spark's byte limit."""
    return rows.join(parameters, list(keys), "left")


def one_to_one_audit(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Row counts, duplicate keys, unmatched rows and label mismatches of an intended 1:1 join."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ln"), *[F.first(a).alias(f"_l{i}") for i, (a, _) in enumerate(pairs)])
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rn"), *[F.first(b).alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    both = l.join(r, list(keys), "full_outer")
    differ = F.lit(False)
    for i in range(len(pairs)):
        differ = differ | ~F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}"))
    matched = F.col("_ln").isNotNull() & F.col("_rn").isNotNull()
    return both.agg(
        F.coalesce(F.sum("_ln"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("_rn"), F.lit(0)).alias("right_rows"),
        F.sum(matched.cast("int")).alias("matched_keys"),
        F.sum(F.col("_rn").isNull().cast("int")).alias("left_only"),
        F.sum(F.col("_ln").isNull().cast("int")).alias("right_only"),
        F.sum(((F.coalesce("_ln", F.lit(0)) > 1) | (F.coalesce("_rn", F.lit(0)) > 1)).cast("int")).alias("duplicate_keys"),
        F.sum((matched & differ).cast("int")).alias("mismatches"))


def cross_check(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Full outer 1:1 comparison of two independent counts."""
    return left.join(right, list(keys), "full_outer").withColumn(
        "count_match", F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Keyed content hashes before and after: unchanged, changed, added or removed."""
    b = before.select(key, F.col(digest).alias("_b"))
    a = after.select(key, F.col(digest).alias("_a"))
    status = (F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
              .when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed"))
    return b.join(a, key, "full_outer").select(
        key, F.coalesce("_b", F.lit("missing")).alias("before_digest"),
        F.coalesce("_a", F.lit("missing")).alias("after_digest"), status.alias("status"))


def draw_audit(rows: DataFrame, keys: Sequence[str], pool_size: str, drawn: str) -> DataFrame:
    """How many windows each unit drew, how many were distinct, and whether draws repeated."""
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("drawn"), F.first(pool_size).alias("pool_windows"),
        F.countDistinct(drawn).alias("unique_windows"))
    return counted.withColumn("with_replacement", (F.col("drawn") > F.col("pool_windows")).cast("int"))


def severity_counterfactual(rows: DataFrame, medians: DataFrame, keys: Sequence[str], median: str, score: str,
                            attacked: Column, severities: Sequence[float], into: str = "score") -> DataFrame:
    """Attacked scores scaled back towards the healthy median, for every severity."""
    levels = F.array(*[F.lit(float(s)) for s in severities])
    varied = rows.join(medians, list(keys)).withColumn("severity", F.explode(levels))
    moved = F.col(median) + F.col("severity") * (F.col(score) - F.col(median))
    return varied.withColumn(into, F.when(attacked, clamp(moved)).otherwise(F.col(score)))


def sensitivity_runs(context: DataFrame, grid: Sequence[tuple[float, int, int]]) -> DataFrame:
    """Confusion counts per run and monitor setting.

    Each (threshold, source) is a key of its own with one pair of streaks; the persistence settings
    are columns computed from that pair.
    """
    thresholds = sorted({t for t, _, _ in grid})
    settings = sorted({(a, r) for _, a, r in grid})
    sources = [F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("source"), F.lit(0).alias("latch"),
                        (F.col(f"{s}_score") < t).alias("bad")) for t in thresholds for s in ("gnss", "v2x", "sensor")]
    sources += [F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("source"), F.lit(1).alias("latch"),
                         (F.col(f"{s}_failure") == 1).alias("bad")) for t in thresholds for s in ("identity", "device")]
    long = context.select("run", "seq", "ground_truth_attack", F.explode(F.array(*sources)).alias("_m")).select(
        "run", "seq", "ground_truth_attack", "_m.*")
    keys = ["run", "threshold", "source"]
    run = streaks(long, keys, "seq", {"_bad": F.col("bad"), "_good": ~F.col("bad")})
    state = last_known(run, keys, "seq", {
        f"s_{a}_{r}": F.when(F.col("_bad") >= F.when(F.col("latch") == 1, 1).otherwise(a), 1).when(F.col("_good") >= r, 0)
        for a, r in settings})
    alarms = state.groupBy("run", "threshold", "seq").agg(
        F.first("ground_truth_attack").alias("truth"),
        *[F.coalesce(F.max(f"s_{a}_{r}"), F.lit(0)).alias(f"s_{a}_{r}") for a, r in settings])
    counted = confusion(alarms, ["run", "threshold"], "truth", {f"{a}_{r}": f"s_{a}_{r}" for a, r in settings})
    part = F.split("method", "_")
    return counted.withColumn("attack_rows", part[0].cast("int")).withColumn("recovery_rows", part[1].cast("int"))


def sensitivity_grid(context: DataFrame, grid: Sequence[tuple[float, int, int]]) -> DataFrame:
    """Mean metrics over runs for every monitor setting."""
    return with_rates(sensitivity_runs(context, grid)).groupBy("threshold", "attack_rows", "recovery_rows").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
        F.avg("false_positive_rate").alias("false_positive_rate_mean"))
