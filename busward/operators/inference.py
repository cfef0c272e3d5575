"""Run-level inference: resampling, permutation, corrections, acceptance tables.

Resampling works on blocks of units and all replicates at once; only sums leave a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.operators import resampling

# Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom.
T_CRITICAL = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
              2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
NORMAL_CRITICAL = 1.96
BOOTSTRAP_REPLICATES = 20_000
PERMUTATION_REPLICATES = 100_000


def bootstrap_means(units: DataFrame, keys: Sequence[str], unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Mean of every resample with replacement: keys, replicate, resampled_mean."""
    cut = resampling.blocks(units, keys, unit, value, seed)
    sums = resampling.replicate_sums(cut, keys, replicates, seed)
    return sums.select(*keys, "replicate", (F.col("total") / F.col("_n")).alias("resampled_mean"))


def bootstrap_interval(units: DataFrame, keys: Sequence[str], unit: str, value: str,
                       replicates: int = BOOTSTRAP_REPLICATES, seed: int = 17, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean, null for a single unit. A group has `replicates` means, no more."""
    keys = list(keys)
    means = bootstrap_means(units, keys, unit, value, replicates, seed)
    spread = means.groupBy(*keys).agg(F.percentile("resampled_mean", F.lit(alpha / 2)).alias("_low"),
                                      F.percentile("resampled_mean", F.lit(1 - alpha / 2)).alias("_high"))
    base = units.groupBy(*keys).agg(F.count(value).alias("n_units"), F.avg(value).alias("mean"))
    enough = F.col("n_units") > 1
    return base.join(spread, keys, "left").select(
        *keys, "n_units", "mean", F.when(enough, F.col("_low")).alias("ci_low"), F.when(enough, F.col("_high")).alias("ci_high"))


def sign_flip(differences: DataFrame, keys: Sequence[str], unit: str, value: str,
              replicates: int = PERMUTATION_REPLICATES, seed: int = 19) -> DataFrame:
    """Two-sided (with tolerance) and one-sided sign-flip p values of a mean difference: from all sign patterns for
    keys of few units, from `replicates` random ones beyond."""
    keys = list(keys)
    rows = differences.where(F.col(value).isNotNull())
    observed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.avg(value).alias("observed"))
    counted = resampling.counted_flips(resampling.blocks(rows, keys, unit, value, seed), keys, replicates, seed)
    return observed.join(counted, keys).select(
        *keys, "n_units", "observed", (F.col("_two") / F.col("_of")).alias("p_two_sided"), (F.col("_one") / F.col("_of")).alias("p_one_sided"))


def holm(tests: DataFrame, keys: Sequence[str], p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Holm-adjusted p values within each family of tests; a family has as many rows as methods."""
    order = Window.partitionBy(*keys).orderBy(p, tie)
    ranked = tests.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p))
    return ranked.withColumn("_raw", raw).withColumn(
        "p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "significant", (F.col("p_holm") < alpha).cast("int")).drop("_i", "_m", "_raw")


def summary_interval(summary: DataFrame, mean: str, std: str, n: str) -> DataFrame:
    """t interval from a mean, a deviation and a count; normal beyond the table."""
    table = F.array(*[F.lit(x) for x in T_CRITICAL])
    critical = F.when(F.col(n).between(2, len(T_CRITICAL) + 1), F.get(table, (F.col(n) - 2).cast("int"))) \
        .when(F.col(n) > len(T_CRITICAL) + 1, NORMAL_CRITICAL)
    margin = critical * F.col(std) / F.sqrt(F.col(n))
    return summary.withColumn("ci_low", F.col(mean) - margin).withColumn("ci_high", F.col(mean) + margin)


def paired(runs: DataFrame, unit: Sequence[str], method: str, proposed: str, baselines: Sequence[str],
           metrics: Sequence[str]) -> DataFrame:
    """Proposed minus baseline per unit, baseline and metric."""
    wide = runs.where(F.col(method).isin(proposed, *baselines))
    long = wide.unpivot([*unit, method], list(metrics), "metric", "value")
    mine = long.where(F.col(method) == proposed).select(*unit, "metric", F.col("value").alias("proposed"))
    other = long.where(F.col(method) != proposed).select(*unit, "metric", F.col(method).alias("baseline_method"),
                                                         F.col("value").alias("baseline"))
    return mine.join(other, [*unit, "metric"]).withColumn("difference", F.col("proposed") - F.col("baseline"))


def paired_effects(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean difference, benefit-oriented effect (a lower FPR is a benefit) and standardized effect."""
    out = pairs.groupBy(*keys, "metric", "baseline_method").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("proposed").alias("proposed_mean"), F.avg("baseline").alias("baseline_mean"),
        F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("_sd"))
    benefit = F.when(F.col("metric") == "false_positive_rate", -F.col("mean_difference")).otherwise(F.col("mean_difference"))
    return out.withColumn("benefit_effect", benefit).withColumn(
        "standardized_effect", F.when(F.col("_sd") > 1e-12, F.col("benefit_effect") / F.col("_sd"))
        .when(F.col("benefit_effect") <= 0, 0.0)).drop("_sd")


def acceptance(observed: DataFrame, criteria: Mapping[str, tuple[Column, str, float]], final: str) -> DataFrame:
    """Criterion rows from a single-row table, and a last row that passes when all do."""
    def passes(value: Column, operator: str, required: float) -> Column:
        test = {">=": value >= required, "<=": value <= required, "==": value == required}[operator]
        return F.coalesce(test.cast("int"), F.lit(0))

    rows = [F.struct(F.lit(n).alias("criterion"), v.cast("double").alias("observed_value"), F.lit(op).alias("operator"),
                     F.lit(float(r)).alias("required_value"), passes(v, op, r).alias("passed"))
            for n, (v, op, r) in criteria.items()]
    every = F.least(*[passes(v, op, r) for v, op, r in criteria.values()])
    rows.append(F.struct(F.lit(final).alias("criterion"), every.cast("double").alias("observed_value"),
                         F.lit("==").alias("operator"), F.lit(1.0).alias("required_value"), every.alias("passed")))
    return observed.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def select_eligible(candidates: DataFrame, eligible: Column, order: Sequence[Column], name: str, fallback: str | None = None) -> DataFrame:
    """Mark the first eligible candidate; the fallback when none is. Only the best row leaves the tasks."""
    best = candidates.where(eligible).orderBy(*order).limit(1).agg(F.first(name)).scalar()
    chosen = F.coalesce(best, F.lit(fallback).cast("string"))
    return candidates.withColumn("eligible", F.coalesce(eligible.cast("int"), F.lit(0))).withColumn(
        "selected", F.coalesce((F.col(name) == chosen).cast("int"), F.lit(0)))
