"""Robust statistics, thresholds and summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from busward.functions.columns import EPSILON, MAD_TO_SIGMA, safe_divide, wilson_interval
from busward.operators.ordering import attach, exact_quantiles, running_totals, value_buckets, values_at_ranks

DENSITY_BINS = (("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-50", 21, 50), ("51-99", 51, 99), ("100", 100, 100))


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows (keys, feature, value)."""
    wide = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(keys), list(features), "feature", "value")


def fit_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of whole columns as fitted numbers, one small row per column."""
    rows = exact_quantiles(long_features(df, [], columns), ["feature"], "value", probabilities).collect()
    return {r["feature"]: {p: r[p] for p in probabilities} for r in rows}


def fit_median_mad(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and 1.4826 * MAD of whole columns; no column is gathered in one task."""
    middle = fit_quantiles(df, columns, {"m": 0.5})
    present = [c for c in columns if c in middle]
    if not present:
        return {}
    off = df.select(*[F.abs(F.col(c) - F.lit(middle[c]["m"])).alias(c) for c in present])
    spread = fit_quantiles(off, present, {"m": 0.5})
    return {c: (middle[c]["m"], MAD_TO_SIGMA * spread[c]["m"]) for c in present}


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and MAD scale per key for groups that are small by construction, such as a baseline."""
    middle = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("center"))
    off = df.join(middle, list(keys)).withColumn("_off", F.abs(F.col(value) - F.col("center")))
    return off.groupBy(*keys).agg(
        F.first("center").alias("center"), (MAD_TO_SIGMA * F.percentile("_off", F.lit(0.5))).alias("mad_scale"))


def feature_rows(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Fitted numbers, one row per feature, as a table."""
    return spark.createDataFrame(list(rows), columns)


def scale_with_fallback(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MAD scale, else population deviation, else one; one audit row per feature."""
    robust = fit_median_mad(df, columns)
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    rows = []
    for c, (center, mad) in robust.items():
        used = mad if mad > EPSILON else spread[c] if spread[c] > EPSILON else 1.0
        rows.append((c, center, mad, spread[c], used, int(mad <= EPSILON)))
    return feature_rows(df.sparkSession, rows, "feature string, center double, mad_scale double, "
                        "standard_deviation double, scale_used double, fallback_used int")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, value, _times): each value that is not null with the number of its rows."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))


def three_way_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest of MAD scale, IQR/1.349 and a magnitude floor per column; nulls are skipped."""
    return three_way_scale_of(value_counts(long_features(df, [], columns), ["feature"], "value"), ["feature"], "value").drop("n")


def three_way_scale_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same per key (keys, n, center, scale), by rank search over counted values: a key may hold any share of the rows."""
    return three_way_scale_of(value_counts(df, keys, value), keys, value)


def three_way_scale_of(held: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same from values that value_counts has counted; several passes read them, so stage them where rows are many."""
    keys = list(keys)
    middle = exact_quantiles(held, keys, value, {"_q1": 0.25, "center": 0.50, "_q3": 0.75}, "_times", "n")
    off = attach(held, middle.select(*keys, "center"), keys).withColumn("_off", F.abs(F.col(value) - F.col("center")))
    spread = exact_quantiles(off, keys, "_off", {"_mad": 0.5}, "_times")
    floor = F.greatest(F.lit(0.05), 1e-4 * F.greatest(F.abs(F.col("center")), F.lit(1.0)))
    return attach(middle, spread, keys).select(*keys, "n", "center", F.greatest(
        MAD_TO_SIGMA * F.col("_mad"), (F.col("_q3") - F.col("_q1")) / 1.349, floor).alias("scale"))


def scale_floors(healthy: DataFrame, absolute: Mapping[str, float], fraction: float = 0.25) -> dict[str, float]:
    """Floor per feature: a fraction of the global MAD scale, at least an absolute value."""
    robust = fit_median_mad(healthy, list(absolute))
    return {f: max(fraction * robust[f][1], least) if f in robust else least for f, least in absolute.items()}


def conformal_threshold(scores: DataFrame, keys: Sequence[str], score: str, alpha: float) -> DataFrame:
    """Split-conformal threshold: the score at rank min(n, ceil((n+1)(1-alpha)))."""
    found = values_at_ranks(scores, keys, score, lambda n: F.array(
        F.least(n, F.ceil((n + 1) * F.lit(1.0 - alpha))) - 1))
    return found.select(*keys, "n", (F.col("rank") + 1).alias("rank"), F.col(score).alias("threshold"))


def with_wilson(df: DataFrame, successes: str, total: str, prefix: str = "wilson") -> DataFrame:
    low, high = wilson_interval(F.col(successes), F.col(total))
    return df.withColumn(f"{prefix}_low", low).withColumn(f"{prefix}_high", high)


def run_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean, deviation (population unless `sample`), minimum, maximum and number of runs."""
    std = F.stddev_samp if sample else F.stddev_pop
    aggs = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), std(m).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return df.groupBy(*keys).agg(*aggs)


def macro_pooled_worst(groups: DataFrame, keys: Sequence[str], hits: str, total: str) -> DataFrame:
    """Mean of the group rates, rate of the pooled counts and the worst group rate."""
    rated = groups.withColumn("_rate", safe_divide(F.col(hits), F.col(total)))
    return rated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.avg("_rate").alias("macro_rate"),
        safe_divide(F.sum(hits), F.sum(total)).alias("pooled_rate"), F.max("_rate").alias("worst_rate"))


def descriptive(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, median and quartiles."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(F.count(value).alias("n_units"), F.avg(value).alias("mean"),
                                    F.stddev_samp(value).alias("standard_deviation"))
    quart = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quart, keys)


def phase_summary(rows: DataFrame, keys: Sequence[str], phase: str, order: str, truth: str,
                  rates: Mapping[str, Column], counts: Mapping[str, Column], means: Mapping[str, str] = {},
                  minima: Mapping[str, str] = {}, maxima: Mapping[str, str] = {}) -> DataFrame:
    """One row per phase in first-seen order with alarm rates, decision counts and trust extremes."""
    return rows.groupBy(*keys, phase).agg(
        F.min(order).alias("first_seen"), F.min_by(truth, order).alias("ground_truth_attack"),
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c.cast("int")).alias(n) for n, c in rates.items()],
        *[F.sum(c.cast("int")).alias(n) for n, c in counts.items()],
        *[F.avg(c).alias(n) for n, c in means.items()],
        *[F.min(c).alias(n) for n, c in minima.items()], *[F.max(c).alias(n) for n, c in maxima.items()])


def source_attribution(rows: DataFrame, keys: Sequence[str], names: Column, truth: str) -> DataFrame:
    """Active, attack and benign rows per named source."""
    return rows.select(*keys, truth, F.explode(names).alias("active_source")).groupBy(*keys, "active_source").agg(
        F.count(F.lit(1)).alias("active_rows"), F.sum(truth).alias("attack_rows"),
        F.sum(1 - F.col(truth)).alias("benign_rows"))


def share_within(df: DataFrame, keys: Sequence[str], value: str, count: str = "rows",
                 percentage: str = "percentage") -> DataFrame:
    """Count of each value and its percentage within the keys; counts first, so the window is small."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))
    return counted.withColumn(percentage, 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy(*keys)))


def density_recall(windows: DataFrame, attack_frames: str, alarm: str, score: str,
                   bins: Sequence[tuple[str, int, int]] = DENSITY_BINS) -> DataFrame:
    """Recall per band of attack frames; a bin without windows stays, with null recall."""
    label = None
    for name, low, high in bins:
        hit = F.col(attack_frames).between(low, high)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    found = (windows.withColumn("attack_frames_per_window", label)
             .where(F.col("attack_frames_per_window").isNotNull())
             .groupBy("attack_frames_per_window").agg(
                 F.count(F.lit(1)).alias("windows"), F.avg(alarm).alias("recall"), F.avg(score).alias("mean_score")))
    names = windows.sparkSession.createDataFrame([(n, i) for i, (n, _, _) in enumerate(bins)],
                                                 "attack_frames_per_window string, bin_order int")
    return names.join(found, "attack_frames_per_window", "left").withColumn(
        "windows", F.coalesce("windows", F.lit(0)))


def domain_shift(train: DataFrame, external: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature by feature: both distributions, standardized difference, share outside the training range."""
    def describe(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("feature").agg(
            F.avg("value").alias(f"{prefix}_mean"), F.stddev_pop("value").alias(f"{prefix}_std"),
            F.min("value").alias(f"{prefix}_min"), F.max("value").alias(f"{prefix}_max"))

    base = describe(long_features(train, [], features), "train")
    outer = long_features(external, [], features)
    outside = outer.join(base, "feature").groupBy("feature").agg(F.avg(
        ((F.col("value") < F.col("train_min")) | (F.col("value") > F.col("train_max"))).cast("int")
    ).alias("fraction_outside_train_range"))
    gap = (F.col("external_mean") - F.col("train_mean")) / F.when(F.col("train_std") > 0, F.col("train_std"))
    return base.join(describe(outer, "external"), "feature").join(outside, "feature").withColumn(
        "standardized_mean_difference", gap)


def feature_family(feature: Column) -> Column:
    structural = (feature.startswith("id_") | feature.startswith("frame_")
                  | feature.startswith("dominant_id_") | feature.startswith("consecutive_frame_"))
    return (
        F.when(structural, "identifier_and_frame_structure")
        .when(feature.endswith("_zero_fraction") | feature.endswith("_ff_fraction"), "payload_extremes")
        .when(feature.endswith("_mean_abs_change"), "payload_dynamics")
        .when(feature.startswith("data_"), "payload_statistics")
        .otherwise("other")
    )


def family_shift(shift: DataFrame) -> DataFrame:
    """Mean and largest absolute shift per feature family and the feature that moved most."""
    size = F.abs(F.col("standardized_mean_difference"))
    named = shift.withColumn("feature_family", feature_family(F.col("feature"))).withColumn("_size", size)
    return named.groupBy("feature_family").agg(
        F.count(F.lit(1)).alias("features"), F.avg("_size").alias("mean_absolute_shift"),
        F.max("_size").alias("max_absolute_shift"),
        F.max_by("feature", F.struct(F.coalesce("_size", F.lit(-1.0)), "feature")).alias("most_shifted_feature"),
        F.avg("fraction_outside_train_range").alias("mean_fraction_outside"))


def first_reaching(df: DataFrame, keys: Sequence[str], step: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Smallest step at which each condition holds, null when it never does."""
    return df.groupBy(*keys).agg(*[F.min(F.when(c, F.col(step))).alias(n) for n, c in conditions.items()])


def latency_summary(latencies: DataFrame, keys: Sequence[str], latency: str) -> DataFrame:
    """Attack runs, misses, detection rate and latency percentiles; a null latency is a miss."""
    keys = list(keys)
    base = latencies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attack_runs"), F.count(latency).alias("detected_runs"),
        F.sum(F.col(latency).isNull().cast("int")).alias("missed_runs"),
        F.avg(F.col(latency).isNotNull().cast("int")).alias("run_detection_rate"),
        F.avg(latency).alias("latency_mean"), F.max(latency).alias("latency_max"))
    quant = exact_quantiles(latencies.withColumn(latency, F.col(latency).cast("double")), keys, latency,
                            {"latency_median": 0.5, "latency_p95": 0.95})
    return base.join(quant, keys, "left")


def ecdf(reference: DataFrame, values: DataFrame, keys: Sequence[str], value: str, into: str = "ecdf") -> DataFrame:
    """Share of the reference at or below each distinct value; no per-row search.

    Both sides meet as weighted distinct values and one running sum answers all of them.
    """
    keys = list(keys)
    ref = reference.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"), F.lit(0).alias("_asked"))
    ask = values.select(*keys, value).distinct().select(*keys, value, F.lit(0).alias("_w"), F.lit(1).alias("_asked"))
    both = ref.unionByName(ask).groupBy(*keys, value).agg(F.sum("_w").alias("_w"), F.max("_asked").alias("_asked"))
    run = running_totals(value_buckets(both, keys, value), keys, value, "_bucket", {"_upto": "_w"})
    size = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return attach(run.where(F.col("_asked") == 1), size, keys).select(
        *keys, value, (F.col("_upto") / F.greatest(F.col("_n"), F.lit(1))).alias(into))


def tail_parameters(reference: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Centre and scale of the log1p reference for the robust tail score, per column."""
    logged = reference.select(*[F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in columns])
    robust = fit_median_mad(logged, columns)
    upper = fit_quantiles(logged, columns, {"q": 0.95})
    return {c: (m, max(upper[c]["q"] - m, mad, 1e-6)) for c, (m, mad) in robust.items()}


def tail_score(value: Column, center: Column | float, scale: Column | float) -> Column:
    return (F.log1p(F.greatest(value, F.lit(0.0))) - center) / scale


def risk_columns(df: DataFrame, evidence: Sequence[str], prefix: str = "risk") -> DataFrame:
    """Order statistics across the evidence of a row: any, consensus and context."""
    ordered = F.sort_array(F.array(*evidence), asc=False)
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    return (df.withColumn(f"{prefix}_any", first).withColumn(f"{prefix}_consensus", second)
            .withColumn(f"{prefix}_context", (first + second) / 2.0))
