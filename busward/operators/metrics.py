"""Detection metrics and threshold selection. Scores are counted per distinct value before any sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.functions.columns import safe_divide
from busward.operators.ordering import attach, running_totals, value_buckets, values_at_ranks

RATES = ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "accuracy")


def confusion(df: DataFrame, keys: Sequence[str], truth: str, methods: Mapping[str, str]) -> DataFrame:
    """tp, fp, tn, fn per key and method. All methods are counted in one aggregation."""
    positive = F.col(truth) == 1
    aggs = []
    for i, column in enumerate(methods.values()):
        alarm = F.col(column) == 1
        aggs += [F.sum((positive & alarm).cast("int")).alias(f"tp{i}"),
                 F.sum((~positive & alarm).cast("int")).alias(f"fp{i}"),
                 F.sum((~positive & ~alarm).cast("int")).alias(f"tn{i}"),
                 F.sum((positive & ~alarm).cast("int")).alias(f"fn{i}")]
    counted = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("method"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")])
        for i, name in enumerate(methods)]))
    return counted.select(*keys, rows.alias("_m")).select(*keys, "_m.*")


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts, zero on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return (counts.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", safe_divide(2.0 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall")))
            .withColumn("false_positive_rate", safe_divide(fp, fp + tn))
            .withColumn("false_negative_rate", safe_divide(fn, fn + tp))
            .withColumn("accuracy", safe_divide(tp + tn, tp + fp + tn + fn)))


def with_balanced(counts: DataFrame) -> DataFrame:
    """Balanced accuracy and MCC; null where the scope has only one class."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    product = F.sqrt((tp + fp)) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return (counts.withColumn("balanced_accuracy", F.when(both, (tp / (tp + fn) + tn / (tn + fp)) / 2.0))
            .withColumn("mcc", F.when(both, F.when(product > 0, (tp * tn - fp * fn) / product).otherwise(0.0))))


def score_counts(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with order-preserving buckets."""
    counted = df.groupBy(*keys, score).agg(
        F.sum(truth).alias("positives"), F.sum(1 - F.col(truth)).alias("negatives"))
    return value_buckets(counted, keys, score)


def roc_auc(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half (Mann-Whitney); null for one class."""
    run = running_totals(score_counts(df, keys, truth, score), keys, score, "_bucket", {"_below": "negatives"})
    pairs = F.sum(F.col("positives").cast("double") * (F.col("_below") - F.col("negatives") / 2.0))
    p, n = F.sum("positives"), F.sum("negatives")
    return run.groupBy(*keys).agg(
        p.alias("positives"), n.alias("negatives"),
        F.when((p > 0) & (n > 0), pairs / (p.cast("double") * n)).alias("roc_auc"))


def curve(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """ROC and precision-recall points: counts at or above every distinct score."""
    keys = list(keys)
    counted = score_counts(df, keys, truth, score)
    run = running_totals(counted, keys, score, "_bucket", {"tp": "positives", "fp": "negatives"}, descending=True)
    total = counted.groupBy(*keys).agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    out = attach(run, total, keys)
    return (out.withColumn("tpr", safe_divide(F.col("tp"), F.col("_p")))
            .withColumn("fpr", safe_divide(F.col("fp"), F.col("_n")))
            .withColumn("precision", safe_divide(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("f1", safe_divide(2.0 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")))
            .withColumnRenamed(score, "threshold"))


def average_precision(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision from curve points; null without positives."""
    return points.groupBy(*keys).agg(
        F.when(F.max("_p") > 0, F.sum(F.col("positives") / F.when(F.col("_p") > 0, F.col("_p")) * F.col("precision")))
        .alias("pr_auc"))


def best_f1_threshold(points: DataFrame, keys: Sequence[str], highest: bool) -> DataFrame:
    """Threshold of the largest F1; among equals (to 1e-12) the highest or the lowest one."""
    best = points.groupBy(*keys).agg(F.max("f1").alias("best_f1"))
    pick = F.max if highest else F.min
    return attach(points, best, keys).where(F.col("f1") >= F.col("best_f1") - 1e-12).groupBy(*keys).agg(
        pick("threshold").alias("threshold"), F.first("best_f1").alias("best_f1"))


def fpr_limited_threshold(points: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Highest recall with FPR within the limit, ties to the larger threshold."""
    allowed = points.where(F.col("fpr") <= limit)
    best = allowed.groupBy(*keys).agg(F.max("tpr").alias("best_recall"))
    return attach(allowed, best, keys).where(F.col("tpr") >= F.col("best_recall") - 1e-12).groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.first("best_recall").alias("best_recall"))


def grid_operating_points(df: DataFrame, captures: str, score: str, low: float = 0.5, high: float = 1.000001,
                          points: int = 2001) -> DataFrame:
    """Pooled, macro and worst capture alarm rate at every point of an even threshold grid.

    A window alarms at all grid points up to its score, so each capture needs only a histogram over
    the grid; the reverse running sum is over at most `points` rows per capture.
    """
    step = (high - low) / (points - 1)

    def at(i: Column) -> Column:
        return F.when(i == points - 1, F.lit(high)).otherwise(F.lit(low) + i * F.lit(step))

    guess = F.floor((F.col(score) - low) / step)
    guess = F.greatest(F.lit(-1), F.least(F.lit(points - 1), guess))
    cell = (df.withColumn("_g", guess.cast("bigint"))
            .withColumn("_g", F.when((F.col("_g") < points - 1) & (F.col(score) >= at(F.col("_g") + 1)), F.col("_g") + 1)
                        .when((F.col("_g") >= 0) & (F.col(score) < at(F.col("_g"))), F.col("_g") - 1)
                        .otherwise(F.col("_g"))))
    return threshold_sweep(cell.select(captures, F.col("_g").alias("cell")), captures, points).withColumn(
        "threshold", at(F.col("cell")))


def threshold_sweep(cells: DataFrame, captures: str, points: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled, macro and worst capture alarm rate at the thresholds 0 to points - 1 of an ascending axis.

    `cell` is the highest threshold at which a row alarms, -1 for none. A capture's rate changes only at cells
    that it occupies, and grows towards the lower ones. So a running sum over its occupied cells gives its
    rate there; the sums of rows and of shares of rows over all captures are difference arrays of the pooled
    and the macro rate; the worst rate is a running maximum. The axis has a row a threshold (and key), not a
    row a capture and threshold.
    """
    filled = cells.groupBy(*keys, captures, "cell").agg(F.count(F.lit(1)).alias("_w"))
    own = Window.partitionBy(*keys, captures)
    up = own.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = filled.withColumn("_n", F.sum("_w").over(own)).withColumns({
        "_at": F.sum("_w").over(up), "_share": F.col("_w") / F.col("_n")})
    # The lowest occupied cell of a capture is the one at which all its rows are summed: it counts the capture.
    steps = rated.groupBy(*keys, "cell").agg(
        F.sum("_w").alias("_w"), F.sum("_share").alias("_share"), F.max(F.col("_at") / F.col("_n")).alias("_worst"),
        F.count(F.when(F.col("_at") == F.col("_n"), 1)).alias("_captures"))
    whole = steps.groupBy(*keys).agg(F.sum("_w").alias("windows"), F.sum("_captures").alias("_all")).where(F.col("_all") > 0)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i.cast("bigint"))).alias("cell")
    axis = whole.select(*keys, "windows", "_all", grid)
    down = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return axis.join(steps.drop("_captures"), [*keys, "cell"], "left").select(
        *keys, "cell", (F.coalesce(F.sum("_w").over(down), F.lit(0)) / F.col("windows")).alias("pooled_fpr"),
        (F.coalesce(F.sum("_share").over(down), F.lit(0.0)) / F.col("_all")).alias("macro_fpr"),
        F.coalesce(F.max("_worst").over(down), F.lit(0.0)).alias("worst_fpr"), "windows")


def first_allowed(points: DataFrame, pooled: float = 0.05, macro: float = 0.05, worst: float = 0.10) -> DataFrame:
    """Smallest threshold within all three limits."""
    ok = (F.col("pooled_fpr") <= pooled) & (F.col("macro_fpr") <= macro) & (F.col("worst_fpr") <= worst)
    best = F.min(F.when(ok, F.struct("threshold", "pooled_fpr", "macro_fpr", "worst_fpr", "windows")))
    return points.agg(best.alias("_b")).select("_b.*")


def quantile_candidates(df: DataFrame, score: str, points: int = 2001) -> DataFrame:
    """Distinct exact pooled quantiles at an even grid of probabilities, as candidate thresholds."""
    def place(n: Column, i: Column) -> Column:
        return (n - 1) * (i / F.lit(points - 1))

    grid = F.sequence(F.lit(0), F.lit(points - 1))
    found = values_at_ranks(df, [], score, lambda n: F.concat(
        F.transform(grid, lambda i: F.floor(place(n, i)).cast("bigint")),
        F.transform(grid, lambda i: F.ceil(place(n, i)).cast("bigint"))))
    at = found.agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", score))).alias("at"))
    spot = at.select("n", "at", F.explode(grid).alias("i")).withColumn("p", place(F.col("n"), F.col("i")))
    low, high = F.col("at")[F.floor("p").cast("bigint")], F.col("at")[F.ceil("p").cast("bigint")]
    return spot.select((low + (high - low) * (F.col("p") - F.floor("p"))).alias("threshold")).distinct()


def candidate_operating_points(df: DataFrame, captures: str, score: str, candidates: DataFrame,
                               most: int = 2001) -> DataFrame:
    """Alarm rates at up to `most` candidate thresholds (columns threshold, strict).

    `strict` = 1 means an alarm needs a score above the threshold, the limit of the next larger double. The
    sorted candidates are one small array; a distinct score finds its place in it by binary search, and a
    sweep over these places gives the rates.
    """
    axis = candidates.where(F.col("threshold").isNotNull()).agg(F.array_sort(F.collect_set("threshold")).alias("axis"))
    bits = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def below(x: Column, strict: int) -> Column:
        """Number of candidates that x reaches (strict: that x is above)."""
        def step(low: Column, jump: Column) -> Column:
            spot = F.get("axis", low + jump - 1)
            return F.when(F.coalesce(spot < x if strict else spot <= x, F.lit(False)), low + jump).otherwise(low)
        return F.aggregate(bits, F.lit(0), step)

    held = df.withColumn("axis", axis.scalar())
    places = held.select(captures, F.explode(F.array(*[F.struct(
        F.lit(s).alias("strict"), (below(F.col(score), s) - 1).cast("bigint").alias("cell")) for s in (0, 1)])).alias("_p"))
    swept = threshold_sweep(places.select(captures, "_p.*"), captures, most, ["strict"])
    value = F.get("axis", F.col("cell").cast("int"))
    return swept.withColumn("axis", axis.scalar()).where(F.col("cell") < F.size("axis")).withColumn("threshold", value).drop("axis", "cell")


def scoped_metrics(df: DataFrame, scopes: Sequence[str], truth: str, methods: Mapping[str, str]) -> DataFrame:
    """Metric table for the whole and for each value of each scope column, in one grouping-sets pass."""
    sets = [F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("scope_value"))] + [
        F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("scope_value")) for s in scopes]
    fine = df.groupBy(*scopes).agg(*[
        F.sum((F.col(truth).eqNullSafe(t) & F.col(c).eqNullSafe(a)).cast("int")).alias(f"{n}{i}")
        for i, c in enumerate(methods.values())
        for n, t, a in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    spread = fine.withColumn("_s", F.explode(F.array(*sets))).groupBy("_s.scope", "_s.scope_value").agg(*[
        F.sum(f"{n}{i}").alias(f"{n}{i}") for i in range(len(methods)) for n in ("tp", "fp", "tn", "fn")])
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("method"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")])
        for i, name in enumerate(methods)]))
    return with_rates(spread.select("scope", "scope_value", rows.alias("_m")).select("scope", "scope_value", "_m.*"))


def cluster_macro(df: DataFrame, keys: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean over clusters of the cluster mean."""
    inner = df.groupBy(*keys, cluster).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.avg("_m").alias("cluster_macro_rate"))
