"""Supervised detectors on Spark ML: fit on train, choose the threshold on validation, test once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from busward.operators import linear_fits
from busward.operators.metrics import best_f1_threshold, confusion, curve, roc_auc, with_rates
from busward.operators.stats import feature_family

FAMILIES = ("identifier_and_frame_structure", "payload_extremes", "payload_dynamics", "payload_statistics")


def balanced_weights(df: DataFrame, label: str = "binary_target") -> DataFrame:
    """Weight n / (2 n_c) for each row of class c."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(0.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (2.0 * n)).otherwise(weight)
    return df.withColumn("_weight", weight)


def _assembled(features: Sequence[str], estimator, scale: bool) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def logistic(features: Sequence[str], rows: int, label: str = "binary_target", c: float = 1.0, iterations: int = 3000) -> Pipeline:
    """Balanced L2 logistic regression. The penalty 1/(C n) equals C on the summed weighted loss."""
    return _assembled(features, LogisticRegression(
        featuresCol="_features", labelCol=label, weightCol="_weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y",
        regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations), True)


def forest(features: Sequence[str], rows: int, label: str = "binary_target", trees: int = 400, seed: int = 42) -> Pipeline:
    return _assembled(features, RandomForestClassifier(
        featuresCol="_raw", labelCol=label, weightCol="_weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y",
        numTrees=trees, minInstancesPerNode=2, maxDepth=12, seed=seed), False)


def boosted(features: Sequence[str], rows: int, label: str = "binary_target", trees: int = 400, seed: int = 42) -> Pipeline:
    return _assembled(features, GBTClassifier(
        featuresCol="_raw", labelCol=label, weightCol="_weight", predictionCol="_y", maxIter=trees, maxDepth=6, stepSize=0.05,
        subsamplingRate=0.85, seed=seed), False)


def fit(train: DataFrame, features: Sequence[str], builder: Callable[..., Pipeline], label: str = "binary_target", **options) -> PipelineModel:
    weighted = balanced_weights(train.select(*features, label), label).withColumn(label, F.col(label).cast("double"))
    return builder(features, train.count(), label=label, **options).fit(weighted)


def score(model: PipelineModel, df: DataFrame, into: str = "attack_probability") -> DataFrame:
    """Attack probability of each row; Spark ML scores inside the tasks."""
    out = model.transform(df.drop(into, "_weight"))
    column = "_p" if "_p" in out.columns else "probability"
    drop = [c for c in ("_raw", "_features", "_p", "_r", "_y", "probability", "rawPrediction") if c in out.columns]
    return out.withColumn(into, vector_to_array(F.col(column))[1]).drop(*drop)


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class, the smaller name on a tie."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.col("rows").desc(), label).limit(1)


def validated_threshold(scored: DataFrame, truth: str = "binary_target", highest: bool = False) -> float:
    points = curve(scored.withColumn("_all", F.lit("all")), ["_all"], truth, "attack_probability")
    return best_f1_threshold(points, ["_all"], highest).first()["threshold"]


def train_validate_test(df: DataFrame, features: Sequence[str], builder: Callable[..., Pipeline], name: str, truth: str = "binary_target",
                        threshold: float | None = None, **options) -> DataFrame:
    """One row of test metrics of a model whose threshold came from the validation rows."""
    train, valid, test = (df.where(F.col("split") == s) for s in ("train", "validation", "test"))
    model = fit(train, features, builder, truth, **options)
    limit = validated_threshold(score(model, valid), truth) if threshold is None else threshold
    judged = score(model, test).withColumn("_alarm", (F.col("attack_probability") >= limit).cast("int"))
    counts = with_rates(confusion(judged, [], truth, {name: "_alarm"}))
    auc = roc_auc(judged.withColumn("_all", F.lit(name)), ["_all"], truth, "attack_probability").select(
        F.col("_all").alias("method"), "roc_auc")
    return counts.join(auc, "method").withColumn("threshold", F.lit(float(limit)))


def feature_sets(df: DataFrame, features: Sequence[str]) -> dict[str, list[str]]:
    """All features, each family alone, and all without each family: nine sets."""
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string").select(
        "feature", feature_family(F.col("feature")).alias("family")).collect()
    family = {r["feature"]: r["family"] for r in named}
    sets = {"all_features": list(features)}
    for f in FAMILIES:
        sets[f"only_{f}"] = [x for x in features if family[x] == f]
    for f in FAMILIES:
        sets[f"without_{f}"] = [x for x in features if family[x] != f]
    return sets


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ablation(df: DataFrame, external: DataFrame, features: Sequence[str], source: str, truth: str = "binary_target") -> DataFrame:
    """Every feature set, fitted together: threshold of the validation rows, F1 and AUC on test and external rows, the gap
    between them, and the macro and worst AUC of the external sources that hold both classes."""
    sets = feature_sets(df, features)
    fits = [linear_fits.Fit(n, f, F.col("split") == "train", F.col(truth)) for n, f in sets.items()]
    found = linear_fits.fit_all(df, fits)
    inner = linear_fits.scored_long(df.where(F.col("split") != "train"), found, ["split", truth])
    limits = linear_fits.thresholds(inner.where(F.col("split") == "validation"), truth)
    outer = linear_fits.scored_long(external, found, [source, truth])
    test = linear_fits.judged(inner.where(F.col("split") == "test"), limits, truth)
    whole = linear_fits.judged(outer, limits, truth)
    per_source = roc_auc(outer, ["fit", source], truth, "attack_probability").groupBy("fit").agg(
        F.avg("roc_auc").alias("source_auc_macro"), F.min("roc_auc").alias("source_auc_worst"))
    sizes = df.sparkSession.createDataFrame([(n, len(f)) for n, f in sets.items()], "fit string, features int")
    return (sizes.join(test.select("fit", "threshold", F.col("f1").alias("in_domain_f1"), F.col("roc_auc").alias("in_domain_auc")), "fit")
            .join(whole.select("fit", F.col("f1").alias("external_f1"), F.col("roc_auc").alias("external_auc")), "fit")
            .join(per_source, "fit", "left").withColumn("gap", F.col("in_domain_auc") - F.col("external_auc"))
            .withColumnRenamed("fit", "feature_set"))


def unseen_classes(df: DataFrame, classes: Sequence[str], label: str, benign: str, features: Sequence[str], truth: str = "binary_target") -> DataFrame:
    """Per held-out class, all fitted together: tuned and fixed thresholds on benign test rows and those of the class."""
    fits = [linear_fits.Fit(held, features, (F.col("split") == "train") & (F.col(label) != held), F.col(truth)) for held in classes]
    found = linear_fits.fit_all(df, fits)
    rest = linear_fits.scored_long(df.where(F.col("split") != "train"), found, ["split", label, truth])
    tuned = linear_fits.thresholds(rest.where((F.col("split") == "validation") & (F.col(label) != F.col("fit"))), truth)
    unseen = rest.where((F.col("split") == "test") & ((F.col(label) == benign) | (F.col(label) == F.col("fit"))))
    both = [linear_fits.judged(unseen, limits, truth).withColumn("method", F.concat("fit", F.lit(f":{kind}")))
            for kind, limits in (("tuned", tuned), ("fixed", tuned.withColumn("threshold", F.lit(0.5))))]
    return union_all(both).drop("fit")


def leave_one_attack_out(df: DataFrame, classes: Sequence[str], label: str, benign: str, features: Sequence[str],
                         builder: Callable[..., Pipeline], truth: str = "binary_target", **options) -> DataFrame:
    """Per held-out class: tuned and fixed thresholds on benign rows plus the unseen class."""
    rows = []
    for held in classes:
        seen = df.where((F.col("split") == "test") & F.col(label).isin(benign, held) | (F.col("split") != "test") & (F.col(label) != held))
        for kind, limit in (("tuned", None), ("fixed", 0.5)):
            rows.append(train_validate_test(seen, features, builder, f"{held}:{kind}", truth, limit, **options))
    return union_all(rows)


def with_shuffled_labels(train: DataFrame, key: Sequence[str], seeds: Sequence[int], truth: str = "binary_target") -> DataFrame:
    """The rows with their labels permuted by each seed, as columns _label_<seed>."""
    from busward.operators.splits import shuffled_labels

    out = train
    for seed in seeds:
        mixed = shuffled_labels(train.select(*key, truth), key, truth, seed, f"_label_{seed}").select(*key, f"_label_{seed}")
        out = out.join(mixed, list(key))
    return out


def shuffled_label_sanity(train: DataFrame, rest: DataFrame, features: Sequence[str], seeds: Sequence[int], truth: str = "binary_target") -> DataFrame:
    """Metrics of fits on permuted labels, all seeds fitted together; they should be near chance. train is a table with the
    columns of with_shuffled_labels, rest holds the validation and test rows."""
    fits = [linear_fits.Fit(f"seed_{seed}", features, F.lit(True), F.col(f"_label_{seed}")) for seed in seeds]
    found = linear_fits.fit_all(train, fits)
    scored = linear_fits.scored_long(rest, found, ["split", truth])
    limits = linear_fits.thresholds(scored.where(F.col("split") == "validation"), truth)
    return linear_fits.judged(scored.where(F.col("split") == "test"), limits, truth).withColumnRenamed("fit", "method")
