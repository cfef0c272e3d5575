"""Queries that fit models on window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.registry import query
from busward.functions.columns import logistic as linear_model
from busward.operators import models, splits, windows
from busward.plans import can_gate
from busward.plans.adapters import HEALTHY

S = windows.STRUCTURAL
ALL = (*windows.STRUCTURAL, *windows.PAYLOAD)
# The captures of the domain that is fitted, and the seeds of the label shuffles.
INNER = ("A_F", "R_F", HEALTHY)
SEEDS = (1, 2, 3, 4, 5)
RESULT = "method tp:i fp:i tn:i fn:i precision:d recall:d f1:d roc_auc:d threshold:d"


def training(t):
    """Windows split by a hash of their name, so that every split holds both classes."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "capture", F.col("window_index").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return t.staged("model_windows", lambda: can_gate.parent_windows(t).withColumn("split", splits.hash_split(digest)))


@query("l1_logistic_regression", RESULT, None)
def l1(t):
    return models.train_validate_test(training(t), S, models.logistic, "logistic")


@query("l2_random_forest", RESULT, None)
def l2(t):
    return models.train_validate_test(training(t), S, models.forest, "forest")


@query("l3_boosted_trees", RESULT, None)
def l3(t):
    return models.train_validate_test(training(t), S, models.boosted, "boosted", trees=10)


@query("l4_majority_class", "density_band rows:i", "SELECT density_band, count(*) AS rows FROM w100 GROUP BY 1 ORDER BY rows DESC, density_band LIMIT 1")
def l4(t):
    return models.majority(can_gate.parent_windows(t), "density_band")


@query("l5_linear_scoring", "capture window_index:i attack_probability:d alarm:i",
       "SELECT capture, window_index, attack_probability, CASE WHEN attack_probability >= 0.5e0 THEN 1 ELSE 0 END AS alarm FROM p100")
def l5(t):
    p = linear_model([F.col(f) for f in S], can_gate.WEIGHTS, can_gate.INTERCEPT)
    return can_gate.parent_windows(t).withColumn("attack_probability", p).withColumn("alarm", (F.col("attack_probability") >= 0.5).cast("int"))


@query("l6_train_validate_test", RESULT, None)
def l6(t):
    return models.train_validate_test(training(t), ALL, models.logistic, "logistic_63")


@query("l7_family_ablation", "feature_set features:i threshold:d in_domain_f1:d in_domain_auc:d external_f1:d external_auc:d gap:d source_auc_macro:d source_auc_worst:d", None)
def l7(t):
    rows = training(t)
    return models.ablation(rows.where(F.col("capture").isin(*INNER)), rows.where(~F.col("capture").isin(*INNER)), ALL, "capture")


@query("l8_leave_one_attack_out", RESULT, None)
def l8(t):
    rows = training(t)
    classes = [r["capture"] for r in rows.select("capture").distinct().sort("capture").collect() if r["capture"] != HEALTHY]
    return models.unseen_classes(rows, classes, "capture", HEALTHY, S)


@query("l9_shuffled_labels", RESULT, None)
def l9(t):
    rows = training(t)
    train = t.staged("shuffled_labels", lambda: models.with_shuffled_labels(rows.where(F.col("split") == "train"), ["capture", "window_index"], SEEDS))
    return models.shuffled_label_sanity(train, rows.where(F.col("split") != "train"), S, SEEDS)
