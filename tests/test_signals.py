"""Signal profiles from all rows against NumPy, bottom-k samples and counted quantiles against full sorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from busward.functions.columns import digest_number
from busward.operators import ordering, signals, splits
from busward.operators.stats import three_way_scale_by

NAMES = ("s1", "s2", "s3")


def signal_rows(n=900, seed=5):
    dice = np.random.default_rng(seed)
    common = dice.normal(size=n)
    rows = []
    for i in range(n):
        can_id = int(i % 3) if i % 7 else 9  # one hot ID and one with a single active signal
        a, b, c = 5 * common[i] + dice.normal(), -2 * common[i] + 3 * dice.normal(), float(dice.integers(0, 4))
        rows.append((f"c{i % 2}", i, can_id, float(a), None if can_id == 9 or i % 11 == 0 else float(b), None if can_id == 9 else c))
    return rows


def ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(axis=0)
    cov = x.T @ x / n
    target = np.trace(cov) / p * np.eye(p)
    noise = np.mean([((np.outer(r, r) - cov) ** 2).sum() for r in x]) / n
    distance = ((cov - target) ** 2).sum()
    weight = min(noise, distance) / distance
    return weight, np.linalg.inv((1 - weight) * cov + weight * target)


@pytest.fixture(scope="module")
def profiled(spark):
    rows = spark.createDataFrame(signal_rows(), "capture string, seq long, can_id int, s1 double, s2 double, s3 double").repartition(5)
    deltas = signals.with_deltas(rows, NAMES)
    return rows, signals.profile_table(deltas, deltas, NAMES, 50, 20)


def test_profile_and_precision_equal_numpy(profiled):
    rows, profile = profiled
    centers = {r["can_id"]: r for r in profile.collect()}
    fitted = {r["can_id"]: r for r in signals.precision_matrices(rows, profile, NAMES).collect()}
    assert set(fitted) == {0, 1, 2, 9}
    for can_id, row in fitted.items():
        own = np.array([[np.nan if v is None else v for v in r[3:]] for r in signal_rows() if r[2] == can_id])
        active = [i for i in range(3) if np.isfinite(own[:, i]).sum() >= 50]
        assert row["active"] == active and row["rows"] == len(own)
        center = np.nanmedian(own, axis=0)
        iqr = (np.nanpercentile(own, 75, axis=0) - np.nanpercentile(own, 25, axis=0)) / 1.349
        scale = np.maximum.reduce([1.4826 * np.nanmedian(np.abs(own - center), axis=0), iqr, np.maximum(0.05, 1e-4 * np.maximum(np.abs(center), 1))])
        for i in active:
            assert centers[can_id][f"v_center_s{i + 1}"] == pytest.approx(center[i], abs=1e-12)
            assert centers[can_id][f"v_scale_s{i + 1}"] == pytest.approx(scale[i], rel=1e-12)
        if len(active) == 1:
            assert row["precision"] == [[1.0]] and row["shrinkage"] == 0
            continue
        z = np.nan_to_num(((own - center) / scale)[:, active])
        weight, precision = ledoit_wolf(z)
        assert row["shrinkage"] == pytest.approx(weight, rel=1e-9)
        np.testing.assert_allclose(np.array(row["precision"]), precision, rtol=1e-9, atol=1e-12)


def test_novel_rows_have_the_unknown_score(spark, profiled):
    rows, profile = profiled
    odd = spark.createDataFrame([("x", 0, 77, 1.0, 1.0, 1.0), ("x", 1, 9, 1.0, 1.0, None), ("x", 2, 1, None, None, None), ("x", 3, 1, 0.0, 0.0, 1.0)], rows.schema)
    scored = signals.row_scores(signals.with_deltas(odd, NAMES), profile, NAMES)
    got = {r["seq"]: r for r in signals.context_score(scored, profile, signals.precision_matrices(rows, profile, NAMES), NAMES).collect()}
    assert [got[i]["unknown_signal"] for i in range(4)] == [1, 1, 1, 0]
    assert all(got[i][c] >= 50 for i in range(3) for c in ("marginal_score", "transition_score", "context_score")) and got[3]["context_score"] < 50


def test_covariances_are_added_up_before_the_shuffle(profiled):
    rows, profile = profiled
    plan = signals.shrunk_covariances(rows, profile, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("capacity", [1, 7, 200, 5000])
def test_reservoir_equals_a_full_sort(spark, capacity):
    rows = spark.range(6000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id", F.lit(1).alias("_n"))
    got = {(r["key"], r["id"]) for r in splits.reservoir(rows, ["key"], ["id"], capacity, 3).collect()}
    ordered = rows.withColumn("d", digest_number(3, F.col("id").cast("string"))).collect()
    want = set()
    for key in {r["key"] for r in ordered}:
        own = sorted((r["d"], r["id"]) for r in ordered if r["key"] == key)
        want |= {(key, i) for _, i in own[:capacity]}
    assert got == want


def test_quantiles_of_counted_values(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_VALUES", 8)
    dice = np.random.default_rng(2)
    values = [(int(k), float(v)) for k in (1, 2) for v in np.round(dice.normal(size=150 * k), 1)] + [(3, None), (1, None)]
    rows = spark.createDataFrame(values, "_all int, v double")
    counted = rows.groupBy("_all", "v").agg(F.count("*").alias("times"))
    for df, times in ((rows, None), (counted, "times")):
        got = {r["_all"]: r for r in ordering.exact_quantiles(df, ["_all"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}, times, "n").collect()}
        for k in (1, 2):
            own = [v for i, v in values if i == k and v is not None]
            assert got[k]["n"] == len(own) and [got[k][c] for c in "abc"] == pytest.approx(np.quantile(own, [0.1, 0.5, 1.0]).tolist())
    scales = {r["_all"]: r for r in three_way_scale_by(rows, ["_all"], "v").collect()}
    assert set(scales) == {1, 2} and scales[2]["center"] == pytest.approx(np.median([v for i, v in values if i == 2]))
    whole = ordering.exact_quantiles(rows, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for _, v in values if v is not None]))


def test_keys_of_any_name(spark, monkeypatch):
    """A caller's key may have a name that was once used inside."""
    monkeypatch.setattr(ordering, "BUCKET_VALUES", 4)
    rows = spark.createDataFrame([(k, float(i % 9)) for k in ("x", "y") for i in range(40)], "_all string, value double")
    cut = ordering.value_buckets(rows, ["_all"], "value", bucket_values=4)
    totals = ordering.running_totals(cut.withColumn("one", F.lit(1)), ["_all"], "value", "_bucket", {"upto": "one"})
    assert totals.groupBy("_all").agg(F.max("upto").alias("n")).collect()[0]["n"] == 40


def test_previous_values_cross_chunks_and_one_shuffle_carries_the_rows(spark, monkeypatch):
    dice = np.random.default_rng(3)
    rows = [("c", i, int(dice.integers(0, 3)), float(i) if i % 4 else None) for i in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "capture string, seq long, can_id int, s double").repartition(3)
    monkeypatch.setattr(signals, "CHUNK_ROWS", 16)
    out = signals.with_previous(df, ["s"], "p_", count=len(rows))
    last, want = {}, {}
    for _, seq, can_id, s in rows:
        want[seq], last[can_id] = last.get(can_id), s
    assert {r["seq"]: r["p_s"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Generate" not in plan


def test_counted_values_are_staged_and_not_counted_again(profiled):
    rows, profile = profiled
    names = []
    deltas = signals.with_deltas(rows, NAMES)
    table = signals.profile_table(deltas, deltas, NAMES, 50, 20, lambda name, df: (names.append(name), df.localCheckpoint())[1])
    assert names == ["values", "deltas"]
    assert sorted(map(repr, table.collect())) == sorted(map(repr, profile.collect()))


def test_counted_rows_are_ranked_without_another_count(spark):
    counted = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("a", 5.0, 3), ("b", None, 4), ("b", 2.0, 1)], "k string, v double, n long")
    found = ordering.exact_quantiles(counted, ["k"], "v", {"m": 0.5}, "n", "rows")
    assert {r["k"]: (r["rows"], r["m"]) for r in found.collect()} == {"a": (6, 3.0), "b": (1, 2.0)}
    ranked = ordering.values_at_ranks(counted, ["k"], "v", lambda n: F.array(n - 1), "n")
    assert "sum(n" not in ranked._jdf.queryExecution().optimizedPlan().toString()
