"""The bucketed and chunked paths must equal plain definitions, also when one key has most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from busward.functions.columns import digest_number, row_quantile, wilson_interval
from busward.operators import inference, metrics, ordering, splits, state, stats
from busward.plans import replay


def skewed(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", i, rng.random() * 10) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, at bigint, value double")


def test_number_rows_over_many_buckets(spark):
    rows, df = skewed(spark)
    out = ordering.number_rows(df, ["key"], ["at"], F.floor(F.col("at") / 37)).collect()
    want = {}
    for key, at, _ in sorted(rows):
        want[(key, at)] = sum(1 for k, a, _ in rows if k == key and a < at) if at < 0 else None
    seen = {}
    for key, at, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        seen[(key, at)] = seen.setdefault(("n", key), 0)
        seen[("n", key)] += 1
    assert {(r["key"], r["at"]): r["seq"] for r in out} == {k: v for k, v in seen.items() if k[0] != "n"}


@pytest.mark.parametrize("values_of_a_bucket", [1, 9, 4096])
def test_exact_quantiles_equal_numpy(spark, values_of_a_bucket, monkeypatch):
    rows, df = skewed(spark)
    monkeypatch.setattr(ordering.value_buckets, "__defaults__", ("_bucket", values_of_a_bucket))
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    out = {r["key"]: r for r in ordering.exact_quantiles(df, ["key"], "value", probs).collect()}
    for key in {r[0] for r in rows}:
        values = [v for k, _, v in rows if k == key]
        for name, p in probs.items():
            assert out[key][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_running_totals_and_last_known_cross_buckets(spark):
    rows, df = skewed(spark)
    numbered = ordering.number_rows(df, ["key"], ["at"], F.floor(F.col("at") / 100))
    marked = numbered.withColumn("w", (F.col("at") % 5).cast("bigint")).withColumn("_bucket", F.floor(F.col("seq") / 16))
    totals = ordering.running_totals(marked, ["key"], "seq", "_bucket", {"sum": "w"}).collect()
    by_key = {}
    for r in sorted(totals, key=lambda r: (r["key"], r["seq"])):
        by_key[r["key"]] = by_key.get(r["key"], 0) + r["at"] % 5
        assert r["sum"] == by_key[r["key"]]
    known = ordering.last_known(marked.drop("_bucket"), ["key"], "seq", {"kept": F.when(F.col("at") % 97 == 0, F.col("at"))}, 16).collect()
    latest = {}
    for r in sorted(known, key=lambda r: (r["key"], r["seq"])):
        if r["at"] % 97 == 0:
            latest[r["key"]] = r["at"]
        assert r["kept"] == latest.get(r["key"])


def bits(spark, runs=6, n=90, seed=3):
    rng = random.Random(seed)
    rows = [(r, i, int(rng.random() < 0.45), rng.random()) for r in range(runs) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run int, seq bigint, alarm int, score double")


@pytest.mark.parametrize("chunk", [8, 65_536])
def test_hysteresis_equals_the_loop(spark, chunk):
    rows, df = bits(spark)
    out = {(r["run"], r["seq"]): r["on"] for r in state.hysteresis(
        df, ["run"], "seq", {"on": (F.col("alarm") == 1, 2, 3)}, chunk).collect()}
    for run in range(6):
        bad = good = active = 0
        for r, i, alarm, _ in rows:
            if r != run:
                continue
            if alarm:
                bad, good = bad + 1, 0
                active = 1 if bad >= 2 else active
            else:
                bad = 0
                good = good + 1 if active else 0
                if active and good >= 3:
                    active = good = 0
            assert out[(run, i)] == active


@pytest.mark.parametrize("chunk", [8, 65_536])
def test_memory_rules_equal_the_loop(spark, chunk):
    rows, df = bits(spark, seed=4)
    out = {(r["run"], r["seq"]): r for r in state.memory_rules(df, ["run"], "seq", "alarm", chunk_rows=chunk).collect()}
    for name, (k, n, hold) in state.MEMORY_RULES.items():
        for run in range(6):
            history, active, clean = [], False, 0
            for r, i, alarm, _ in rows:
                if r != run:
                    continue
                history = [*history, alarm][-n:]
                hit = sum(history) >= k
                if hold == 0:
                    active = hit
                elif hit:
                    active, clean = True, 0
                elif active:
                    clean = 0 if alarm else clean + 1
                    if clean >= hold:
                        active, clean = False, 0
                assert out[(run, i)][f"can__{name}"] == int(active), (name, run, i)


@pytest.mark.parametrize("chunk", [160, 1024])
def test_trust_memory_equals_the_recursion(spark, chunk):
    rng = random.Random(5)
    rows = [(r, i, rng.random(), rng.choice([None, None, None, 0.25, 0.35])) for r in range(2) for i in range(600)]
    df = spark.createDataFrame(rows, "run int, seq bigint, x double, cap double")
    out = {(r["run"], r["seq"]): r["continuous_trust"] for r in state.trust_memory(
        df, ["run"], "seq", F.col("x"), F.col("cap"), chunk_rows=chunk).collect()}
    for run in range(2):
        t = 0.80
        for r, i, x, cap in rows:
            if r == run:
                limit = 1.0 if cap is None else cap
                t = max(0.0, min(1.0, limit, 0.65 * t + 0.35 * min(x, limit)))
                assert out[(run, i)] == pytest.approx(t, abs=1e-12)


def test_previous_and_runs_cross_chunks(spark):
    rows, df = bits(spark, runs=2)
    out = state.label_runs(df, ["run"], "seq", "alarm", chunk_rows=7).collect()
    for run in range(2):
        start, before = None, None
        for r in sorted((r for r in out if r["run"] == run), key=lambda r: r["seq"]):
            if r["alarm"] != before:
                start, before = r["seq"], r["alarm"]
            assert r["run_start"] == start


def greedy_loop(rows):
    ratios = {"train": 0.70, "validation": 0.15, "test": 0.15}
    names = list(ratios)
    classes = {}
    for signature, label in rows:
        classes.setdefault(signature, set()).add(label)
    placed = {s: "train" for s, c in classes.items() if len(c) > 1}
    for label in sorted({c for _, c in rows}):
        sizes = {}
        for s, c in rows:
            if c == label:
                sizes[s] = sizes.get(s, 0) + 1
        order = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
        target = {n: sum(sizes.values()) * r for n, r in ratios.items()}
        have = {n: 0 for n in names}
        some = {n: 0 for n in names}
        left = []
        for s, size in order:
            if s in placed:
                have["train"] += size
                some["train"] += 1
            else:
                left.append((s, size))
        for n in names:
            if not some[n]:
                s, size = left.pop(0)
                placed[s], have[n] = n, have[n] + size
        for s, size in left:
            n = max(names, key=lambda x: ((target[x] - have[x]) / max(target[x], 1.0), -names.index(x)))
            placed[s], have[n] = n, have[n] + size
    return placed


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_split_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for label in ("a", "b", "c"):
        for g in range(rng.randrange(40, 80)):
            name = f"{rng.getrandbits(64):016x}" if rng.random() > 0.05 else f"{g:016x}"
            rows += [(name, label)] * rng.choice([1, 1, 1, 2, 3, 7, 20])
    df = spark.createDataFrame(rows, "signature string, label string")
    out = {r["signature"]: r["split"] for r in splits.greedy_split(df, "signature", "label").collect()}
    assert out == greedy_loop(rows)


def test_fill_takes_many_equal_groups_at_once():
    for count, size, have, targets in ((0, 1, [0, 0, 0], [7, 2, 1]), (5000, 3, [10.0, 0.0, 50.0], [10500.0, 2250.0, 2250.0])):
        taken, state_ = [0, 0, 0], list(map(float, have))
        for _ in range(count):
            j = max(range(3), key=lambda x: ((targets[x] - state_[x]) / max(targets[x], 1.0), -x))
            taken[j] += 1
            state_[j] += size
        assert splits._fill(count, size, have, targets) == taken


def test_auc_and_thresholds_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering.value_buckets, "__defaults__", ("_bucket", 16))
    rng = random.Random(9)
    rows = [("x", int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, ["g"], "y", "s").first()["roc_auc"] == pytest.approx(want, abs=1e-12)
    points = {r["threshold"]: (r["tp"], r["fp"]) for r in metrics.curve(df, ["g"], "y", "s").collect()}
    for t, (tp, fp) in points.items():
        assert (tp, fp) == (sum(p >= t for p in pos), sum(n >= t for n in neg))


def test_ecdf_and_conformal(spark, monkeypatch):
    monkeypatch.setattr(ordering.value_buckets, "__defaults__", ("_bucket", 16))
    rng = random.Random(2)
    values = [round(rng.random(), 3) for _ in range(400)]
    df = spark.createDataFrame([("r", v) for v in values], "g string, v double")
    for r in stats.ecdf(df, df, ["g"], "v").collect():
        assert r["ecdf"] == pytest.approx(sum(x <= r["v"] for x in values) / 400)
    row = stats.conformal_threshold(df, ["g"], "v", 0.05).first()
    assert row["threshold"] == sorted(values)[row["rank"] - 1] and row["rank"] == 381


def test_bootstrap_and_sign_flip_are_sane(spark):
    df = spark.createDataFrame([("g", i, 1.0 + (i % 5) / 10) for i in range(40)], "g string, unit int, d double")
    ci = inference.bootstrap_interval(df, ["g"], "unit", "d", 300).first()
    assert ci["ci_low"] <= ci["mean"] <= ci["ci_high"] and ci["ci_high"] - ci["ci_low"] < 0.2
    p = inference.sign_flip(df, ["g"], "unit", "d", 300).first()
    assert p["p_two_sided"] < 0.05 and p["p_one_sided"] < 0.05


def test_row_quantile_and_wilson(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 10.0], 5, 20)], "v array<double>, hit int, total int")
    low, high = wilson_interval(F.col("hit"), F.col("total"))
    r = df.select(row_quantile(F.col("v"), 0.75).alias("q"), low.alias("low"), high.alias("high")).first()
    assert r["q"] == pytest.approx(np.quantile([1, 3, 10], 0.75))
    assert 0.1 < r["low"] < 0.25 < r["high"] < 0.5


def test_disjoint_allocation_never_reuses_a_window(spark):
    rows = [("a", i, "low_1_5" if i % 3 == 0 else "high_21_100") for i in range(60)]
    pool = spark.createDataFrame(rows, "capture string, parent_window_index bigint, band string")
    out = splits.disjoint_allocation(pool, ["r1", "r2"], ["capture"], "parent_window_index",
                                     {"low_1_5": 4, "high_21_100": 5, "representative_all": 6}, "band", 1).collect()
    items = [r["parent_window_index"] for r in out]
    assert len(items) == len(set(items)) == 2 * (4 + 5 + 6)


def test_policy_and_trust_on_the_scripted_rows(spark):
    """A healthy start is allowed; a failed identity is capped and denied at once."""
    rows = [(1, i, 0.9 if i < 3 else 0.1, int(i >= 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "run int, seq bigint, x double, failed int")
    out = state.trust_memory(df, ["run"], "seq", F.col("x"), F.when(F.col("failed") == 1, 0.25)).orderBy("seq").collect()
    assert out[2]["continuous_trust"] > 0.80 and all(r["continuous_trust"] <= 0.25 for r in out[3:])
    assert replay.WARNED == ("R_O",)


def test_value_buckets_are_cut_per_key(spark):
    """Keys whose values lie in different ranges each get buckets of their own."""
    rows = [("narrow", 1000 + i / 1e6) for i in range(3000)] + [("wide", i * 1e3 - 5e5) for i in range(3000)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    sizes = ordering.value_buckets(df, ["key"], "v", bucket_values=100).groupBy("key", "_bucket").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("key", "_bucket").collect()
    for key in ("narrow", "wide"):
        own = [r for r in sizes if r["key"] == key]
        assert len(own) >= 28 and max(r["n"] for r in own) <= 200
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("bucket_rows", [1, 50, 100_000])
def test_hash_positions_are_a_permutation(spark, bucket_rows):
    rows, df = skewed(spark)
    out = ordering.number_by_hash(df, ["key"], digest_number("s", F.col("at")), ["at"], "rank", bucket_rows).collect()
    for key in {r[0] for r in rows}:
        own = sorted(r["rank"] for r in out if r["key"] == key)
        assert own == list(range(len(own)))
    order = {(r["key"], r["at"]): r["rank"] for r in out}
    again = ordering.number_by_hash(df, ["key"], digest_number("s", F.col("at")), ["at"]).collect()
    assert {(r["key"], r["at"]): r["rank"] for r in again} == order


@pytest.mark.parametrize("lookback", [1, 16, 20, 50])
def test_previous_reaches_over_chunks(spark, lookback):
    df = spark.range(300).select(F.lit(1).alias("run"), F.col("id").alias("seq"), (F.col("id") * 3).alias("v"))
    out = ordering.previous(df, ["run"], "seq", {"old": (F.col("v"), lookback, -1)}, chunk_rows=16).collect()
    assert len(out) == 300 and all(r["old"] == (r["v"] - 3 * lookback if r["seq"] >= lookback else -1) for r in out)


@pytest.mark.parametrize("memory", [0.0, 0.1, 0.5, 0.65, 0.995])
def test_trust_memory_of_any_length(spark, memory):
    rng = random.Random(4)
    rows = [(1, i, rng.random(), rng.choice([None, None, 0.2, 0.7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "run int, seq bigint, x double, cap double")
    out = {r["seq"]: r["continuous_trust"] for r in state.trust_memory(df, ["run"], "seq", F.col("x"), F.col("cap"), memory=memory).collect()}
    trust = 0.80
    for _, i, x, cap in rows:
        cap = 1.0 if cap is None else cap
        trust = max(0.0, min(1.0, cap, memory * trust + (1 - memory) * min(x, cap)))
        assert out[i] == pytest.approx(trust, abs=1e-9), i


def test_tasks_follow_the_counted_rows(spark):
    """A task's share stays bounded whatever spark.sql.shuffle.partitions says, and the features are the same."""
    from busward.operators import windows
    bytes_ = [((F.col("id") * (i + 3)) % 7).cast("int").alias(b) for i, b in enumerate(windows.BYTES)]
    frames = spark.range(4_000).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("capture"), F.floor(F.col("id") / 2).alias("seq"), (F.col("id") % 5).cast("int").alias("can_id"),
        *bytes_, (F.col("id") % 50 == 0).cast("int").alias("is_attack"), (F.col("id") * 10).alias("ts_us"))

    def tasks(df):
        """Tasks that hold rows after the last shuffle of the rows themselves."""
        return df.select(F.spark_partition_id().alias("p")).distinct().count()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for build in (windows.window_features, windows.timing_features):
            dealt = build(frames, 20, rows=5 * ordering.TASK_ROWS)
            assert tasks(dealt) == 5
            assert sorted(dealt.collect(), key=str) == sorted(build(frames, 20).collect(), key=str)
        numbered = ordering.number_rows(frames.drop("seq"), ["capture"], ["ts_us"], F.floor(F.col("ts_us") / 999), rows=6 * ordering.TASK_ROWS)
        assert tasks(numbered) == 6
        assert sorted(r["seq"] for r in numbered.collect()) == sorted(2 * list(range(2_000)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordering.dealt(frames, ["capture"], None) is frames


def test_hysteresis_carries_once_for_all_monitors(spark):
    _, df = bits(spark)
    out = state.hysteresis(df, ["run"], "seq", {"on": (F.col("alarm") == 1, 2, 3), "low": (F.col("score") < 0.3, 1, 2)})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
