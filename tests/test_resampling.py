"""Bootstrap and sign flips of all replicates against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from busward.operators import inference, resampling


def scrambled(x):
    for constant in resampling.ROUNDS:
        x = pow((x + constant) % resampling.PRIME, 5, resampling.PRIME)
    return x


def plain_means(values, replicates, seed):
    """values in slot order, one block: draw d of replicate b takes unit number(b, d) mod n."""
    p, n = resampling.PRIME, len(values)
    return [sum(values[scrambled((scrambled((seed + b) % p) + d) % p) % n] for d in range(n)) / n for b in range(replicates)]


def ordered(spark, units, keys, seed):
    """The values of each key in slot order, from the blocks of the library."""
    return {tuple(r[k] for k in keys): list(r["_values"]) for r in resampling.blocks(units, keys, "unit", "v", seed).collect()}


def test_bootstrap_equals_a_plain_version(spark):
    dice = random.Random(2)
    rows = [(g, i, round(dice.gauss(k, 1), 3)) for k, g in enumerate("ab") for i in range(20 + 9 * k)] + [("a", 99, None), ("one", 1, 0.5)]
    units = spark.createDataFrame(rows, "g string, unit int, v double").repartition(4)
    got = {r["g"]: r for r in inference.bootstrap_interval(units, ["g"], "unit", "v", 500, 17).collect()}
    for (g,), values in ordered(spark, units, ["g"], 17).items():
        assert sorted(values) == sorted(v for k, _, v in rows if k == g and v is not None)
        means = plain_means(values, 500, 17)
        assert got[g]["n_units"] == len(values) and got[g]["mean"] == pytest.approx(np.mean(values))
        if len(values) == 1:
            assert got[g]["ci_low"] is None and got[g]["ci_high"] is None
        else:
            assert [got[g]["ci_low"], got[g]["ci_high"]] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), rel=1e-12)


def test_draws_spread_over_blocks(spark, monkeypatch):
    """Counts of blocks add up to n in every replicate and have the moments of a multinomial."""
    monkeypatch.setattr(resampling, "BLOCK", 8)
    n, replicates = 43, 4000
    counts = np.stack([resampling.block_counts(n, b, replicates, (3, 5)) for b in range(6)])
    assert (counts.sum(axis=0) == n).all()
    sizes = np.array([8, 8, 8, 8, 8, 3])
    assert np.abs(counts.mean(axis=1) - sizes).max() < 0.2
    assert np.abs(counts.var(axis=1) / (sizes * (1 - sizes / n)) - 1).max() < 0.15
    values = np.arange(n, dtype=float)
    total = sum(resampling.block_sums(values[8 * b : 8 * b + 8], n, b, replicates, 3, 5) for b in range(6)) / n
    assert total.mean() == pytest.approx(values.mean(), abs=0.15) and total.std() == pytest.approx(values.std() / n**0.5, rel=0.06)
    units = spark.createDataFrame([("k", i, float(i)) for i in range(n)], "g string, unit int, v double")
    means = [r["resampled_mean"] for r in inference.bootstrap_means(units, ["g"], "unit", "v", 300, 3).collect()]
    assert len(means) == 300 and np.mean(means) == pytest.approx(values.mean(), abs=2.5)


@pytest.mark.parametrize("values", [[0.5, -0.25, 1.0, 0.75, 2.0], [0.0, 0.0, 0.0], [1.0], [-1.0, 1.0], [0.1] * 9, [-0.3, -0.2, -0.7, 0.1]])
def test_exact_flips_equal_enumeration(values):
    n, observed = len(values), np.mean(values)
    means = [np.mean([s * v for s, v in zip(signs, values)]) for signs in itertools.product((-1, 1), repeat=n)]
    assert resampling.exact_flips(np.array(values)) == (sum(abs(m) >= abs(observed) - 1e-12 for m in means), sum(m >= observed - 1e-12 for m in means))


def test_sign_flip_exact_and_random(spark, monkeypatch):
    dice = random.Random(4)
    rows = [("small", i, dice.gauss(0.6, 1)) for i in range(14)] + [("large", i, dice.gauss(0.2, 1)) for i in range(90)] + [("none", i, 0.0) for i in range(3)]
    units = spark.createDataFrame([*rows, ("small", 50, None)], "g string, unit int, v double")
    monkeypatch.setattr(resampling, "BLOCK", 16)
    whole = {r["g"]: r for r in inference.sign_flip(units, ["g"], "unit", "v", 20_000).collect()}
    assert whole["none"]["p_two_sided"] == whole["none"]["p_one_sided"] == 1
    values = np.array([v for g, _, v in rows if g == "small"])
    means = np.array([np.mean(values * s) for s in itertools.product((-1, 1), repeat=14)])
    assert whole["small"]["n_units"] == 14
    assert whole["small"]["p_two_sided"] == pytest.approx((np.abs(means) >= abs(values.mean()) - 1e-12).mean())
    assert whole["small"]["p_one_sided"] == pytest.approx((means >= values.mean() - 1e-12).mean())
    values = np.array([v for g, _, v in rows if g == "large"])
    z = values.sum() / np.sqrt((values**2).sum())
    from statistics import NormalDist
    assert whole["large"]["p_one_sided"] == pytest.approx(1 - NormalDist().cdf(z), abs=0.01)
    assert whole["large"]["p_two_sided"] == pytest.approx(2 * whole["large"]["p_one_sided"], abs=0.01)


def test_forty_units_are_exact(spark):
    """A p value far below one in the number of random flips."""
    units = spark.createDataFrame([("g", i, 1.0 + (i % 5) / 10) for i in range(40)], "g string, unit int, v double")
    p = inference.sign_flip(units, ["g"], "unit", "v").first()
    assert p["p_two_sided"] == 2 / 2**40 and p["p_one_sided"] == 1 / 2**40


def test_pieces_of_replicates_equal_whole_blocks(spark, monkeypatch):
    """Keys of one block and of several, cut into pieces: the sums of every replicate, from several tasks."""
    monkeypatch.setattr(resampling, "BLOCK", 32)
    monkeypatch.setattr(resampling, "PIECE", 1000)
    sizes = {"a": 20, "b": 20, "c": 75, "d": 70}
    units = spark.createDataFrame([(k, i, float(i * i % 17)) for k, n in sizes.items() for i in range(n)], "g string, unit int, v double").coalesce(1)
    cut = resampling.blocks(units, ["g"], "unit", "v", 3)
    want = {k: np.zeros(300) for k in sizes}
    for r in cut.collect():
        counts = resampling.block_counts(r["_n"], r["_block"], 300, (3, r["_key"]))
        draws = np.arange(counts.max())
        for b, count in enumerate(counts):
            x = [scrambled((scrambled((3 + b) % resampling.PRIME) + int(d) + r["_block"] * 32) % resampling.PRIME) for d in draws[:count]] \
                if b % 60 == 0 else []
            want[r["g"]][b] += sum(r["_values"][i % len(r["_values"])] for i in x)
    got = {(r["g"], r["replicate"]): r["total"] for r in resampling.replicate_sums(cut, ["g"], 300, 3).collect()}
    assert len(got) == 4 * 300
    for k, sums in want.items():
        assert [got[k, b] for b in range(0, 300, 60)] == pytest.approx(sums[::60].tolist())
    tasks = resampling.spread(cut, ["_key", "_block"]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_keys_share_draws(monkeypatch):
    """Keys that take different numbers of draws from a block share them; before, each made its own."""
    dice = np.random.default_rng(6)
    values = dice.normal(size=(12, 64))
    values[3, 5], values[7, 9] = np.nan, np.inf
    counts = dice.binomial(640, 0.1, (12, 50))
    made = []
    scramble = resampling._scrambled
    monkeypatch.setattr(resampling, "_scrambled", lambda x: made.append(x.size) or scramble(x))
    monkeypatch.setattr(resampling, "TILE", 1000)
    got = resampling.drawn_sums(values, counts, 30, 128, 9)
    assert sum(made) <= 50 * (counts.max() + 1)
    for b in range(50):
        drawn = resampling.draw_numbers(9, 0, np.array(30 + b), np.arange(128, 128 + counts.max())) % 64
        for k in range(12):
            assert got[k, b] == pytest.approx(values[k, drawn[: counts[k, b]]].sum(), nan_ok=True)


def test_sums_of_a_task_leave_it_once(spark, monkeypatch):
    """The blocks of a key that a task holds are added before the shuffle; before, every block was a row of it."""
    monkeypatch.setattr(resampling, "BLOCK", 16)
    units = spark.createDataFrame([(k, i, 1.0) for k in "ab" for i in range(160)], "g string, unit int, v double").coalesce(1)
    cut = resampling.blocks(units, ["g"], "unit", "v", 3).coalesce(1).cache()
    assert cut.count() == 20
    summed = resampling.added_parts(cut, ["g"], lambda rows: ((r, 0, np.ones(3)) for r in rows))
    assert {r["g"]: r["_sums"] for r in summed.collect()} == {"a": [10.0] * 3, "b": [10.0] * 3}
    plan = summed._jdf.queryExecution().executedPlan()
    while "MapInPandas" not in plan.nodeName():
        plan = plan.children().head() if plan.children().nonEmpty() else plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.plan()
    assert plan.metrics().get("pythonNumRowsReceived").get().value() == 2
    cut.unpersist()
