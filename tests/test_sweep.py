"""Threshold sweeps against counting every capture at every threshold."""

import random

import pytest

from busward.operators import metrics


def plain(rows, thresholds, strict):
    out = {}
    captures = sorted({c for c, _ in rows})
    for t in thresholds:
        rates, alarms = [], 0
        for c in captures:
            own = [x for k, x in rows if k == c]
            hits = sum(x > t if strict else x >= t for x in own)
            alarms += hits
            rates.append(hits / len(own))
        out[t] = (alarms / len(rows), sum(rates) / len(rates), max(rates), len(rows))
    return out


def cases():
    rng = random.Random(5)
    rows = [(rng.choice("aaaabc"), rng.choice([0.2, 0.5, 0.75, 0.9, 1.0, rng.random()])) for _ in range(400)]
    return rows + [("low", 0.1), ("low", 0.3), ("top", 1.0), ("top", 1.2)]


def test_grid_sweep(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "capture string, score double")
    got = metrics.grid_operating_points(df, "capture", "score", points=41).collect()
    assert len(got) == 41
    want = plain(rows, [r["threshold"] for r in got], False)
    for r in got:
        assert (r["pooled_fpr"], r["macro_fpr"], r["worst_fpr"], r["windows"]) == pytest.approx(want[r["threshold"]], abs=1e-12)
    assert metrics.grid_operating_points(df.limit(0), "capture", "score", points=41).count() == 0


@pytest.mark.parametrize("most", [3, 7, 8, 64])
def test_candidate_sweep(spark, most):
    rows = cases()
    wanted = [0.0, 0.5, 2.0] if most == 3 else [0.0, 0.2, 0.5, 0.6, 0.9, 1.0, 2.0]
    df = spark.createDataFrame(rows, "capture string, score double")
    candidates = spark.createDataFrame([(x,) for x in wanted + wanted[:2]] + [(None,)], "threshold double")
    got = metrics.candidate_operating_points(df, "capture", "score", candidates, most).collect()
    assert len(got) == 2 * len(wanted)
    for strict in (0, 1):
        want = plain(rows, wanted, strict)
        for r in got:
            if r["strict"] == strict:
                assert (r["pooled_fpr"], r["macro_fpr"], r["worst_fpr"], r["windows"]) == pytest.approx(want[r["threshold"]], abs=1e-12)
