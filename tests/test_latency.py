"""First-detection latency in several units."""

from busward.operators import state


def test_latency_in_windows_rows_and_seconds(spark):
    rows = [("a", i, 20 * i, 0.5 * i * i, int(i >= 7), int(i == 9)) for i in range(5, 12)] + [("b", 3, 60, 1.0, 0, 0), ("c", 4, 80, 2.0, 1, 1)]
    df = spark.createDataFrame(rows, "run string, i long, row long, ts double, fast int, slow int")
    got = {(r["run"], r["method"]): (r["windows"], r["frames"], r["seconds"]) for r in state.detection_latency(
        df, ["run"], "i", {"fast": "fast", "slow": "slow"}, {"windows": "i", "frames": "row", "seconds": "ts"}).collect()}
    assert got == {("a", "fast"): (2, 40, 12.0), ("a", "slow"): (4, 80, 28.0), ("b", "fast"): (None,) * 3,
                   ("b", "slow"): (None,) * 3, ("c", "fast"): (0, 0, 0.0), ("c", "slow"): (0, 0, 0.0)}
    default = state.detection_latency(df, ["run"], "i", {"fast": "fast"})
    assert default.columns == ["run", "start", "end", "rows", "method", "latency"]
    assert {r["run"]: r["latency"] for r in default.collect()} == {"a": 2, "b": None, "c": 0}
