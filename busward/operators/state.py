"""Alarm and trust state along ordered rows, written as windows over chunks with a carry."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.operators.ordering import CHUNK_ROWS, carried, last_known, previous, streaks, with_halo

# The named memory rules as (required hits, history windows, clean windows to hold).
MEMORY_RULES = {
    "strict_consecutive_2": (2, 2, 0),
    "two_of_3_no_hold": (2, 3, 0),
    "two_of_3_hold_2": (2, 3, 2),
    "two_of_3_hold_3": (2, 3, 3),
    "two_of_4_hold_2": (2, 4, 2),
    "three_of_5_hold_2": (3, 5, 2),
    "instant_advisory_reference": (1, 1, 0),
}


def persistent_2(df: DataFrame, keys: Sequence[str], order: str, alarms: Mapping[str, str],
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Alarm that also held in the previous row; `alarms` maps new names to 0/1 columns."""
    out = previous(df, keys, order, {f"_p_{n}": (F.col(c), 1, 0) for n, c in alarms.items()}, chunk_rows)
    for name, column in alarms.items():
        out = out.withColumn(name, F.col(column) * F.col(f"_p_{name}"))
    return out.drop(*[f"_p_{n}" for n in alarms])


def hysteresis(df: DataFrame, keys: Sequence[str], order: str, bad: Mapping[str, tuple[Column, int, int]],
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Monitors that switch on after A bad rows in a row and off after R good ones.

    `bad` maps a monitor to (condition, A, R). A latch is a monitor with A = 1. `order` counts from 0. Whether
    the last A or R rows agree is seen in a halo, so the rows are shuffled once for all monitors.
    """
    longest = max(max(a, r, 1) for _, a, r in bad.values())
    marks = {}
    for name, (condition, _, _) in bad.items():
        marks[f"_bad_{name}"] = F.coalesce(condition, F.lit(False)).cast("int")
        marks[f"_good_{name}"] = F.coalesce(~condition, F.lit(False)).cast("int")
    out = with_halo(df, order, longest - 1, chunk_rows).withColumns(marks)
    by_order = Window.partitionBy(*keys, "_chunk").orderBy(order)

    def held(mark: str, rows: int) -> Column:
        return F.sum(mark).over(by_order.rowsBetween(1 - rows, 0)) == rows if rows > 0 else F.lit(True)

    events = {f"_v_{name}": F.when(held(f"_bad_{name}", a), 1).when(held(f"_good_{name}", r), 0)
              for name, (_, a, r) in bad.items()}
    out = out.withColumns(events).where(~F.col("_halo")).drop("_halo", *marks)
    out = carried(out, keys, order, list(bad))
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in bad})


def memory_rules(df: DataFrame, keys: Sequence[str], order: str, alarm: str,
                 rules: Mapping[str, tuple[int, int, int]] = MEMORY_RULES, prefix: str = "can__",
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """k-of-n alarm memories: on at k hits in the last n rows, held until h rows without a hit."""
    longest = max(n for _, n, _ in rules.values())
    out = with_halo(df, order, longest, chunk_rows)
    by_order = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = out.withColumns({f"_t_{name}": (F.sum(alarm).over(by_order.rowsBetween(-(n - 1), 0)) >= k).cast("int")
                           for name, (k, n, _) in rules.items()})
    out = out.where(~F.col("_halo")).drop("_chunk", "_halo")
    held = {name: h for name, (_, _, h) in rules.items() if h}
    if held:
        out = streaks(out, keys, order, {
            f"_q_{n}": (F.col(f"_t_{n}") == 0) & (F.col(alarm) == 0) for n in held}, chunk_rows)
        out = last_known(out, keys, order, {
            f"{prefix}{n}": F.when(F.col(f"_t_{n}") == 1, 1).when(F.col(f"_q_{n}") >= h, 0)
            for n, h in held.items()}, chunk_rows)
    out = out.withColumns({
        f"{prefix}{n}": F.coalesce(F.col(f"{prefix}{n}"), F.lit(0)) if n in held else F.col(f"_t_{n}") for n in rules})
    return out.drop(*[f"_t_{n}" for n in rules], *[f"_q_{n}" for n in held])


def trust_memory(df: DataFrame, keys: Sequence[str], order: str, value: Column, cap: Column | None = None,
                 memory: float = 0.65, initial: float = 0.80, into: str = "continuous_trust",
                 chunk_rows: int | None = None) -> DataFrame:
    """Exponential trust memory t = m t + (1-m) min(x, cap), capped again by `cap` and kept in [0, 1].

    The memory forgets geometrically: after `halo` rows an earlier state weighs less than 1e-24, below
    double precision. A chunk therefore starts `halo` rows early from the initial trust and needs no
    state from another task. Inside the chunk the recursion is two running windows: with w = m^-p,
    t_p = m^p (S_p + min(m t0, min_k(cap_k w_k - S_k))), S_p the running sum of (1-m) x w. A chunk is as
    long as the halo where that is above 1024 rows, and short enough for w to stay finite.
    """
    if not 0 <= memory < 1:
        raise ValueError("memory must be at least 0 and below 1; at 1 no value would ever count")
    limit = F.lit(1.0) if cap is None else F.least(F.lit(1.0), F.coalesce(cap, F.lit(1.0)))
    if memory == 0:
        return df.withColumn(into, F.greatest(F.lit(0.0), F.least(value, limit)))
    rate = -math.log(memory)
    halo = math.ceil(24 * math.log(10) / rate)
    chunk_rows = min(chunk_rows or max(1024, halo), max(1, int(600 / rate)))
    out = df.withColumn("_cap", limit).withColumn("_x", F.least(value, F.col("_cap")))
    out = with_halo(out, order, halo, chunk_rows)
    start = F.greatest(F.col("_chunk") * chunk_rows - halo, F.lit(0))
    step = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = (out.withColumn("_p", F.col(order) - start)
           .withColumn("_w", F.pow(F.lit(1.0 / memory), F.col("_p")))
           .withColumn("_s", F.sum((1.0 - memory) * F.col("_x") * F.col("_w")).over(step))
           .withColumn("_m", F.min(F.col("_cap") * F.col("_w") - F.col("_s")).over(step)))
    trust = F.pow(F.lit(memory), F.col("_p")) * (F.col("_s") + F.least(F.lit(memory * initial), F.col("_m")))
    return (out.withColumn(into, F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust)))
            .where(~F.col("_halo")).drop("_chunk", "_halo", "_cap", "_x", "_p", "_w", "_s", "_m"))


def label_runs(df: DataFrame, keys: Sequence[str], order: str, label: str, into: str = "run_start",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Name each maximal run of equal labels by the order value at which it starts."""
    out = previous(df, keys, order, {"_before": (F.col(label), 1, None)}, chunk_rows)
    starts = F.when(F.col("_before").isNull() | (F.col("_before") != F.col(label)), F.col(order))
    return last_known(out, keys, order, {into: starts}, chunk_rows).drop("_before")


def detection_latency(runs: DataFrame, keys: Sequence[str], order: str, alarms: Mapping[str, str],
                      units: Mapping[str, str] | None = None) -> DataFrame:
    """First alarm minus the start, per group and method; null when never detected.

    `units` maps latency columns to the columns they are measured in (windows, rows, seconds); by default one
    column `latency` in units of `order`. All units and methods come from one aggregation.
    """
    units = {"latency": order} if units is None else units
    firsts = runs.groupBy(*keys).agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("rows"),
        *[F.min_by(c, order).alias(f"_s_{u}") for u, c in units.items()],
        *[F.min_by(c, F.when(F.col(a) == 1, F.col(order))).alias(f"_f_{n}_{u}")
          for n, a in alarms.items() for u, c in units.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), *[
        (F.col(f"_f_{n}_{u}") - F.col(f"_s_{u}")).alias(u) for u in units]) for n in alarms]))
    return firsts.select(*keys, "start", "end", "rows", rows.alias("_m")).select(
        *keys, "start", "end", "rows", "_m.*")


def delayed(df: DataFrame, keys: Sequence[str], order: str, flags: Sequence[str], rows: int = 5,
            suffix: str = "_delayed", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flags shifted by a number of rows, filled with 0."""
    return previous(df, keys, order, {f"{f}{suffix}": (F.col(f), rows, 0) for f in flags}, chunk_rows)


def motion(df: DataFrame, keys: Sequence[str], order: str, speed: str, heading: str, acceleration: str,
           time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Acceleration derived from speed, and the heading change wrapped to [-180, 180)."""
    out = previous(df, keys, order, {
        "_speed": (F.col(speed), 1, None), "_heading": (F.col(heading), 1, None),
        "_time": (F.col(time).cast("double"), 1, None)}, chunk_rows)
    gap = F.col(time).cast("double") - F.col("_time")
    derived = F.when(gap > 0, (F.col(speed) - F.col("_speed")) / F.when(gap > 0, gap))
    turned = F.pmod(F.col(heading) - F.col("_heading") + 180.0, F.lit(360.0)) - 180.0
    return (out.withColumn("derived_acceleration", F.coalesce(derived, F.col(acceleration)))
            .withColumn("heading_delta", F.coalesce(turned, F.lit(0.0)))
            .drop("_speed", "_heading", "_time"))
