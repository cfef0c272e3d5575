"""Decoded-signal profiles, row scores and novelty."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.functions.columns import row_quantile
from busward.operators.ordering import CHUNK_ROWS, dealt
from busward.operators.stats import three_way_scale_of, value_counts

UNKNOWN_SCORE = 50.0


def with_previous(rows: DataFrame, columns: Sequence[str], prefix: str, keys: Sequence[str] = ("capture", "can_id"),
                  order: str = "seq", count: int | None = None) -> DataFrame:
    """Signal values of the previous row of the same ID, whatever lies between.

    The first row of a chunk of `order` gets the last one of the chunk before it, from one row per ID and
    chunk; so rows are shuffled once. `count`, their number, is as `rows` in dealt.
    """
    keys = list(keys)
    chunk = [*keys, "_chunk"]
    named = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK_ROWS))
    ends = named.groupBy(*chunk).agg(F.max_by(F.struct(*columns), order).alias("_end"))
    carry = ends.select(*chunk, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    local = Window.partitionBy(*chunk).orderBy(order)
    out = dealt(named, chunk, count).withColumns(
        {"_nth": F.row_number().over(local), **{f"_l_{c}": F.lag(c).over(local) for c in columns}}).join(carry, chunk)
    out = out.withColumns({f"{prefix}{c}": F.when(F.col("_nth") == 1, F.col("_carry")[c]).otherwise(F.col(f"_l_{c}")) for c in columns})
    return out.select(*rows.columns, *[f"{prefix}{c}" for c in columns])


def with_deltas(rows: DataFrame, signals: Sequence[str], count: int | None = None) -> DataFrame:
    """Change of each signal since the previous row of the same ID. `count` is as in with_previous."""
    out = with_previous(rows, signals, "_p_", count=count)
    return out.withColumns({f"delta_{s}": F.col(s) - F.col(f"_p_{s}") for s in signals}).drop(*[f"_p_{s}" for s in signals])


def signal_scales(rows: DataFrame, signals: Sequence[str], min_values: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Centre and robust scale per ID and signal from all rows; rare signals are inactive.

    `keep` stages the counted values, which several passes read.
    """
    keys = ["can_id", "signal"]
    counted = value_counts(rows.unpivot(["can_id"], list(signals), "signal", "value"), keys, "value")
    return three_way_scale_of(keep(counted) if keep else counted, keys, "value").where(F.col("n") >= min_values)


def profile_table(values: DataFrame, deltas: DataFrame, signals: Sequence[str], min_values: int,
                  min_deltas: int, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per ID: for every signal the value and delta centre and scale, null when inactive.

    `keep(name, table)` stages the counted values and deltas.
    """
    def kept(name: str) -> Callable[[DataFrame], DataFrame] | None:
        return (lambda table: keep(name, table)) if keep else None

    value = signal_scales(values, signals, min_values, kept("values"))
    renamed = deltas.select("can_id", *[F.col(f"delta_{s}").alias(s) for s in signals])
    delta = signal_scales(renamed, signals, min_deltas, kept("deltas"))

    def wide(table: DataFrame, prefix: str) -> DataFrame:
        return table.groupBy("can_id").agg(*[
            F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{prefix}{c}_{s}") for s in signals for c in ("center", "scale")])

    return wide(value, "v_").join(wide(delta, "d_"), "can_id", "left")


def row_scores(rows: DataFrame, profile: DataFrame, signals: Sequence[str], quantile: float = 0.90) -> DataFrame:
    """Marginal and transition scores and novelty of each row.

    An unknown ID, a signal never active for the ID, or a row without any known signal is novel; its
    scores are at least the unknown score. `rows` carries delta_<signal> columns.
    """
    both = rows.join(profile.withColumn("_known", F.lit(1)), "can_id", "left")

    def z(column: str, kind: str, s: str) -> Column:
        return F.abs((F.col(column) - F.col(f"{kind}_center_{s}")) / F.col(f"{kind}_scale_{s}"))

    values = F.array(*[z(s, "v", s) for s in signals])
    steps = F.array(*[z(f"delta_{s}", "d", s) for s in signals])
    never_active = F.lit(False)
    no_known = F.lit(True)
    for s in signals:
        inactive = F.col(f"v_center_{s}").isNull()
        never_active = never_active | (inactive & F.col(s).isNotNull())
        no_known = no_known & (inactive | F.col(s).isNull())
    novel = F.col("_known").isNull() | never_active | no_known
    base = both.withColumn("unknown_signal", novel.cast("int"))

    def score(array: Column) -> Column:
        plain = F.coalesce(row_quantile(array, quantile), F.lit(0.0))
        return F.when(F.col("_known").isNull(), UNKNOWN_SCORE).when(
            F.col("unknown_signal") == 1, F.greatest(plain, F.lit(UNKNOWN_SCORE))).otherwise(plain)

    return base.withColumn("marginal_score", score(values)).withColumn("transition_score", score(steps)).drop(
        "_known", *profile.columns[1:])


def _standardized(s: str) -> Column:
    """Distance from the centre in scales; zero for a missing value."""
    return F.coalesce((F.col(s) - F.col(f"v_center_{s}")) / F.col(f"v_scale_{s}"), F.lit(0.0))


def shrunk_covariances(rows: DataFrame, profile: DataFrame, signals: Sequence[str]) -> DataFrame:
    """can_id, active, rows, shrinkage, covariance: the covariance of the standardized active signals of each ID,
    shrunk towards its mean variance with the Ledoit-Wolf weight.

    The weight and the covariance need sums of second and fourth order only. They are plain sums of a packed
    upper triangle, about the means of a first pass, so every task adds up its own rows of an ID before the
    shuffle and one row per ID comes out. Missing values count as zero.
    """
    p = len(signals)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    active = F.array_compact(F.array(*[F.when(F.col(f"v_center_{s}").isNotNull(), i) for i, s in enumerate(signals)]))
    known = rows.join(profile, "can_id").select("can_id", active.alias("active"), *[_standardized(s).alias(f"z{i}") for i, s in enumerate(signals)])
    means = known.groupBy("can_id").agg(F.first("active").alias("active"), F.count(F.lit(1)).alias("rows"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(p)])
    means = means.where(F.size("active") > 0)
    centred = known.drop("active").join(means.select("can_id", *[f"m{i}" for i in range(p)]), "can_id").select(
        "can_id", *[(F.col(f"z{i}") - F.col(f"m{i}")).alias(f"c{i}") for i in range(p)])
    product = [F.col(f"c{i}") * F.col(f"c{j}") for i, j in pairs]
    sums = centred.groupBy("can_id").agg(
        F.array(*[F.sum(x) for x in product]).alias("second"), F.array(*[F.sum(x * x) for x in product]).alias("fourth"))
    packed = means.select("can_id", "active", "rows").join(sums, "can_id")

    def at(column: str, i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return F.get(column, (low * p - low * (low - 1) / 2 + high - low).cast("int")) / F.col("rows")

    def total(f) -> Column:
        """Sum of f(i, j) over all pairs of active signals."""
        add = lambda acc, x: acc + x
        return F.aggregate(F.transform("active", lambda i: F.aggregate(F.transform("active", lambda j: f(i, j)), F.lit(0.0), add)), F.lit(0.0), add)

    def target(i: Column, j: Column) -> Column:
        return F.when(i == j, F.col("_variance")).otherwise(0.0)

    out = packed.withColumn("_variance", total(lambda i, j: F.when(i == j, at("second", i, j)).otherwise(0.0)) / F.size("active"))
    out = out.withColumns({
        "_distance": total(lambda i, j: F.pow(at("second", i, j) - target(i, j), F.lit(2.0))),
        "_noise": total(lambda i, j: at("fourth", i, j) - F.pow(at("second", i, j), F.lit(2.0))) / F.col("rows")})
    out = out.withColumn("shrinkage", F.when(F.col("_distance") > 0, F.least("_noise", "_distance") / F.col("_distance")).otherwise(0.0))
    shrunk = lambda i, j: (1 - F.col("shrinkage")) * at("second", i, j) + F.col("shrinkage") * target(i, j)
    return out.select("can_id", "active", "rows", "shrinkage", F.transform(
        "active", lambda i: F.transform("active", lambda j: shrunk(i, j))).alias("covariance"))


def precision_matrices(rows: DataFrame, profile: DataFrame, signals: Sequence[str]) -> DataFrame:
    """can_id, active, rows, shrinkage, precision: the (pseudo-)inverse of each ID's shrunk covariance, one small
    matrix per ID. A single active signal has precision one."""

    def inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matrices = [np.stack([np.asarray(r) for r in m]) for m in pdf["covariance"]]
            alone = pdf["active"].map(len) == 1
            yield pdf.assign(
                shrinkage=pdf["shrinkage"].mask(alone, 0.0),
                precision=[np.linalg.pinv(m).tolist() if len(m) > 1 else [[1.0]] for m in matrices]).drop(columns="covariance")

    return shrunk_covariances(rows, profile, signals).mapInPandas(
        inverted, "can_id int, active array<int>, rows bigint, shrinkage double, precision array<array<double>>")


def context_score(rows: DataFrame, profile: DataFrame, precision: DataFrame, signals: Sequence[str]) -> DataFrame:
    """sqrt(z' P z / k) over the active signals of the ID; at least the unknown score for novel rows.

    `rows` carries unknown_signal, as row_scores gives it.
    """
    both = rows.join(profile, "can_id", "left").join(precision.select("can_id", "active", "precision"), "can_id", "left")
    every = F.array(*[_standardized(s) for s in signals])
    named = both.withColumn("_z", F.transform("active", lambda i: F.get(every, i)))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)

    form = F.aggregate(F.zip_with("_z", "precision", lambda zi, row: zi * dot(row, F.col("_z"))), F.lit(0.0), lambda acc, v: acc + v)
    score = F.coalesce(F.sqrt(F.greatest(form, F.lit(0.0)) / F.greatest(F.size("active"), F.lit(1))), F.lit(UNKNOWN_SCORE))
    novel = F.col("unknown_signal") == 1
    return named.withColumn("context_score", F.when(novel, F.greatest(score, F.lit(UNKNOWN_SCORE))).otherwise(score)).drop(
        "_z", "active", "precision", *profile.columns[1:])
