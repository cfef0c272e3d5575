"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MAD_TO_SIGMA = 1.4826
EPSILON = 1e-12
WILSON_Z = 1.959963984540054


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0 on an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / F.when(denominator != 0, denominator)
    )


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def row_quantile(values: Column, probability: float) -> Column:
    """Linear-interpolated quantile of an array column, nulls skipped; null when nothing is left."""
    def quantile(ordered: Column) -> Column:
        position = (F.size(ordered) - 1) * F.lit(float(probability))
        low = F.floor(position)
        low_value = F.get(ordered, low.cast("int"))
        high_value = F.get(ordered, F.ceil(position).cast("int"))
        return F.when(F.size(ordered) > 0, low_value + (high_value - low_value) * (position - low))

    # Bound in an array of one, so that it is sorted once and not for each use.
    return F.get(F.transform(F.array(F.sort_array(F.array_compact(values))), quantile), F.lit(0))


def log_odds(probability: Column, epsilon: float = EPSILON) -> Column:
    p = clamp(probability, epsilon, 1.0 - epsilon)
    return F.log(p / (1.0 - p))


def two_sided_ratio(value: Column, center: Column, lower: Column, upper: Column) -> Column:
    """Distance from the centre in units of the lower or the upper half-range."""
    below = F.greatest(center - lower, F.lit(EPSILON))
    above = F.greatest(upper - center, F.lit(EPSILON))
    return F.when(value < center, (center - value) / below).otherwise((value - center) / above)


def deviation_trust(deviation: Column, threshold: Column) -> Column:
    """Trust in (0, 1]: one at no deviation, one half at the threshold."""
    ratio = deviation / F.greatest(threshold, F.lit(EPSILON))
    return 1.0 / (1.0 + ratio * ratio)


def logistic(features: Sequence[Column], weights: Sequence[float], intercept: float) -> Column:
    """Probability of a linear model with given coefficients."""
    score = F.lit(float(intercept))
    for feature, weight in zip(features, weights):
        score = score + feature * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(-score))


def wilson_interval(successes: Column, total: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = 1.0 + z * z / n
    center = (p + z * z / (2.0 * n)) / scale
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
    return F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


def digest_number(*parts: Column | str | int) -> Column:
    """A 32-bit number from the MD5 of the parts; the source of all reproducible randomness."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def parse_boolean(text: Column, true: Sequence[str] = ("true", "1", "yes"),
                  false: Sequence[str] = ("false", "0", "no")) -> Column:
    """Text to boolean; unknown text is null so that it can be counted as a violation."""
    norm = F.lower(F.trim(text.cast("string")))
    return F.when(norm.isin(*true), True).when(norm.isin(*false), False)


def split_sources(text: Column, without: Sequence[str] = ()) -> Column:
    """`;`-joined names to a sorted set, optionally without some names."""
    names = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x != "")
    names = F.array_distinct(names)
    if without:
        names = F.array_except(names, F.array(*[F.lit(w) for w in without]))
    return F.array_sort(names)


def has_any(names: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(w) for w in wanted]))


def density_band(attack_frames: Column) -> Column:
    return (
        F.when(attack_frames == 0, "benign")
        .when(attack_frames <= 5, "low_1_5")
        .when(attack_frames <= 20, "medium_6_20")
        .otherwise("high_21_100")
    )
