"""Schema and quality audits as aggregates and violation counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.functions.columns import safe_divide
from busward.operators.ordering import previous


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")


def file_audit(df: DataFrame, key: str, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows, null cells and duplicate rows per file, with schema differences."""
    nulls = [F.col(c).isNull().cast("int") for c in columns]
    counted = df.groupBy(key, *columns).agg(F.count(F.lit(1)).alias("_n"))
    cells = nulls[0]
    for n in nulls[1:]:
        cells = cells + n
    out = counted.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.sum(cells * F.col("_n")).alias("null_cells"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"))
    missing = ";".join(sorted(set(required) - set(columns)))
    extra = ";".join(sorted(set(columns) - set(required)))
    return (out.withColumn("columns", F.lit(len(columns)))
            .withColumn("duplicate_percentage", 100.0 * F.col("duplicate_rows") / F.col("rows"))
            .withColumn("missing_columns", F.lit(missing)).withColumn("unexpected_columns", F.lit(extra)))


def value_distribution(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Count and percentage of every value of every target; null shows as <MISSING>."""
    text = df.select(key, *[F.coalesce(F.col(t).cast("string"), F.lit("<MISSING>")).alias(t) for t in targets])
    counted = text.unpivot([key], list(targets), "target_column", "class_value").groupBy(
        key, "target_column", "class_value").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(key, "target_column"))
    return counted.withColumn("percentage", F.round(100.0 * F.col("count") / total, 4))


def check_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Mark every row with its failed check names, joined by `;`, and whether it is valid."""
    failed = F.concat_ws(";", *[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])
    return df.withColumn("failure_reasons", failed).withColumn("valid", (F.col("failure_reasons") == "").cast("int"))


def check_counts(checked: DataFrame, key: str, checks: Sequence[str]) -> DataFrame:
    """Failed rows per file and check."""
    names = F.split("failure_reasons", ";")
    counted = checked.groupBy(key).agg(F.count(F.lit(1)).alias("rows_checked"), *[
        F.sum(F.array_contains(names, c).cast("int")).alias(c) for c in checks])
    return counted.unpivot([key, "rows_checked"], list(checks), "check_name", "failed_rows").withColumn(
        "passed", (F.col("failed_rows") == 0).cast("int"))


def malformed_gate(checked: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Share of malformed rows against its budget."""
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(1 - F.col("valid")).alias("malformed_rows")).withColumn(
        "malformed_fraction", safe_divide(F.col("malformed_rows"), F.col("rows"))).withColumn(
        "passed", (F.col("malformed_fraction") <= limit).cast("int"))


def malformed_report(checked: DataFrame, keys: Sequence[str], order: str, line: str, limit: float,
                     examples: int = 5) -> DataFrame:
    """Malformed share against its budget, with the first malformed lines of each key as `position: line`.

    Only `examples` lines a key and task reach the shuffle. Keys without a malformed line have an empty list.
    """
    first = Window.partitionBy(*keys).orderBy(order)
    shown = checked.where(F.col("valid") == 0).select(*keys, order, line).withColumn(
        "_rank", F.row_number().over(first)).where(F.col("_rank") <= examples)
    text = F.concat(F.col(order).cast("string"), F.lit(": "), F.col(line))
    listed = shown.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", text.alias("text")))), lambda x: x["text"]).alias("examples"))
    gate = malformed_gate(checked, keys, limit)
    return gate.join(listed, list(keys), "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def range_violations(df: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Null, NaN and out-of-range counts per column."""
    aggs = []
    for c, (low, high) in ranges.items():
        value = F.col(c).cast("double")
        aggs += [F.sum(value.isNull().cast("int")).alias(f"{c}_null"), F.sum(F.isnan(value).cast("int")).alias(f"{c}_nan"),
                 F.sum(F.coalesce((~F.isnan(value) & ~value.between(low, high)).cast("int"), F.lit(0))).alias(f"{c}_outside")]
    return df.groupBy(*keys).agg(*aggs)


def inversions(df: DataFrame, keys: Sequence[str], order: str, time: str) -> DataFrame:
    """Rows earlier than the row before them."""
    lagged = previous(df, keys, order, {"_t": (F.col(time), 1, None)})
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce((F.col(time) < F.col("_t")).cast("int"), F.lit(0))).alias("inversions"))


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of two numbered tables that differ in any shared column, null-safe."""
    r = right.select(*keys, F.lit(1).alias("_right"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = left.select(*keys, *columns, F.lit(1).alias("_left")).join(r, list(keys), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    matched = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.sum((~matched).cast("int")).alias("unmatched_rows"),
        F.sum((matched & ~same).cast("int")).alias("different_rows")).withColumn(
        "aligned", ((F.col("unmatched_rows") == 0) & (F.col("different_rows") == 0)).cast("int"))


def labels_per_file(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values per file; one label and one class per file is expected."""
    out = df.groupBy(key).agg(*[F.countDistinct(c).alias(f"{c}_values") for c in columns])
    single = F.lit(True)
    for c in columns:
        single = single & (F.col(f"{c}_values") == 1)
    return out.withColumn("single", single.cast("int"))


def class_coverage(df: DataFrame, split: str, label: str) -> DataFrame:
    """Classes each split lacks. The set of classes is small by nature."""
    every = df.agg(F.array_sort(F.collect_set(label))).scalar()
    return df.groupBy(split).agg(F.array_sort(F.collect_set(label)).alias("_have")).withColumn(
        "missing_classes", F.array_join(F.array_except(every, F.col("_have")), ";")).withColumn(
        "classes", F.size("_have")).withColumn("complete", (F.col("missing_classes") == "").cast("int")).drop("_have")
