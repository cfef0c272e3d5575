"""Shared folders, staged tables and running sums that no single key can overload."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

#: The characters between words (Spark's trim and translate take them as a set).
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of texts that go to a Python worker at once; 10,000 whole texts, Spark's own bound, take over 100 MB on both sides.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; with a local master, as in tests, a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, unless the cluster's settings do."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    bounded_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def words(text):
    """Words of a text column, in order; none for null or blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def n_words(text):
    """Number of words without building them: each starts at the text's start or after a blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, key: str, order: list, value: str | None, name: str, stage: str, row_id: str | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` (1 if None) over the rows of the same key that come before, in `order`.

    key is a non-null integer column. Rows are dealt by range of (key, order), so a hot key spreads over
    many tasks; each task sums its sorted rows batch by batch, and sums of tasks before are added from a
    table with one row for each task and key. order must decide, else equal rows are ranked arbitrarily
    among themselves. row_id names a further column with a number that tells all rows apart.
    """
    spark = df.sparkSession
    by = [F.col(key), *order]
    dealt = df.repartitionByRange(width(spark), *by).sortWithinPartitions(*by)
    dealt = dealt.select("*", F.spark_partition_id().alias("_task"))
    out = T.StructType([*dealt.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_own", T.LongType()), T.StructField("_at", T.LongType())])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, at_row = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf[value].to_numpy(np.int64) if value else np.ones(len(pdf), np.int64)
            keys = pdf[key].to_numpy(np.int64)
            before = np.concatenate([[0], np.cumsum(own)])
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
            local = before[:-1] - before[at]
            if keys[0] == last:
                local[at == 0] += total
            last, total = keys[-1], int(local[-1] + own[-1])
            yield pdf.assign(_local=local, _own=own, _at=np.arange(at_row, at_row + len(pdf)))
            at_row += len(pdf)

    rows = staged(dealt.mapInPandas(sums, out), stage)
    tasks = rows.groupBy(F.col(key).alias("_key"), "_task").agg(F.sum("_own").alias("_sum"))
    before = W.partitionBy("_key").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select("_key", F.col("_task").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(tasks, (rows[key] == tasks["_key"]) & (rows["_task"] == tasks["_of"]))
    extra = [(F.col("_task").cast("long") * (1 << 36) + F.col("_at")).alias(row_id)] if row_id else []
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name), *extra)
