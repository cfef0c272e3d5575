"""Profile of input files: digest, rows, columns, null cells, duplicate rows and schema differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BLOCK_BYTES = 8 << 20
WHOLE_BYTES = 512 << 20


def _stream_digests(block_bytes: int):
    """Digest of files read block by block inside a task, so that no file has to fit in memory."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            sums = []
            for path in pdf["path"]:
                if path.startswith("file:"):
                    system, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while block := stream.read(block_bytes):
                        digest.update(block)
                sums.append(digest.hexdigest())
            yield pdf.assign(sha256=sums)

    return digests


def file_manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Path, size and SHA-256 of every file, whatever its size.

    Files up to `whole_bytes` are hashed by Spark's own reader, which holds a file as one value and ends at
    2 GB. Larger ones are streamed block by block in a task each; their store must be one that Arrow opens
    (local disk, HDFS, S3, GCS), any other is an error. The listing itself reads no content; as
    in every file source of Spark, empty files have no row.
    """
    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    streamed = large.mapInPandas(_stream_digests(block_bytes), "path string, length bigint, sha256 string")
    return whole.unionByName(streamed).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))


def row_hash(schema: T.StructType, names: Sequence[str]) -> list[Column]:
    """128 bits of a row as two columns; nulls, also inside arrays, count as values of their own."""
    parts = [F.concat_ws("", *[F.isnull(F.col(f"`{c}`")).cast("int").cast("string") for c in names])] if names else []
    for name in names:
        kind, value = schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
            parts += [value, F.transform(value, F.isnull)]
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            parts.append(F.to_json(F.struct(value)))
        else:
            parts.append(value)
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def audit_tables(tables: Mapping[str, DataFrame], required: Sequence[str], key: Column | None = None,
                 ignore: Sequence[str] = ()) -> DataFrame:
    """One row per file of several tables that may differ in their columns.

    `key` names a row's file; by default it is the path of the file it came from. Rows are counted by a hash of
    128 bits, combined inside tasks, so rows meet only as two numbers. Columns are compared as sets of names:
    with the first table's (`same_as_first`), in the order given, and with `required`. A file without rows
    has no row, as no row names it.
    """
    first: set[str] | None = None
    audits = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c not in ignore]
        first = set(columns) if first is None else first
        nulls = reduce(lambda a, b: a + b, [F.isnull(F.col(f"`{c}`")).cast("bigint") for c in columns], F.lit(0))
        one, two = row_hash(df.schema, columns)
        file = F.col("_metadata.file_path") if key is None else key
        hashed = df.select(file.alias("file"), one.alias("_h1"), two.alias("_h2"), nulls.alias("_nulls"))
        counted = hashed.groupBy("file", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.sum("_nulls").alias("_nulls"))
        audits.append(counted.groupBy("file").agg(
            F.sum("_n").alias("rows"), F.sum("_nulls").alias("null_cells"), F.sum(F.col("_n") - 1).alias("duplicate_rows")).select(
            F.lit(name).alias("table"), "file", "rows", F.lit(len(columns)).alias("columns"), "null_cells", "duplicate_rows",
            (100.0 * F.col("duplicate_rows") / F.col("rows")).alias("duplicate_percentage"),
            F.lit(int(set(columns) == first)).alias("same_as_first"),
            F.lit(";".join(sorted(set(required) - set(columns)))).alias("missing_columns"),
            F.lit(";".join(sorted(set(columns) - set(required)))).alias("unexpected_columns")))
    return reduce(DataFrame.unionByName, audits)
