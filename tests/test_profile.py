"""Digests and file audits against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from busward.sources import profile


def test_large_files_are_streamed(spark, tmp_path):
    contents = {"a.bin": b"x" * 1_000, "b.bin": bytes(range(256)) * 400, "empty.bin": b"", "c d.bin": b"line\n" * 50_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = profile.file_manifest(spark, str(tmp_path), whole_bytes=1_000, block_bytes=333).collect()
    assert {r["file"].replace("%20", " "): (r["length"], r["sha256"]) for r in got} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items() if d}


def test_audit_of_files(spark, tmp_path):
    rows = [(1, None, [1.0, None]), (1, None, [None, 1.0]), (None, 1, []), (None, 1, []), (1, 2, None), (1, 2, [None]), (1, 2, [None])]
    spark.createDataFrame(rows, "a int, `b.c` int, v array<double>").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, extra string").coalesce(1).write.parquet(f"{tmp_path}/two")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "two")}
    got = {r["table"]: r for r in profile.audit_tables(tables, ["a", "b.c", "v"]).collect()}
    one, two = got["one"], got["two"]
    assert (one["rows"], one["columns"], one["null_cells"], one["duplicate_rows"], one["same_as_first"]) == (7, 3, 5, 2, 1)
    assert (two["rows"], two["columns"], two["null_cells"], two["duplicate_rows"], two["same_as_first"]) == (3, 2, 1, 1, 0)
    assert (two["missing_columns"], two["unexpected_columns"]) == ("b.c;v", "extra")
    assert two["duplicate_percentage"] == pytest.approx(100 / 3)
    assert one["file"].endswith(".parquet")


def test_row_hash_tells_places_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (1, 1)], "a int, b int")
    assert df.select(F.struct(*profile.row_hash(df.schema, df.columns)).alias("h")).distinct().count() == 4
