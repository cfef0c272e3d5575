"""Line dedup across documents with levelled sorted runs of line hashes.

Documents come in batches of rising doc_id. The runs hold the hashes of all lines seen so far; a batch
meets them in merge joins: lines it shares with the runs go, the lines that are new are written as a run of
its own. Runs of a level are merged into one of the next level when there are `fan` of them, so a hash is
rewritten once for each level. As ids rise from batch to batch, what is in a run belongs to a smaller id.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from busward.llm.common import BLANKS, ascii_lower, staged

LAST = (1 << 63) - 1
KEY = ["h1", "h2"]


class SortedRuns:
    """Runs of 128-bit hashes in the shared folder, range-sorted, by level; no hash is in two of them."""

    def __init__(self, fan: int = 2):
        self.fan = fan
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, hashes: DataFrame, level: int) -> DataFrame:
        return staged(hashes.repartitionByRange(*KEY).sortWithinPartitions(*KEY), f"run-{level}")

    def add(self, hashes: DataFrame) -> None:
        """Adds distinct hashes that no run holds, and compacts full levels."""
        self.levels[0].append(self._write(hashes, 0))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fan:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(reduce(DataFrame.union, runs), level + 1))
            self.levels[level] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.union, runs) if runs else None


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, h1, h2: the distinct hashes of the keys in each document that are long enough to count.

    A key is the line without blanks at both ends, A-Z lower-cased; keys agree if two 64-bit hashes do.
    """
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _key)
    long_keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    one = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("doc"), F.explode(long_keys).alias("key"))
    return one.select("doc", *_hashes(F.col("key")))


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, runs: SortedRuns | None = None) -> DataFrame:
    """doc, h1, h2 of the lines that a document loses: those whose key a smaller id holds.

    docs has doc_id and text. Null ids come after all others and count as one; rows of equal id keep their
    shared lines together. The batches are ranges of doc_id between approximate quantiles.
    """
    keys = staged(line_keys(docs, min_chars), "line-keys")
    cuts = keys.select("doc").approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    runs, lost = runs or SortedRuns(), []
    for low, high in zip(edges, edges[1:], strict=False):
        batch = keys
        if low is not None:
            batch = batch.filter(F.col("doc") > low)
        if high is not None:
            batch = batch.filter(F.col("doc") <= high)
        held = batch.groupBy(*KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        older = runs.all()
        if older is None:
            marked = held.withColumn("old", F.lit(False))
        else:  # one merge join tells known hashes from new ones
            marked = held.join(older.withColumn("old", F.lit(True)), KEY, "left").withColumn("old", F.coalesce("old", F.lit(False)))
        marked = staged(marked, "batch-hashes")
        shared = marked.filter("old OR first < last").select(*KEY, "first", "old")
        lost.append(batch.join(shared, KEY).filter("old OR doc > first").select("doc", *KEY))
        runs.add(marked.filter("NOT old").select(*KEY))
    return reduce(DataFrame.union, lost)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _stays(own: pd.Series, lost: pd.Series) -> pd.Series:
    """For each line of a document whether it stays; null where the document loses none."""

    def marks(hashes, gone):
        if gone is None:
            return None
        gone = {(x["h1"], x["h2"]) for x in gone}
        return [not (x["counts"] and (x["h1"], x["h2"]) in gone) for x in hashes]

    return pd.Series([marks(h, g) for h, g in zip(own, lost, strict=True)], dtype=object)


def deduplicated(docs: DataFrame, min_chars: int = 10, batches: int = 4, runs: SortedRuns | None = None) -> DataFrame:
    """All rows with kept_text, n_lines and n_dropped.

    A null or empty text is one empty line. Lines whose key has at least min_chars code points and is held
    by a smaller id go, all others stay in order, joined by \\n. runs carries lines of earlier calls, whose
    ids count as smaller. Columns of the input with the names of results are replaced.
    """
    lost = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, runs)
    # The hashes that a document loses are at most its own lines.
    by_doc = lost.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct(*KEY)).alias("_lost"))
    left = docs.drop("kept_text", "n_lines", "n_dropped").withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long"))
    joined = left.join(by_doc, left["_id"] == by_doc["_doc"], "left").drop("_id", "_doc")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    own = F.transform(lines, lambda x: F.struct(*_hashes(_key(x)), (F.length(_key(x)) >= min_chars).alias("counts")))
    marked = joined.withColumn("_stays", _stays(F.when(F.col("_lost").isNotNull(), own), F.col("_lost")))
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get("_stays", i), F.lit(True)))
    return (
        marked.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(F.filter("_stays", lambda s: ~s)), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("_stays").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop("_stays", "_lost")
    )
