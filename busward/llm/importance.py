"""Importance resampling towards a target distribution, with hashed word-run features.

Features are runs of consecutive words, hashed by CRC-32 into buckets. A bucket's gain is the log ratio of its
smoothed shares in the target and in all documents; a document's weight is the mean gain of its features, and
documents are drawn by weight plus a Gumbel number that only their id decides (drawing without replacement).

Hashing is split by frequency. Words that are frequent over all documents are broadcast with their exact CRC
states, frequent pairs with the state of the whole pair, in tables of a fixed number of entries of bounded
length; a longer run goes on from the state of its front. All other features are hashed directly. Both give
the same CRC, so bucket totals are exact whatever the tables hold; the tables only save time.

Defined results: null and empty texts have no features and weight 0; a null doc_id is hashed as an empty one
and comes last among equal scores; repeated rows are documents of their own; an empty target has equal shares
in all buckets; empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from busward.llm.common import running, staged
from busward.llm.text import terms_of

#: Entries of each broadcast table, and bytes of a feature in one.
HEAD, HEAD_BYTES = 1 << 16, 64
#: Features that a task counts for the tables before it lets go of the rarer half.
COUNTED = 1 << 18
#: Words that are hashed at a time, of a text of any length.
PIECE = 1 << 16


class States(dict):
    """CRC-32 of a feature: frequent ones from the table, all others computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Hasher:
    """CRC-32 of all runs of 1 to max_words words of a text."""

    def __init__(self, frequent: list[bytes], max_words: int):
        self.words = States((w, zlib.crc32(w)) for w in frequent if b" " not in w)
        self.pairs = {tuple(w.split(b" ")): zlib.crc32(w) for w in frequent if b" " in w}
        self.max_words = max_words

    def runs(self, words: list[bytes]) -> list[int]:
        state = list(map(self.words.__getitem__, words))
        out = state
        for length in range(2, min(self.max_words, len(words)) + 1):
            last = words[length - 1 :]
            if length == 2:
                known = map(self.pairs.get, zip(words, last, strict=False))
                state = [zlib.crc32(b" " + w, s) if k is None else k for k, w, s in zip(known, last, state, strict=False)]
            else:
                state = [zlib.crc32(b" " + w, s) for w, s in zip(last, state, strict=False)]
            out = out + state
        return out

    def pieces(self, text: bytes, buckets: int) -> Iterator[np.ndarray]:
        """Buckets of all features of a text, in pieces of bounded length."""
        words = terms_of(text)
        whole = max(PIECE, self.max_words)
        if len(words) <= whole:
            yield np.array(self.runs(words), np.int64) % buckets
            return
        for at in range(0, len(words), whole):  # a run belongs to the piece of its first word
            end = min(at + whole, len(words))
            joined = self.runs(words[at : end + self.max_words - 1])
            n = min(len(words), end + self.max_words - 1) - at
            keep, low = [], 0
            for length in range(1, self.max_words + 1):
                keep.append(np.array(joined[low : low + min(end - at, n - length + 1)], np.int64))
                low += max(0, n - length + 1)
            yield np.concatenate(keep) % buckets


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_py() or b""


def frequent_features(texts: DataFrame, max_words: int, size: int = HEAD) -> list[bytes]:
    """The most frequent words, and for max_words > 1 pairs, of at most HEAD_BYTES bytes: at most `size` of each.

    Each task counts all its features and lets go of the rarer half when it holds too many; the counts of
    tasks are added by Spark. Which features are found has no effect on any result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter(), Counter()]
        for batch in batches:
            for text in _texts(batch, 0):
                words = terms_of(text)
                found[0].update(words)
                if max_words > 1:
                    found[1].update(zip(words, islice(words, 1, None), strict=False))
                for i, counts in enumerate(found):
                    if len(counts) > COUNTED:
                        found[i] = Counter(dict(counts.most_common(COUNTED // 2)))
        for counts in found:
            top = [(w if isinstance(w, bytes) else b" ".join(w), n) for w, n in counts.most_common(size)]
            top = [(w, n) for w, n in top if len(w) <= HEAD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["feature", "n"])

    sums = texts.select("text").mapInArrow(counted, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    pair = F.locate(" ", F.decode("feature", "ISO-8859-1")) > 0
    # A step of the scale of counts is taken whole or not at all, so no sort is needed and `size` holds.
    sums = staged(sums.select("feature", pair.alias("pair"), F.floor(8 * F.log2("n")).cast("int").alias("step")), "frequent")
    steps = sums.groupBy("pair", "step").agg(F.count("*").alias("n")).collect()
    out = []
    for kind in (False, True):
        room, low = size, None
        for step, n in sorted(((r["step"], r["n"]) for r in steps if r["pair"] == kind), reverse=True):
            room -= n
            if room < 0:
                break
            low = step
        if low is not None:
            out += [bytes(r["feature"]) for r in sums.filter((F.col("pair") == kind) & (F.col("step") >= low)).collect()]
    return out


def bucket_totals(texts: DataFrame, hasher: Hasher, buckets: int) -> np.ndarray:
    """Exact number of features in each bucket, over all texts: one count for each bucket reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                for piece in hasher.pieces(text, buckets):
                    total += np.bincount(piece, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), in doubles, for each bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, hasher: Hasher, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain) of each row."""

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = [], [], []
            for text in _texts(batch, 1):
                n_words.append(len(terms_of(text)))
                pieces = [(len(p), int(gain[p].sum())) for p in hasher.pieces(text, len(gain))]
                n.append(sum(x for x, _ in pieces))
                total.append(sum(x for _, x in pieces))
            weight = [t // k if k else 0 for t, k in zip(total, n, strict=True)]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, *, max_words: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024, head: int = HEAD
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text); target has text.

    Of the N rows with at least min_words words the floor(percent * N / 100) highest scores are drawn and
    ranked from 1, ties by rising doc_id; all others have no rank. Other columns are not read.
    """
    hasher = Hasher(frequent_features(docs, max_words, head), max_words)
    gain = gains(bucket_totals(docs, hasher, buckets), bucket_totals(target, hasher, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = staged(weighed(docs, hasher, gain).withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("one", F.lit(0)), "weights")
    able = F.col("n_words") >= min_words
    quota = rows.filter(able).count() * percent // 100
    placed = running(rows.filter(able), "one", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], None, "before", "drawn")
    drawn = placed.select("*", F.when(F.col("before") < quota, F.col("before") + 1).cast("long").alias("rank"))
    others = rows.filter(~able).withColumn("rank", F.lit(None).cast(T.LongType()))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).union(others.select(*names))
