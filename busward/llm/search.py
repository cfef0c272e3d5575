"""Ranked lexical search: a stated set of items against every document, as blocked matrix products.

Items are cut into blocks of a bounded number of (item, term) pairs. The distinct terms of a block are its
compact vocabulary. One pass over the whole texts counts them in each document; document frequencies follow
from these counts. A second pass turns the counts into impacts, lays them out as dense float64 tiles of
documents x vocabulary, and multiplies them with tiles of items x vocabulary by BLAS. Every partial sum of a
product stays below 2^53, so products are exact and are added up as 64-bit integers. Each task keeps the best
k documents of each item by (score, smallest doc_id), and these lists are merged in two rounds.

Defined results: a null or empty text has no terms and is no result; a null doc_id ranks behind all others of
its score; rows that share a doc_id are documents of their own; rows that share an item_id are items of their
own, each with its list; an item without terms, or with none that scores, has no rows; empty tables give none.
An item's terms are held together, so an item's own distinct terms must fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from busward.llm.common import ascii_lower, running, staged
from busward.llm.text import terms_of

#: Maximal runs of these characters are terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) pairs of a block, besides those of its last item; an item counts as LEAST_PAIRS at least.
BLOCK_PAIRS, LEAST_PAIRS = 1 << 18, 64
#: Rows and columns of tiles.
DOC_TILE, TERM_TILE, ITEM_TILE = 1024, 1024, 256
#: An impact is below this.
IMPACT_LIMIT = 1_000_000
#: A cell of an item tile; larger ones are spread over more columns of the same term. TERM_TILE products then stay below 2^53.
CELL_LIMIT = (1 << 53) // (IMPACT_LIMIT * TERM_TILE) - 1
#: First-round lists of an item.
LISTS = 64

COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, doc_id long, score long"


@dataclass
class Asked:
    """The items of a block as sparse rows: columns ascend by term, `value` is query count x term weight."""

    items: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    terms: np.ndarray


def term_counts(vocabulary: dict[bytes, int]):
    """Task function: (doc_id, text) to (doc_id, number of terms, vocabulary terms held, their counts)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, counts, offsets = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                found = terms_of(text.as_py() or b"")
                ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
                term, tf = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(found))
                held.append(term)
                counts.append(tf.astype(np.int32))
                offsets.append(offsets[-1] + len(term))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return counted


def asked_rows(pairs: pd.DataFrame, weight: np.ndarray) -> Asked:
    """Items x columns; pairs has item, term (number) and q, weight is by term. Cells above CELL_LIMIT are spread."""
    items, row = np.unique(pairs["item"].to_numpy(np.int64), return_inverse=True)
    term = pairs["term"].to_numpy(np.int64)
    value = pairs["q"].to_numpy(np.int64) * weight[term]
    row, term, value = row[value > 0], term[value > 0], value[value > 0]
    spread = np.maximum(1, -(-value // CELL_LIMIT))
    wide = np.ones(len(weight), np.int64)
    np.maximum.at(wide, term, spread)
    first = np.concatenate([[0], np.cumsum(wide)])
    part = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
    left = np.repeat(value, spread) - part * CELL_LIMIT
    return Asked(items, np.repeat(row, spread), np.repeat(first[term], spread) + part, np.minimum(left, CELL_LIMIT), np.repeat(np.arange(len(weight)), wide))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """tf and n (terms of the document) in 64-bit integers, n_docs documents with n_terms terms in all."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The best k documents of each item so far, by falling score, then named before unnamed, then rising id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.id = np.full((items, k), np.iinfo(np.int64).max)
        self.unnamed = np.ones((items, k), bool)

    def add(self, start: int, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """scores: items from `start` on x documents. Only what can enter a list is sorted; ties at its end count."""
        rows = slice(start, start + len(scores))
        last = self.score[rows, -1:]
        item, doc = np.nonzero((scores > last) | ((scores == last) & (scores > 0) & (ids <= self.id[rows, -1:])))
        if not len(item):
            return
        changed = np.unique(item)
        item = np.concatenate([item, np.repeat(changed, self.k)])
        score = np.concatenate([scores[item[: len(doc)], doc], self.score[rows][changed].ravel()])
        id_ = np.concatenate([ids[doc], self.id[rows][changed].ravel()])
        none = np.concatenate([unnamed[doc], self.unnamed[rows][changed].ravel()])
        order = np.lexsort((id_, none, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order, place = order[place < self.k], place[place < self.k]
        at = (start + item[order], place)
        self.score[at], self.id[at], self.unnamed[at] = score[order], id_[order], none[order]


def tiles(asked: Asked) -> list[tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each tile of columns their terms, and the item tiles with a cell in it: start, rows, and the cells (row, column, value)."""
    order = np.lexsort((asked.row // ITEM_TILE, asked.column // TERM_TILE))
    key = (asked.column // TERM_TILE * (1 + len(asked.items) // ITEM_TILE) + asked.row // ITEM_TILE)[order]
    out = [(asked.terms[low : low + TERM_TILE], []) for low in range(0, len(asked.terms), TERM_TILE)]
    for own in np.split(order, np.flatnonzero(np.diff(key)) + 1) if len(order) else []:
        tile, start = asked.column[own[0]] // TERM_TILE, asked.row[own[0]] // ITEM_TILE * ITEM_TILE
        size = min(ITEM_TILE, len(asked.items) - start)
        out[tile][1].append((start, size, asked.row[own] - start, asked.column[own] - tile * TERM_TILE, asked.value[own]))
    return out


def tile_scores(cut: list, n_items: int, term: np.ndarray, impact: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Items x documents of a tile, from its postings (term, impact, doc) sorted by term; cut is of `tiles`."""
    total = np.zeros((n_items, n_docs), np.int64)
    for columns, cells in cut:
        first = columns[0]
        a, b = np.searchsorted(term, [first, columns[-1] + 1])
        if a == b:
            continue
        dense = np.zeros((columns[-1] - first + 1, n_docs))
        dense[term[a:b] - first, doc[a:b]] = impact[a:b]
        if len(dense) != len(columns):
            dense = dense[columns - first]
        for start, size, row, column, value in cells:
            weights = np.zeros((size, len(columns)))
            weights[row, column] = value
            total[start : start + size] += (weights @ dense).astype(np.int64)
    return total


def best_documents(asked: Asked, n_docs: int, n_terms: int, k: int):
    """Task function: counted documents to the best k of each item in this task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cut = Best(len(asked.items), k), tiles(asked)
        for batch in batches:
            for at in range(0, len(batch), DOC_TILE):
                tile = batch.slice(at, DOC_TILE)
                unnamed = np.asarray(tile.column(0).is_null())
                ids = tile.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                terms, tfs = tile.column(2), tile.column(3)
                doc = np.repeat(np.arange(len(tile)), np.diff(terms.offsets.to_numpy()))
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
                impact = impacts(tf, tile.column(1).to_numpy()[doc], n_docs, n_terms)
                order = np.argsort(term, kind="stable")
                scores = tile_scores(cut, len(asked.items), term[order], impact[order], doc[order], len(tile))
                for start in range(0, len(scores), ITEM_TILE):
                    best.add(start, scores[start : start + ITEM_TILE], ids, unnamed)
        item, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked.items[item]), pa.array(best.id[item, place], mask=best.unnamed[item, place]), pa.array(best.score[item, place])],
            names=["item", "doc_id", "score"],
        )

    return search


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 20, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties to the smaller doc_id.

    docs has doc_id (integer) and text, items item_id and text; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    pairs = asked.select("item", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    pairs = staged(pairs.groupBy("item", "term").agg(F.count("*").alias("q")), "pairs")
    sizes = pairs.groupBy("item").agg(F.greatest(F.count("*"), F.lit(LEAST_PAIRS)).alias("size")).withColumn("one", F.lit(0))
    placed = staged(running(sizes, "one", [F.col("item")], "size", "before", "placed").select("item", F.floor(F.col("before") / block_pairs).cast("long").alias("block")), "blocks")
    blocks = [r["block"] for r in placed.select("block").distinct().sort("block").collect()]
    found = []
    for block in blocks:
        own = pairs.join(placed.filter(F.col("block") == block), "item").select("item", "term", "q").toPandas()
        names = sorted(x.encode() for x in own["term"].unique())
        number = {term: i for i, term in enumerate(names)}
        counted = staged(texts.mapInArrow(term_counts(number), COUNTED), "counted")
        total = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
        df = np.zeros(len(names), np.int64)
        df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        own["term"] = [number[x.encode()] for x in own["term"]]
        found.append(counted.mapInArrow(best_documents(asked_rows(own, weight), total["docs"], total["terms"], k), FOUND))
    if not found:
        return spark.createDataFrame([], T.StructType([asked.schema["item_id"], *T._parse_datatype_string("rank int, doc_id long, score long").fields]))
    lists = staged(reduce(DataFrame.union, found).withColumn("list", F.pmod(F.spark_partition_id(), F.lit(LISTS))), "lists")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = lists.withColumn("rank", F.row_number().over(W.partitionBy("item", "list").orderBy(*order))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return last.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
