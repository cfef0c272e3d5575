"""Sharding by best-fit-decreasing bin packing, in two levels.

Level 1 runs in parallel: each task takes its groups in falling size and puts each into the open cell with
the tightest room for it. Level 2 packs the cells, at most a few for each of 65 536 and one more for each
task, in the same way into shards. Both find the tightest bin in a balanced tree of remaining capacities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from busward.llm.common import running, staged

CELLS = 1 << 16


class Rooms:
    """Remaining capacities of bins in an AA tree; keys are (room, bin), all distinct."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    # A node is a list: key, level, left, right.
    @staticmethod
    def _skew(node):
        left = node[2]
        if left and left[1] == node[1]:
            node[2], left[3] = left[3], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[3]
        if right and right[3] and right[3][1] == node[1]:
            node[3], right[2] = right[2], node
            right[1] += 1
            return right
        return node

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, 1, None, None]
            side = 2 if key < node[0] else 3
            node[side] = put(node[side])
            return self._split(self._skew(node))

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node, key):
            if node is None:
                return None
            if key != node[0]:
                side = 2 if key < node[0] else 3
                node[side] = cut(node[side], key)
            elif node[2] is None and node[3] is None:
                return None
            else:
                side, other = (3, 2) if node[2] is None else (2, 3)
                near = node[side]
                while near[other]:
                    near = near[other]
                node[0] = near[0]
                node[side] = cut(node[side], near[0])
            level = min(node[2][1] if node[2] else 0, node[3][1] if node[3] else 0) + 1
            if level < node[1]:
                node[1] = level
                if node[3] and node[3][1] > level:
                    node[3][1] = level
            node = self._skew(node)
            if node[3]:
                node[3] = self._skew(node[3])
                if node[3][3]:
                    node[3][3] = self._skew(node[3][3])
            node = self._split(node)
            if node[3]:
                node[3] = self._split(node[3])
            return node

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (room, bin) with room for `size`."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


class Packer:
    """Best fit for sizes that come in falling order. A size above the capacity gets a bin of its own."""

    def __init__(self, capacity: int, most: int | None = None):
        self.capacity, self.most, self.bins, self.rooms = capacity, most, 0, Rooms()

    def place(self, size: int) -> int | None:
        """The bin of the next item; None if it would need more bins than allowed."""
        found = self.rooms.tightest(size)
        if found:
            self.rooms.remove(found)
            room, bin_ = found
        elif self.bins == self.most:
            return None
        else:
            room, bin_ = max(self.capacity, size), self.bins
            self.bins += 1
        if room > size:
            self.rooms.add((room - size, bin_))
        return bin_


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Shards of items in falling size: items of at least the mean of what is left get a shard of their own,
    the others go by best fit into the smallest capacity for which the remaining shards suffice."""
    out, at, left = [], 0, sum(sizes)
    while at < len(sizes) and shards - at > 1 and sizes[at] * (shards - at) >= left:
        out.append(at)
        left -= sizes[at]
        at += 1
    rest, bins = sizes[at:], shards - at
    if not rest:
        return out

    def trial(capacity: int) -> list[int] | None:
        packer, placed = Packer(capacity, bins), []
        for size in rest:
            bin_ = packer.place(size)
            if bin_ is None:
                return None
            placed.append(bin_)
        return placed

    low = max(-(-left // bins), rest[0])
    high, best = low, trial(low)
    while best is None:
        low, high = high, high + max(1, high // 16)
        best = trial(high)
    while high - low > max(1, low >> 12):
        middle = (low + high) // 2
        found = trial(middle)
        low, high, best = (low, middle, found) if found is not None else (middle, high, best)
    return out + [at + b for b in best]


def sharded(df: DataFrame, group: str, size: str, shards: int | None = None, capacity: int | None = None, slot_order: list[str] | None = None) -> DataFrame:
    """Adds shard (int, from 0) and, if slot_order is given, slot (gapless from 0 in each shard).

    group: a non-null column; rows that share it stay together. size: a positive long.
    Either `shards` of sizes near equal, or as few shards of `capacity` as the method finds. A group above
    the capacity (or above the mean) gets a shard of its own. An empty table has no shards.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    spark = df.sparkSession
    groups = df.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_bytes"))
    (total,) = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()
    wanted = shards or max(1, -(-total // capacity))
    parts = min(256, max(1, CELLS // wanted))
    room = max(1, (capacity or -(-total // wanted)) // parts)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(room)
        for pdf in batches:
            yield pdf.assign(_local=[packer.place(int(b)) for b in pdf["_bytes"]])

    ordered = groups.sortWithinPartitions(F.desc("_bytes"), "_group").select("*", F.spark_partition_id().alias("_task"))
    placed = staged(ordered.mapInPandas(cells, f"{ordered.schema.simpleString()[7:-1]},_local long"), "groups")
    # At most 2 * CELLS cells are over half full, and each task leaves one more at most.
    sums = sorted(placed.groupBy("_task", "_local").agg(F.sum("_bytes").alias("n")).collect(), key=lambda r: (-r["n"], r["_task"], r["_local"]))
    sizes = [r["n"] for r in sums]
    if shards:
        bins = pack_into(sizes, shards)
    else:
        packer = Packer(capacity)
        bins = [packer.place(s) for s in sizes]
    plan = spark.createDataFrame([(r["_task"], r["_local"], b) for r, b in zip(sums, bins, strict=True)], "_task int, _local long, shard int")
    where = placed.join(F.broadcast(plan), ["_task", "_local"]).select("_group", "shard")
    out = df.drop("shard", "slot").join(where, df[group] == where["_group"]).drop("_group")
    return running(out, "shard", [F.col(c) for c in slot_order], None, "slot", "shards") if slot_order else out


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of documents, and a key that equal texts share.

    Texts count as equal if their SHA-256 agree; a null text has size 1, no checksum and its own key.
    """
    text = F.encode("text", "UTF-8")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("text_key"),
    )
