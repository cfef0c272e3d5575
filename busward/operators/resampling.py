"""Bootstrap and sign-flip sums of all replicates at once, from blocks of units.

A key's units lie in hash order and are cut into blocks. A task holds one block and works on all or a range of
the replicates of it; what leaves is an array with a sum for each, so units times replicates are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from busward.functions.columns import digest_number
from busward.operators.ordering import number_by_hash

#: Units of a block; signs and draws that are in memory at a time; draws of one piece of work.
BLOCK, AT_ONCE, TILE, PIECE = 4096, 1 << 20, 1 << 16, 1 << 22
#: Blocks of a key from which on it is not cut into fewer pieces, so that keys of many blocks share theirs; keys that are
#: worked on together; numbers of sums that a task holds before it hands them on.
MOST_PIECES, TOGETHER, HELD = 8, 128, 1 << 22
#: Replicates of sign flips whose sums are added up at a time.
FLIPS = 12_500
#: Up to so many units all sign patterns are counted.
EXACT_UNITS = 40
#: The prime and the round constants of `draw_numbers`.
PRIME, ROUNDS = (1 << 31) - 1, (715_225_739, 1_618_033_988, 271_828_182)


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """Brings x nearer to its remainder by PRIME: the high bits are added to the low ones, as 2^31 is 1."""
    np.right_shift(x, 31, out=high)
    x &= PRIME
    x += high


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below PRIME: fifth powers with constants between.

    Numbers stay below 2^64 and are folded only as far as the next product needs.
    """
    x = np.array(x, np.uint64)
    y, high = np.empty_like(x), np.empty_like(x)
    for constant in ROUNDS:
        x += constant
        np.multiply(x, x, out=y)
        _fold(y, high)
        _fold(y, high)
        y *= y
        _fold(y, high)
        x *= y
        _fold(x, high)
        _fold(x, high)
    return np.minimum(x, x - np.uint64(PRIME)).view(np.int64)


def draw_numbers(seed: int, block: int, replicate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A number below PRIME for each (replicate, draw) of a block; other engines can rebuild it from whole numbers."""
    return _scrambled((_scrambled((seed + replicate) % PRIME) + draw + block * BLOCK) % PRIME)


def block_counts(n: int, block: int, replicates: int, seed: Sequence[int], size: int | None = None) -> np.ndarray:
    """How many of the n draws of each replicate fall into a block of BLOCK (or `size`) units (the last may be shorter).

    Together the blocks' counts are multinomial: a binomial draw parts the draws of a range of blocks between
    its halves, from the range's own seed, so every task that walks down to its block sees the same splits.
    """
    size = size or BLOCK
    low, high = 0, -(-n // size)
    counts = np.full(replicates, n, np.int64)
    units = lambda a, b: min(b * size, n) - a * size
    while high - low > 1:
        middle = (low + high) // 2
        dice = np.random.Generator(np.random.Philox(np.random.SeedSequence([*seed, low, high])))
        left = dice.binomial(counts, units(low, middle) / units(low, high))
        if block < middle:
            counts, high = left, middle
        else:
            counts, low = counts - left, middle
    return counts


def block_sums(values: np.ndarray, n: int, block: int, replicates: int, seed: int, key: int) -> np.ndarray:
    """For each replicate the sum of what its draws take from the block's values."""
    return drawn_sums(values[None], block_counts(n, block, replicates, (seed, key))[None], 0, block * BLOCK, seed)[0]


def drawn_sums(values: np.ndarray, counts: np.ndarray, first: int, start: int, seed: int) -> np.ndarray:
    """For each key (a row of values and counts) the sums of the replicates from `first` on, of which replicate i takes
    counts[key, i] draws from the block that begins at `start`.

    The draws of a replicate do not depend on the key. So they are made once, and how often each unit is drawn is counted
    once, for the middle of the keys' counts; a product of matrices gives all keys' sums, to which the few draws are added or
    taken away that a key has more or less. Values that are not finite would spoil other replicates' products; they are drawn singly.
    """
    out, (keys, units) = np.zeros(counts.shape), values.shape
    finite = np.isfinite(values).all(axis=1)
    flat, taken = values.ravel(), np.where(finite[:, None], values, 0.0).T
    step = max(1, TILE // max(1, int(counts.max(initial=0))))
    for at in range(0, counts.shape[1], step):
        own = counts[:, at : at + step]
        rows, most = own.shape[1], int(own.max())
        replicate = _scrambled((seed + first + at + np.arange(rows)) % PRIME)
        drawn = _scrambled((replicate[:, None] + np.arange(start, start + most)) % PRIME).astype(np.uint32)
        drawn -= drawn // np.uint32(units) * np.uint32(units)
        middle = np.sort(own, axis=0)[keys // 2]
        cells, least = drawn + (np.arange(rows) * units)[:, None], int(middle.min())
        late = cells[:, least:][np.arange(least, most) < middle[:, None]]
        often = np.bincount(np.concatenate([cells[:, :least].ravel(), late]), minlength=rows * units).reshape(rows, units)
        out[:, at : at + step] = (often.astype(np.float64) @ taken).T
        base = np.where(finite[:, None], middle, 0)
        if (more := np.abs(own - base).ravel()).any():
            which = np.repeat(np.arange(keys * rows), more)
            draw = np.arange(len(which)) + np.repeat(np.minimum(own, base).ravel() - (np.cumsum(more) - more), more)
            found = flat[which // rows * units + drawn[which % rows, draw]]
            out[:, at : at + step] += np.bincount(which, np.where((own < base).ravel()[which], -found, found), keys * rows).reshape(keys, rows)
    return out


def flip_sums(values: np.ndarray, block: int, replicates: int, seed: int, key: int) -> np.ndarray:
    """For each replicate the sum of the block's values with random signs, 64 replicates from one random long a unit."""
    dice = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, key, block])))
    out = []
    step = max(64, AT_ONCE // max(1, len(values)) // 64 * 64)
    for at in range(0, replicates, step):
        longs = dice.integers(0, 1 << 64, (len(values), -(-min(step, replicates - at) // 64)), np.uint64, endpoint=False)
        bits = np.unpackbits(longs.view(np.uint8), axis=1)[:, : min(step, replicates - at)]
        out.append(values.sum() - 2 * (values @ bits))
    return np.concatenate(out)


def exact_flips(values: np.ndarray) -> tuple[int, int]:
    """Of all 2^n sign patterns, how many means reach the observed one: in absolute value, and as it is.

    All sums of one half of the units meet the sorted sums of the other; tolerance 1e-12 of the mean.
    """
    halves = []
    for part in (values[: len(values) // 2], values[len(values) // 2 :]):
        sums = np.zeros(1)
        for v in part:
            sums = np.concatenate([sums - v, sums + v])
        halves.append(np.sort(sums))
    total, slack = float(values.sum()), 1e-12 * len(values)

    def reaching(least: float) -> int:
        return int((len(halves[1]) - np.searchsorted(halves[1], least - halves[0], side="left")).sum())

    # The distribution is symmetric, so as many sums lie below the negative limit.
    two = reaching(abs(total) - slack) * 2 if abs(total) > slack else 1 << len(values)
    return two, reaching(total - slack)


def blocks(units: DataFrame, keys: Sequence[str], unit: str, value: str, seed: int) -> DataFrame:
    """keys, _n, _key (a number for the key), _block, _values: the units of each key in hash order, in blocks."""
    keys = list(keys)
    rows = units.where(F.col(value).isNotNull()).select(*keys, unit, F.col(value).cast("double").alias(value))
    numbered = number_by_hash(rows, keys, digest_number(seed, "unit", F.col(unit).cast("string")), [unit], "_slot")
    cut = numbered.groupBy(*keys, F.floor(F.col("_slot") / BLOCK).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_slot", value))).alias("_rows"))
    size = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    name = digest_number(seed, "key", *[F.col(k).cast("string") for k in keys])
    return cut.join(size, keys).select(*keys, "_n", name.alias("_key"), "_block", F.col(f"_rows.{value}").alias("_values"))


def spread(work: DataFrame, by: Sequence[Column | str], order: Sequence[str] = ()) -> DataFrame:
    """Few rows that each stand for much work, over several tasks a core; sized by their bytes they would all meet in one task."""
    out = work.repartition(4 * work.sparkSession.sparkContext.defaultParallelism, *by)
    return out.sortWithinPartitions(*order) if order else out


def added_parts(work: DataFrame, keys: Sequence[str], sums) -> DataFrame:
    """keys, _part, _sums: `sums(rows)` gives (row, part, array) triples for the rows of a task; the arrays of a key and part are added up.

    Arrays, not single numbers, are shuffled, and those that a task holds of a key and part are added before. Then a task
    adds the blocks of a hundred parts at a time, so no group grows with the units.
    """
    keys = list(keys)
    schema = T.StructType([*[work.schema[k] for k in keys], T.StructField("_part", T.LongType()), T.StructField("_over", T.LongType()),
                           T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def given() -> Iterator[pd.DataFrame]:
            for (_, part, over), (row, array) in held.items():
                yield pd.DataFrame({**{k: [row[k]] for k in keys}, "_part": [part], "_over": [over], "_sums": [array]})
            held.clear()

        for row, part, array in sums(row for pdf in batches for _, row in pdf.iterrows()):
            name = (int(row["_key"]), *[row[k] for k in keys]), part, int(row["_block"]) // 128
            if name in held:
                held[name][1][:] += array
            else:
                held[name] = row, array.copy()
                if sum(len(x) for _, x in held.values()) > HELD:
                    yield from given()
        yield from given()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(_sums=[np.sum(np.stack(pdf["_sums"].tolist()), axis=0)])

    once = work.mapInPandas(each, schema).groupBy(*keys, "_part", "_over").applyInPandas(added, schema)
    return once.groupBy(*keys, "_part").applyInPandas(added, schema).select(*keys, "_part", "_sums")


def replicate_sums(cut: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """keys, _n, replicate, total: the sums of all replicates' draws, added up over the blocks of a key.

    Work is cut by blocks and, where a key has few, by ranges of replicates. The rows of one block and range lie in one
    task, one after the other, and are worked on together, TOGETHER keys at a time; only keys of few units, whose draws
    cost little, are spread over four tasks.
    """
    keys, size = list(keys), BLOCK
    blocks_of = F.least(F.ceil(F.col("_n") / size), F.lit(MOST_PIECES))
    pieces = F.greatest(F.lit(1), F.ceil(F.least(F.col("_n"), F.lit(size)) * replicates / PIECE / blocks_of)).cast("bigint")
    work = cut.withColumns({"_pieces": pieces, "_units": F.size("_values")}).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)))
    order = ["_block", "_pieces", "_piece", "_units"]

    def sums(rows: Iterator[pd.Series]) -> Iterator[tuple[pd.Series, int, np.ndarray]]:
        for (block, pieces, piece, _), same in groupby(rows, key=lambda row: tuple(int(row[c]) for c in order)):
            low, high = (replicates * (piece + i) // pieces for i in (0, 1))
            while some := list(islice(same, TOGETHER)):
                counts = np.stack([block_counts(int(row["_n"]), block, replicates, (seed, int(row["_key"])), size)[low:high] for row in some])
                values = np.stack([np.asarray(row["_values"], float) for row in some])
                for row, array in zip(some, drawn_sums(values, counts, low, block * size, seed), strict=True):
                    yield row, low, array

    few = F.when(F.col("_n") <= size // 4, F.pmod("_key", F.lit(4)))
    total = added_parts(spread(work, [*order, few], order), [*keys, "_n"], sums)
    return total.select(*keys, "_n", "_part", F.posexplode("_sums").alias("_at", "total")).select(
        *keys, "_n", (F.col("_part") + F.col("_at")).alias("replicate"), "total")


def counted_flips(cut: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """keys, _two, _one, _of: sign patterns that reach the observed mean, of all patterns up to EXACT_UNITS units and of
    `replicates` random ones beyond (which count the observed pattern once more)."""
    keys = list(keys)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [exact_flips(np.asarray(v, float)) for v in pdf["_values"]]
            yield pdf[keys].assign(_two=[float(a) for a, _ in found], _one=[float(b) for _, b in found], _of=np.exp2(pdf["_n"].to_numpy(float)))

    def signed(rows: Iterator[pd.Series]) -> Iterator[tuple[pd.Series, int, np.ndarray]]:
        for row in rows:
            sums = flip_sums(np.asarray(row["_values"], float), int(row["_block"]), replicates, seed, int(row["_key"]))
            for at in range(0, replicates, FLIPS):
                yield row, at, sums[at : at + FLIPS]

    schema = T.StructType([*[cut.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in ("_two", "_one", "_of")]])
    cut = spread(cut, ["_key", F.pmod("_block", F.lit(8))], ["_key"])
    small = cut.where(F.col("_n") <= EXACT_UNITS).mapInPandas(exact, schema)
    large = cut.where(F.col("_n") > EXACT_UNITS)
    total = large.groupBy(*keys).agg(F.sum(F.aggregate("_values", F.lit(0.0), lambda a, x: a + x)).alias("_sum"), F.first("_n").alias("_n"))
    sums = added_parts(large, keys, signed).join(total, keys)
    n, observed = F.col("_n"), F.col("_sum") / F.col("_n")
    two = F.size(F.filter("_sums", lambda x: F.abs(x / n) >= F.abs(observed) - 1e-12))
    one = F.size(F.filter("_sums", lambda x: x / n >= observed - 1e-12))
    random = sums.groupBy(*keys).agg((F.sum(two) + 1.0).alias("_two"), (F.sum(one) + 1.0).alias("_one"), F.lit(replicates + 1.0).alias("_of"))
    return small.unionByName(random)
