"""A bit set over hash ranges: a filter of one size that only lets more through as it fills."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def bit_set(rows: DataFrame, value: Column, bits: int) -> bytes:
    """2^bits bits, set for the top bits of each non-null long. At most 2^(bits - 3) numbers reach the driver."""
    bit = F.shiftrightunsigned(value, 64 - bits)
    mask = F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))
    marked = rows.filter(value.isNotNull()).groupBy(F.shiftright(bit, 3).cast("int").alias("byte")).agg(F.bit_or(mask).alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[marked["byte"].to_numpy(np.int64)] = marked["bits"].to_numpy(np.uint8)
    return table.tobytes()


def as_flags(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
