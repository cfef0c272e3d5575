"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each position i, the sum of code[j] * BASE^j over j < i modulo 2^61 - 1.
Two spans are equal if the differences of their prefix values agree after scaling both to the same power, so
any span of any two texts is compared in constant time, and the longest common extension of two positions is
found by binary search over its length.

A fingerprint keeps the length, the hash of the whole text read forwards and backwards, and the prefix values
at up to MARKS marks a power of two apart, from the front and from the end. Marks of two fingerprints lie on a
common grid, so spans between marks are compared as above: the likeness of two texts is the share of the
longer one that is covered by common extensions between marks, found by binary search from each mark where
the texts agree anew. It is exact for texts of up to MARKS code points and short of at most one step
(1/32 of a text at 64 marks) at each end of a common span. Equal texts have equal fingerprints; different ones
differ but for a hash collision of both directions (2^-122 for texts not built against BASE).

Defined results: a null text counts as an empty one; two empty texts have likeness 1, an empty and another 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from busward.llm.common import width

PRIME = (1 << 61) - 1
#: Any odd number without structure will do.
BASE = 0x1F3D5B79A2C4E681 % PRIME
MARKS = 64
#: Common spans inside texts count from this length on; shorter ones agree by chance. Those at an end always count.
LEAST_SPAN = 8
#: Code points hashed at a time.
PIECE = 1 << 16

_P = np.uint64(PRIME)
_U = {n: np.uint64(n) for n in (29, 30, 31, 32, 61)}
_LOW = {n: np.uint64((1 << n) - 1) for n in (29, 30, 31, 32)}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 to BASE^(PIECE - 1) in two parts: high bits and the lowest 30."""
    out = np.zeros(PIECE, np.uint64)
    value = 1
    for i in range(PIECE):
        out[i] = value
        value = value * BASE % PRIME
    return out >> _U[30], out & _LOW[30]


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _folded(values: np.ndarray) -> np.ndarray:
    """Values below 2^63 modulo PRIME."""
    values = (values & _P) + (values >> _U[61])
    return np.where(values >= _P, values - _P, values)


def _local(codes: np.ndarray) -> np.ndarray:
    """Prefix values after each of at most PIECE code points, from power 0 on."""
    if not _POWERS:
        _POWERS.append(_powers())
    high, low = (part[: len(codes)] for part in _POWERS[0])
    upper = codes * high  # times 2^30, and 2^61 is 1
    term = (upper >> _U[31]) + ((upper & _LOW[31]) << _U[30]) + codes * low
    upper, lower = np.cumsum(term >> _U[32]), np.cumsum(term & _LOW[32])
    return _folded((upper >> _U[29]) + ((upper & _LOW[29]) << _U[32]) + lower)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def prefix_values(codes: np.ndarray, step: int) -> tuple[list[int], int]:
    """Prefix values at 0, step, 2 step, ... and at the end; memory is bounded by PIECE."""
    marks, carry = [0], 0
    for start in range(0, len(codes), PIECE):
        own = _local(codes[start : start + PIECE])
        scale = pow(BASE, start, PRIME)
        first = -(start + 1) % step
        marks += [(carry + scale * v) % PRIME for v in own[first::step].tolist()]
        carry = (carry + scale * int(own[-1])) % PRIME
    return marks, carry


class Prefixes:
    """The whole prefix array of one text, for any span of it. A code point takes 8 bytes."""

    def __init__(self, text: str):
        codes = code_points(text)
        parts, carry = [np.zeros(1, object)], 0
        for start in range(0, len(codes), PIECE):
            own, scale = _local(codes[start : start + PIECE]).tolist(), pow(BASE, start, PRIME)
            parts.append(np.array([(carry + scale * v) % PRIME for v in own], np.uint64))
            carry = int(parts[-1][-1])
        self.values = np.concatenate([p.astype(np.uint64) for p in parts])

    def __len__(self) -> int:
        return len(self.values) - 1

    def span(self, start: int, end: int) -> int:
        """Hash of a span, times BASE^start."""
        return (int(self.values[end]) - int(self.values[start])) % PRIME

    def same(self, start: int, end: int, other: Prefixes, at: int) -> bool:
        """Whether the span equals that of the same length in the other text from `at` on."""
        if end - start > len(other) - at:
            return False
        one, two = self.span(start, end), other.span(at, at + end - start)
        return (one * pow(BASE, max(0, at - start), PRIME) - two * pow(BASE, max(0, start - at), PRIME)) % PRIME == 0

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension of the two positions, by binary search."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, start + middle, other, at):
                low = middle
            else:
                high = middle - 1
        return low


class Fingerprint:
    """Length, whole hashes, and marks from the front and from the end."""

    def __init__(self, text: str, marks: int = MARKS):
        codes = code_points(text)
        self.n, self.step = len(codes), _step(len(codes), marks)
        self.front, self.forward = prefix_values(codes, self.step)
        self.back, self.backward = prefix_values(codes[::-1], self.step)

    def __str__(self) -> str:
        """length : both whole hashes in hex : marks as base64 of 8 bytes each, front then end."""
        packed = [base64.b64encode(np.array(x[1:], ">u8").tobytes()).decode() for x in (self.front, self.back)]
        return f"{self.n}:{self.forward:016x}{self.backward:016x}:{packed[0]}:{packed[1]}"

    @classmethod
    def parse(cls, text: str, marks: int = MARKS) -> Fingerprint:
        out = cls.__new__(cls)
        n, whole, *packed = text.split(":")
        out.n, out.step = int(n), _step(int(n), marks)
        out.forward, out.backward = int(whole[:16], 16), int(whole[16:], 16)
        out.front, out.back = ([0, *np.frombuffer(base64.b64decode(x), ">u8").tolist()] for x in packed)
        return out

    def likeness(self, other: Fingerprint, least: int = LEAST_SPAN) -> float:
        """Share of the longer text that common spans between marks cover, from 0 to 1."""
        if (self.n, self.forward, self.backward) == (other.n, other.forward, other.backward):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        step = max(self.step, other.step)
        grid = lambda marks, own: marks[:: step // own]
        front = _common(grid(self.front, self.step), grid(other.front, other.step), step, least)
        back = _common(grid(self.back, self.step), grid(other.back, other.step), step, least)
        covered = min(_union(front + [(n - b, n - a) for a, b in back]) for n in (self.n, other.n))
        return covered / max(self.n, other.n)


def _step(n: int, marks: int) -> int:
    """The smallest power of two that gives at most `marks` marks."""
    return 1 << max(0, (max(n - 1, 0) // marks).bit_length())


def _common(one: list[int], two: list[int], step: int, least: int) -> list[tuple[int, int]]:
    """Spans of positions in which both texts agree, by longest common extensions between marks."""
    last, at, out = min(len(one), len(two)) - 1, 0, []
    while at < last:
        low, high = at, last
        while low < high:
            middle = (low + high + 1) // 2
            if (one[middle] - one[at] - two[middle] + two[at]) % PRIME == 0:
                low = middle
            else:
                high = middle - 1
        if low > at and (at == 0 or (low - at) * step >= least):
            out.append((at * step, low * step))
        at = low + 1
    return out


def _union(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def fingerprints(docs: DataFrame, marks: int = MARKS) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of docs (doc_id, text); other columns are not read."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Fingerprint(text.as_py() or "", marks) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.n for f in found], pa.int64()), pa.array([str(f) for f in found])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(printed, "doc_id long, n_chars long, fingerprint string")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """pair, length: for rows of pair (a key), one, at, two, other_at the longest common extension of position `at`
    of text `one` and `other_at` of `two`. Null texts are empty; a null position is 0; one outside its text gives 0."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                one, two = Prefixes(row["one"] or ""), Prefixes(row["two"] or "")
                at, other_at = row["at"] or 0, row["other_at"] or 0
                inside = 0 <= at <= len(one) and 0 <= other_at <= len(two)
                out.append(one.extension(at, two, other_at) if inside else 0)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(out, pa.int64())], names=["pair", "length"])

    return pairs.select("pair", "one", F.col("at").cast("long"), "two", F.col("other_at").cast("long")).mapInArrow(extended, f"pair {pairs.schema['pair'].dataType.simpleString()}, length long")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, part, guest: rows dealt by range of falling doc_id, each range followed by its successor's first rows.

    Ranges lie between approximate quantiles of doc_id, null as the smallest. The rows of the highest id of a
    range are guests in the range before it (those of the first range in the last), so a task that sorts a
    range sees the next row of each of its own rows. Rows of one id stay in one range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [F.lit(i / ranges) for i in range(1, ranges)]
    (cuts,) = rows.agg(F.percentile_approx("doc_id", F.array(*shares), F.lit(10 * ranges))).first() if shares else (None,)
    cuts = sorted(set(cuts or []))
    # Cuts are looked up in two levels, so a row is compared with twice the root of their number.
    leap = max(1, int(len(cuts) ** 0.5))
    if cuts:
        every, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[leap - 1 :: leap]))
        skipped = leap * F.size(F.filter(coarse, lambda c: c < F.col("doc_id")))
        part = skipped + F.size(F.filter(F.slice(every, skipped + 1, leap), lambda c: c < F.col("doc_id")))
        part = F.when(F.col("doc_id").isNull(), -1).otherwise(part)
    else:
        part = F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    rows = rows.withColumn("part", part.cast("int"))
    # One row for each range: its highest id, and the range that comes before it in falling order.
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    above = F.lead("part").over(W.orderBy("part"))
    tops = tops.withColumn("host", F.coalesce(above, F.min("part").over(W.partitionBy()))).withColumnRenamed("part", "_part")
    held = rows.join(F.broadcast(tops), F.col("part") == F.col("_part"))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    as_guest = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, as_guest)).otherwise(F.array(own))
    return held.select("doc_id", "text", F.explode(places).alias("_place")).select("doc_id", "text", "_place.*")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_with_next(docs: DataFrame, marks: int = MARKS) -> DataFrame:
    """Each row of docs (doc_id, text) beside its edited text and its next document, in falling order of doc_id.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or all) of
    the next document; after the last row comes the first. Rows of equal id follow by rising text, a null id is
    the smallest. Returns doc_id, n_chars, edited_sha256 (UTF-8), both fingerprints, and the likeness of the
    fingerprint to the edited text's and to the next document's. Each text is shuffled once.
    """
    tasks = width(docs.sparkSession)
    placed = in_ranges(docs, 4 * tasks).repartition(tasks, "part")
    text = F.coalesce("text", F.lit(""))
    dealt = placed.select("doc_id", text.alias("text"), "part", "guest").sortWithinPartitions(F.col("part").desc(), "guest", F.col("doc_id").desc_nulls_last(), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # doc_id, text, part and fingerprint of the row whose next one comes now
        for batch in batches:
            out = []
            for doc_id, text, part, guest in zip(*batch.columns, strict=True):
                doc_id, text, part, guest = doc_id.as_py(), text.as_py(), part.as_py(), guest.as_py()
                if guest and before is None:
                    continue
                own = Fingerprint(text, marks)
                if before is not None:
                    old_id, old, _, first = before
                    half = first.n // 2
                    edited = old[: first.n - half] + text[:half]
                    changed = Fingerprint(edited, marks)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old_id, first.n, digest, str(first), str(changed), first.likeness(changed), first.likeness(own)))
                before = None if guest else (doc_id, text, part, own)
            names = [x.split()[0] for x in EDITED.split(", ")]
            types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            columns = [pa.array([row[i] for row in out], types[x.split()[1]]) for i, x in enumerate(EDITED.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(compared, EDITED)
