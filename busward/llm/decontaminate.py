"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, so that a question with other numbers or names has the
template of the original. Windows of template tokens are hash-joined; along near diagonals of a document and
an item they are put together, and the values of near slots must correspond consistently, which tells a re-parameterised question from prose
that merely has numbers in like places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from busward.llm.common import staged
from busward.llm.text import windows

# Units by kind of quantity, matched after lower-casing; the symbols may also follow a number directly.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml cl l liter liters litre litres gallon gallons cup cups "
    "ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph km/h m/s % percent $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents ° °c °f degree degrees".split()
)
NUMBER, UNIT, NAME = b"<number>", b"<unit>", b"<name>"
_EDGES = ".,;:!?\"'()[]{}«»“”‘’…"
_CURRENCY = "$€£¥"
FILTER_BITS = 22


def _is_number(word: str) -> bool:
    body = word.lstrip("+-").rstrip("%")
    return bool(body) and body[0].isdigit() and body.replace(",", "").replace(".", "").replace("/", "").replace(":", "").isdigit()


class Canon:
    """Template token, value, slot flag and sentence end of words, learned as they come.

    A capitalised word is a name unless it starts a sentence or is capitalised throughout; so words have one
    number where they open a sentence and one elsewhere. All words are forgotten when the tables are full.
    """

    def __init__(self, limit: int = 100_000):
        self.limit = 0
        self.reserve(limit)

    def reserve(self, n: int) -> None:
        """Room for n more words."""
        if self.limit and len(self.ends) + n <= self.limit:
            return
        self.limit = max(self.limit, n)
        self.opening: dict[str, int] = {}
        self.inside: dict[str, int] = {}
        self.ends: list[bool] = []
        self.token, self.value, self.slot = np.zeros(self.limit, np.uint64), np.zeros(self.limit, np.uint64), np.zeros(self.limit, bool)

    def learn(self, word: str, opens: bool) -> int:
        core = word.strip(_EDGES)
        value = core.lower()
        raw = value.encode("utf-8", "surrogatepass")
        if _is_number(core.strip(_CURRENCY)):
            token = NUMBER
        elif value in UNITS and len(value) > 1 or value in ("%", *_CURRENCY):
            token = UNIT
        elif not opens and core[:1].isupper() and not core.isupper():
            token = NAME
        else:
            token = raw
        at = len(self.ends)
        self.ends.append(word[-1:] in ".!?…:" or word[-2:-1] in ".!?")
        self.token[at], self.value[at] = xxhash.xxh3_64_intdigest(token), xxhash.xxh3_64_intdigest(raw)
        self.slot[at] = token in (NUMBER, UNIT, NAME)
        (self.opening if opens else self.inside)[word] = at
        return at

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes, value hashes and slot flags of a text's words; line ends end sentences."""
        lines = [line.split() for line in text.split("\n")]
        self.reserve(sum(map(len, lines)))
        opening, inside, ends, found = self.opening, self.inside, self.ends, []
        for line in lines:
            table = opening
            for word in line:
                at = table.get(word)
                if at is None:
                    at = self.learn(word, table is opening)
                found.append(at)
                table = opening if ends[at] else inside
        at = np.array(found, np.int64)
        return self.token[at], self.value[at], self.slot[at]


def _windows(tokens: np.ndarray, values: np.ndarray, slots: np.ndarray, wide: int, literal: int) -> np.ndarray:
    """A hash of each window of `wide` words: of its template if at least `literal` words are not placeholders, else of its words."""
    fixed = np.concatenate([[0], np.cumsum(~slots)])
    told = fixed[wide:] - fixed[:-wide] >= min(literal, wide)
    hashes = windows(tokens, wide)
    return hashes if told.all() else np.where(told, hashes, ~windows(values, wide))


def _slot_values(values: np.ndarray, slots: np.ndarray, at: int, width: int) -> list[tuple[int, int]]:
    """(offset, value hash) of the placeholders in a window."""
    return [(int(k), int(values[at + k].view(np.int64))) for k in np.flatnonzero(slots[at : at + width])]


WINDOW = "id string, window long, wide int, at int, total int, slots array<struct<k:int,v:long>>"


def template_windows(df: DataFrame, widths: list[int], literal: int, wanted: bytes | None = None) -> DataFrame:
    """id, window (hash), wide (its words), at, total (windows of that width) and slots of each window of id, text.

    Windows have each of the widths; a text with fewer words has one window of all its words. With `wanted`,
    a bit set over the top bits of window hashes, only windows whose bit is set are returned.
    """
    bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for pdf in batches:
            rows = []
            for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                if not text:
                    continue
                tokens, values, slots = canon.tokens(text)
                for wide in sorted({min(w, len(tokens)) for w in widths} - {0}):
                    hashes = _windows(tokens, values, slots, wide, literal)
                    at = np.arange(len(hashes)) if bits is None else np.flatnonzero(bits[hashes >> np.uint64(64 - FILTER_BITS)])
                    found = zip(hashes[at].view(np.int64).tolist(), at.tolist(), strict=True)
                    rows += [(id_, h, wide, p, len(hashes), _slot_values(values, slots, p, wide)) for h, p in found]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "window", "wide", "at", "total", "slots"])

    return df.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(made, WINDOW)


def judged(lines: list[tuple], wide: int, total: int, percent: int, run: int) -> tuple[int, int, int, int, bool]:
    """n_windows, n_item_windows, n_slots, n_changed, contaminated of the best chain of one document and item.

    lines: (diagonal, window positions in the item in order, and of the slots the positions in the item, the
    item's values and the document's). A chain holds neighbouring diagonals, each at most the item's words
    from the next, so words put in or left out do not part it. Two slots within a window's reach conflict if
    one value of the item stands for two of the document; words in windows with such a slot are not covered.
    """
    n_words = total + wide - 1
    chains, last = [], None
    for line in sorted(lines, key=lambda x: x[0]):
        if last is None or line[0] - last > n_words:
            chains.append([])
        chains[-1].append(line)
        last = line[0]
    best = None
    for chain in chains:
        covered, met, seen, longest = np.zeros(n_words, bool), set(), set(), 0
        for diagonal, at, places, theirs, mine in chain:
            at = np.asarray(at, np.int64)
            order = sorted(zip(places, theirs, mine, strict=True))
            conflict, changed = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
            recent: dict[int, list[tuple[int, int]]] = {}
            for place, value, other in order:
                changed[place + 1] |= value != other
                near = recent[value] = [s for s in recent.get(value, []) if place - s[0] < wide]
                for s in near:
                    if s[1] != other:
                        conflict[[s[0] + 1, place + 1]] = 1
                near.append((place, other))
            inside = lambda marks: (sums := np.cumsum(marks))[at + wide] > sums[at]  # noqa: E731, B023
            bad, own = inside(conflict), np.zeros(n_words, bool)
            for marks, value in ((at[~bad], True), (at[bad], False)):
                own[(marks[:, None] + np.arange(wide)).ravel()] = value
            covered |= own
            same = at[~inside(changed)]
            if len(same):
                breaks = np.flatnonzero(np.diff(same) > 1)
                starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(same) - 1]])
                longest = max(longest, int((same[ends] - same[starts]).max()) + wide)
            met.update(at.tolist())
            seen.update((diagonal, *s) for s in order)
        bad = bool(int(covered.sum()) * 100 >= n_words * percent or longest >= run)
        key = (bad, len(met), chain[-1][0])
        if best is None or key > best[0]:
            best = key, (len(met), total, len({s[1:] for s in seen}), len({s[1:] for s in seen if s[2] != s[3]}), bad)
    return best[1]


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, percent: int = 50, run: int = 14) -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows, n_slots, n_changed, contaminated for each pair that shares windows.

    docs: doc_id, text; benchmark: item_id, text. A window with fewer than `literal` words that are not
    placeholders stands for its very words instead of its template. An item of fewer than `width` words is one
    window, and of fewer than `literal` found only where it is a whole text. The windows that a document and
    an item share are taken along their best chain of neighbouring diagonals (near equal distance of
    positions). contaminated: they cover at least percent of the item's words, or `run` words in a row are
    the very words of the item. Words near slots in which, within a window's reach, one value of the item
    stands for several of the document are not covered. Where no window of `width` words is left whole, as in
    an item of 15 words whose middle one is replaced, nothing is found. n_changed counts slots with another value. Null and empty texts, and texts
    without windows, share nothing; equal texts under several ids are pairs of their own, and repeated rows
    of one id count once. Rows without an id are left out.
    """
    items = benchmark.select(F.col("item_id").alias("id"), "text").filter("id IS NOT NULL").distinct()
    asked = staged(template_windows(items, [width], literal), "benchmark-windows")
    # At most `width` numbers.
    widths = sorted({width, *(r["wide"] for r in asked.select("wide").distinct().collect() if r["wide"] >= literal)})
    # A bit for each of 2^22 hash ranges: this filter has one size, whatever the benchmark's.
    bit = F.shiftrightunsigned("window", 64 - FILTER_BITS)
    mask = F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))
    marked = asked.groupBy(F.shiftright(bit, 3).cast("int").alias("byte")).agg(F.bit_or(mask).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    table[marked["byte"].to_numpy(np.int64)] = marked["bits"].to_numpy(np.uint8)
    given = docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL")
    found = template_windows(given, widths, literal, table.tobytes())
    left = found.select(F.col("id").alias("doc"), "window", F.col("at").alias("p"), F.col("slots").alias("mine"))
    right = asked.select(F.col("id").alias("item"), "window", "wide", F.col("at").alias("q"), "total", F.col("slots").alias("theirs"))
    pairs = F.transform("theirs", lambda s, i: F.struct((F.col("q") + s["k"]).alias("at"), s["v"].alias("theirs"), F.get("mine", i)["v"].alias("mine")))
    met = left.join(right, "window").withColumn("pairs", pairs)
    diagonals = met.groupBy("doc", "item", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.max("wide").alias("wide"), F.max("total").alias("total"), F.array_sort(F.collect_set("q")).alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("slots")
    )
    shared = diagonals.groupBy("doc", "item").agg(
        F.max("wide").alias("wide"), F.max("total").alias("total"), F.collect_list(F.struct("diagonal", "at", F.col("slots.at").alias("places"), F.col("slots.theirs").alias("theirs"), F.col("slots.mine").alias("mine"))).alias("lines")
    )

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (int(doc), int(item), *judged([tuple(x.values()) for x in found], wide, total, percent, run))
                for doc, item, wide, total, found in pdf.itertuples(index=False, name=None)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_windows", "n_item_windows", "n_slots", "n_changed", "contaminated"])

    out = "doc_id long, item_id long, n_windows long, n_item_windows long, n_slots long, n_changed long, contaminated boolean"
    return shared.mapInPandas(made, out)


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs without a contaminated pair; rows without an id stay."""
    bad = leaks(docs.select("doc_id", "text"), benchmark, **settings).filter("contaminated").select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leak"], "left_anti")
