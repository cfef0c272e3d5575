"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents are posted under each (coordinate, value) of their signature. A pair counts if at least
`matches` of `coordinates` agree, so of the values that anyone shares, ordered from rare to frequent, only
a prefix needs posting (prefix merging): two documents with enough matches meet in both prefixes, and most
documents have no prefix at all. Long lists are skipped through: their members meet one leader, and lists
that are one component then are done with. What is still apart is compared inside blocks of bounded size,
and between the blocks of one family of lists, so that no pair needs a row of its own. Links are confirmed
on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from busward.llm.bits import as_flags, bit_set
from busward.llm.common import running, staged
from busward.llm.components import components
from busward.llm.text import shingle_sets

_SEEDS = np.random.default_rng(20240229)
_XOR = _SEEDS.integers(0, 1 << 32, 256, dtype=np.uint32)
_ODD = _SEEDS.integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """For each of `coordinates` permutations of the lower halves of a set of hashes, the upper half of the one that comes first.

    The minima themselves crowd into a range that shrinks with the set, and would soon agree by chance; upper
    halves are spread over all 32 bits.
    """
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    xor, odd, rows = _XOR[:coordinates, None], _ODD[:coordinates, None], np.arange(coordinates)
    least = value = None
    for at in range(0, len(low), 2048):
        order = low[at : at + 2048] ^ xor
        order *= odd
        first = order.argmin(axis=1)
        best, own = order[rows, first], high[at + first]
        least, value = (best, own) if least is None else (np.minimum(best, least), np.where(best < least, own, value))
    return value.view(np.int32)


def _set_hash(shingles: bytes) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles), np.int64)


def row_hashes() -> tuple[Column, Column]:
    """h1, h2: hashes of id and text, a null apart from an empty one. Rows equal in both are one row to this module."""
    parts = [F.col("doc_id").cast("long"), "text", F.col("doc_id").isNull(), F.col("text").isNull()]
    return F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")


def sketches(docs: DataFrame, shingle_width: int, coordinates: int) -> DataFrame:
    """doc_id, h1, h2, n_shingles, c1, c2 (128-bit hash of the set), sig; sig is null for an empty set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own in shingle_sets(pdf["text"], shingle_width):
                rows.append((len(own), *_set_hash(own.tobytes()), signature(own, coordinates) if len(own) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "c1", "c2", "sig"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy(), h1=pdf["h1"].to_numpy(), h2=pdf["h2"].to_numpy())

    schema = "n_shingles long, c1 long, c2 long, sig array<int>, doc_id string, h1 long, h2 long"
    rows = docs.select(F.col("doc_id").cast("string"), "text", *row_hashes()).mapInPandas(made, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def wanted_sets(docs: DataFrame, shingle_width: int, wanted: bytes, bits: int) -> DataFrame:
    """own, c1, c2: the sorted distinct shingle hashes of a document as bytes, and their hash.

    Documents are left out where the bit of their h1 is not set in `wanted`; so few texts are read twice in
    Python, and none is shuffled.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = as_flags(wanted)
        for pdf in batches:
            pdf = pdf[flags[pdf["h1"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)]]
            own = [x.tobytes() for x in shingle_sets(pdf["text"], shingle_width)]
            hashes = np.array([_set_hash(x) for x in own], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"own": own, "c1": hashes[:, 0], "c2": hashes[:, 1]})

    return docs.select(row_hashes()[0], "text").mapInPandas(made, "own binary, c1 long, c2 long")


#: The bit set has some 16 bits for each posted document, up to 8 MB; when it fills it lets more through.
MOST_BITS = 26


def prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """key, id, n, prefix: the postings that can bring about a pair, and each document's whole prefix."""
    posted = reps.select("id", "n", F.posexplode("sig").alias("at", "value")).select("id", "n", F.xxhash64("at", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = posted.join(shared, "key").groupBy("id", "n").agg(F.collect_list(F.struct("df", "key")).alias("all"))
    cut = own.filter(F.size("all") >= matches).withColumn("prefix", F.slice(F.sort_array("all"), F.lit(1), F.size("all") - matches + 1)["key"])
    return cut.select("id", "n", "prefix", F.explode("prefix").alias("key"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `matches` coordinates and whose sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"), F.col("sig").alias("sig_a"))
    two = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"), F.col("sig").alias("sig_b"))
    collisions = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    joined = pairs.join(one, "a").join(two, "b").filter(collisions >= matches).select("a", "b", "own_a", "own_b")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["own_a"], pdf["own_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                both = int((both[1:] == both[:-1]).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return joined.mapInPandas(linked, "a long, b long")


#: Blocks of a large family that a task compares with as many others at a time, and the most documents of a block.
SIDE, MOST_DOCS = 4, 2048
_BLOCK = ("id", "root", "sig", "own")


def block_links(apart: DataFrame, sets: DataFrame, percent: int, matches: int, block_bytes: int) -> DataFrame:
    """The links (a, b) between documents of different roots that share a list. apart: key, id, root.

    Lists with a common document are a family; links exist inside families only. A block holds whole small
    families, or a part of a family above block_bytes, in the order of roots. A document counts its set, a
    share of block_bytes at least that allows MOST_DOCS. Blocks are compared with themselves, and with the
    blocks of their own large family.
    """
    first = apart.groupBy("key").agg(F.min("id").alias("b"))
    near = components(apart.join(first, "key").select(F.col("id").alias("a"), "b")).withColumnRenamed("root", "family")
    docs = apart.select("id", "root").distinct().join(sets.select("id", "sig", "own"), "id").join(near, F.col("id") == F.col("node")).drop("node")
    weighed = docs.withColumns({"_all": F.lit(0), "_weight": F.greatest(F.octet_length("own"), F.lit(max(1, block_bytes // MOST_DOCS))).cast("long")})
    placed = running(weighed, "_all", [F.col("family"), F.col("root"), F.col("id")], "_weight", "_at", "block-order")
    extent = placed.groupBy("family").agg(F.min("_at").alias("_from"), F.sum("_weight").alias("_total"))
    large, cut = F.col("_total") > block_bytes, lambda x: F.floor(x / block_bytes)
    placed = placed.join(extent, "family").select(
        "id", "root", "sig", "own", large.alias("large"), F.when(large, F.col("family")).otherwise(cut(F.col("_from"))).alias("part"),
        F.when(large, cut(F.col("_at") - F.col("_from"))).otherwise(0).alias("chunk"),
        F.when(large, cut(F.col("_total") - 1)).otherwise(0).alias("last"),
    )
    blocks = placed.groupBy("large", "part", "chunk", "last").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sort_array(F.collect_list(F.struct("id", "root", "sig", "own"))).alias("m"))
    blocks = staged(blocks.filter("large OR low <> high").select("large", "part", "chunk", "last", *[F.col(f"m.{c}").alias(c) for c in _BLOCK]), "blocks")

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["chunk"].to_numpy() // SIDE
        one, two = pdf[side == key[2]], pdf[side == key[3]]
        found = _compared(one, None if key[2] == key[3] else two, percent, matches)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return cells(blocks).groupBy("large", "part", "x", "y").applyInPandas(linked, "a long, b long")


def cells(blocks: DataFrame) -> DataFrame:
    """Each block in every cell (x, y), x <= y, of its own side; a cell holds two sides of SIDE blocks, or one and the same.

    So blocks meet without a join, and the cells of one family lie in all tasks.
    """
    own, other = F.floor(F.col("chunk") / SIDE), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / SIDE)))
    pairs = blocks.select("*", own.alias("_own"), other.alias("_other")).drop("last")
    named = pairs.withColumns({"x": F.least("_own", "_other"), "y": F.greatest("_own", "_other")}).drop("_own", "_other")
    return named.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, "large", "part", "x", "y")


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many coordinates signatures agree, for all pairs; both have a row for each coordinate."""
    out, same = np.zeros((one.shape[1], two.shape[1]), np.uint8), np.empty((one.shape[1], two.shape[1]), bool)
    for x, y in zip(one, two, strict=True):
        np.equal(x[:, None], y, out=same)
        out += same.view(np.uint8)
    return out


def _compared(one: pd.DataFrame, two: pd.DataFrame | None, percent: int, matches: int) -> list[tuple[int, int]]:
    """Links that join different roots, among the documents of one or between those of one and two; a pair already joined is skipped.

    Signatures meet in tiles. What a document shares with all that may be linked to it is looked up in one pass over their sets.
    """
    both = one if two is None else pd.concat([one, two])
    if not (len(one) and len(both) > (two is not None) * len(one)):
        return []
    ids, names = (np.concatenate(both[c].tolist()) for c in ("id", "root"))
    sigs = np.ascontiguousarray(np.stack([x for block in both["sig"] for x in block]).T)
    sets = [np.frombuffer(x, np.uint64) for block in both["own"] for x in block]
    n, sizes, found = sum(map(len, one["id"])), np.array([len(x) for x in sets]), []
    begin, skip = np.concatenate([[0], np.cumsum(sizes)]), 0 if two is None else n
    terms = None
    tile = max(1, (1 << 18) // (len(ids) - skip))
    for low in range(0, n, tile):
        rows, start = slice(low, min(low + tile, n)), max(skip, low)
        near = _agreeing(sigs[:, rows], sigs[:, start:]) >= matches
        least, most = np.minimum(sizes[rows, None], sizes[start:]), np.maximum(sizes[rows, None], sizes[start:])
        near &= (100 * least >= percent * most) & (names[rows, None] != names[start:])
        for i in np.flatnonzero(near.any(axis=1)) + low:
            others = np.flatnonzero(near[i - low]) + start
            others = others[(others > i) & (names[others] != names[i])]
            if not len(others):
                continue
            if terms is None:
                known, terms = np.unique(np.concatenate(sets), return_inverse=True)
                held = np.zeros(len(known), np.int32)
            held[terms[begin[i] : begin[i + 1]]] = 1
            first, last = others[0], others[-1] + 1
            if 2 * sizes[others].sum() > begin[last] - begin[first]:
                shared = np.add.reduceat(held[terms[begin[first] : begin[last]]], begin[first:last] - begin[first])[others - first]
            else:
                shared = np.array([held[terms[begin[j] : begin[j + 1]]].sum() for j in others])
            held[terms[begin[i] : begin[i + 1]]] = 0
            for j in others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)]:
                if names[i] != names[j]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    names[names == max(names[i], names[j])] = min(names[i], names[j])
    return found


def linked_components(reps: DataFrame, docs: DataFrame, shingle_width: int, percent: int, matches: int, block_bytes: int) -> DataFrame:
    """node, root for the representatives that have a link. reps: id, n, c1, c2, sig, h1. docs: doc_id, text of at least these."""
    posts = staged(prefixes(reps, matches), "prefixes")
    # Texts that no list holds drop out by the hash of their set.
    alive = staged(posts.select("id").distinct().join(reps.select("id", "c1", "c2", "sig", "h1"), "id"), "posted")
    bits = min(MOST_BITS, max(16, alive.count().bit_length() + 4))
    read = wanted_sets(docs, shingle_width, bit_set(alive, F.col("h1"), bits), bits)
    sets = staged(read.join(alive.drop("h1"), ["c1", "c2"]).dropDuplicates(["id"]), "sets")
    lead = posts.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    similar = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    star = posts.select("key", "id", "n").join(lead, "key").filter((F.col("id") != F.col("lead.id")) & similar)
    star = star.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    links = staged(confirmed(star, sets, percent, matches), "links")
    labels = components(links).withColumnRenamed("node", "_node")
    rooted = posts.join(labels, F.col("id") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "id"))
    # Lists of one component have nothing left to find.
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    apart = staged(rooted.join(mixed, "key", "left_semi"), "apart")
    return components(links.union(block_links(apart, sets, percent, matches, block_bytes)))


def classes_and_roots(docs: DataFrame, shingle_width: int, percent: int, coordinates: int, matches: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(sketch, classes): one row for each row of docs; and c1, c2, id, first_id, h1, h2, root for each distinct non-empty set.

    id numbers the sets by their smallest doc_id (null last), so the smallest number of a component, its root,
    has the smallest doc_id; first_id, h1 and h2 are of the row that stands for the set. Several sets may have one smallest doc_id.
    """
    sketch = staged(sketches(docs, shingle_width, coordinates), "sketches")
    known = sketch.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")).alias("first")
    # Plain columns pass through Python at a fraction of a struct's memory; as text an id may be null there.
    plain = ["c1", "c2", "first.unnamed", F.col("first.doc_id").cast("string").alias("named"), "first.h1", "first.h2", F.lit(0).alias("one")]
    sets = known.groupBy("c1", "c2").agg(first).select(*plain)
    order = [F.col("unnamed"), F.col("named").cast("long"), F.col("c1"), F.col("c2")]
    numbered = running(sets, "one", order, None, "id", "set-order")
    classes = staged(numbered.select("c1", "c2", "id", F.col("named").cast("long").alias("first_id"), "h1", "h2"), "classes")
    own = classes.select("id", "h1", "h2")
    reps = known.join(own, ["h1", "h2"]).dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("n"), "c1", "c2", "sig", "h1")
    roots = linked_components(staged(reps, "reps"), docs, shingle_width, percent, matches, block_bytes)
    rooted = classes.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    return sketch, staged(rooted, "rooted")


SETTINGS = {"shingle_width": 5, "percent": 75, "coordinates": 64, "matches": 30, "block_bytes": 1 << 20}


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text). settings replace those of SETTINGS.

    Two documents are linked if their sets of `shingle_width`-word shingles have a Jaccard index of percent / 100 or
    more; a text with fewer words is one shingle. Null, empty and blank texts have no shingle and no link.
    component_id is the smallest id reachable, kept marks it. Equal sets are one class, so copies cost one
    row each. A pair at the limit has 48 of 64 matches on average and is missed below 30, about four times
    in ten million. Repeated rows are alike. Where rows of one id have different texts, each is linked by its own
    text. Rows without an id get no component and are kept; links may lead over them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch, classes = classes_and_roots(docs, **(SETTINGS | settings))
    names = classes.select(F.col("id").alias("root"), F.col("first_id").alias("component_id"))
    at = classes.select("c1", "c2", "root").join(names, "root").drop("root")
    out = sketch.select("doc_id", "n_shingles", "c1", "c2").join(at, ["c1", "c2"], "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """All columns of docs; one row of each group stays, that of the smallest doc_id.

    Every row counts by its own id and text, whether ids repeat or are null; rows equal in both are one row.
    Rows without a shingle have no group and stay.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch, classes = classes_and_roots(texts, **(SETTINGS | settings))
    stays = classes.filter("id = root").select("h1", "h2").union(sketch.filter("n_shingles = 0").select("h1", "h2")).distinct()
    h1, h2 = row_hashes()
    hashed = docs.withColumns({"_h1": h1, "_h2": h2})
    kept = hashed.join(stays, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left_semi")
    return kept.dropDuplicates(["_h1", "_h2"]).select(*docs.columns)
