"""Lexical search, importance resampling and fingerprints against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from busward.llm import importance, search
from busward.llm.fingerprints import PIECE, Fingerprint, Prefixes, common_extensions, compared_with_next, fingerprints, in_ranges, prefix_values
from busward.llm.importance import Hasher, frequent_features, resampled
from busward.llm.search import Best, asked_rows, ranked, tile_scores, tiles

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, item string, n long, rank int, term string, score double, part int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lowered(text))


def corpus(n=300, seed=3):
    dice = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(200)] + ["Élan", "größe", "日本", "x y", "a\x85b", "İ", "ſ"]
    rows = []
    for i in range(n):
        words = [dice.choice(vocabulary[: dice.choice([3, 20, 207])]) for _ in range(dice.randrange(0, 60))]
        rows.append((i, "".join(w + dice.choice([" ", "\n", "-", "_", "…", "\t!"]) for w in words)))
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(60)] + [(None, same), (None, same), (None, None), (7, same), (2000, ""), (2001, None), (2002, "W1 " * 70_000 + "Élan")]
    dice.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "t", 0.5, 3) for i, t in rows], DOCS).repartition(5)


ITEMS = [(1, "W1 w2 w2 Élan"), (2, "w3-W4, größe 日本"), (3, "nothing-here"), (4, None), (5, ""), (5, "w1 w5"), (5, "w1 w5"), (None, "W9 w1"), (9, " ".join(f"w{i}" for i in range(200)))]


def plain_ranked(rows, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, counts, n in held:
            m = 75 + 25 * n * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block", [(20, search.BLOCK_PAIRS), (3, 130)])
def test_search(spark, k, block, monkeypatch):
    monkeypatch.setattr(search, "DOC_TILE", 64)
    rows = corpus()
    got = ranked(table(spark, rows), spark.createDataFrame([(*x, 9, "c") for x in ITEMS], "item_id long, text string, rank int, terms string"), k=k, block_pairs=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranked(rows, ITEMS, k)


def test_search_of_empty_tables(spark):
    none, items = table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(none, items).count() == 0 and ranked(table(spark, [(1, None), (2, "--")]), items).count() == 0
    assert ranked(table(spark, corpus(10)), items.limit(0)).count() == 0


def test_products_stay_exact(monkeypatch):
    """Large weights, repeated terms and more columns than a tile: equal to integer arithmetic."""
    monkeypatch.setattr(search, "TERM_TILE", 8)
    monkeypatch.setattr(search, "ITEM_TILE", 2)
    dice = np.random.default_rng(1)
    weight = dice.integers(0, 30_000, 50)
    pairs = pd.DataFrame([(i, t, int(dice.choice([1, 2, 900, 400_000]))) for i in (3, 4, 9, 11, 20) for t in sorted(dice.choice(50, 30, replace=False))], columns=["item", "term", "q"])
    asked = asked_rows(pairs, weight)
    assert asked.value.max() <= search.CELL_LIMIT and len(asked.terms) > 50
    doc = np.repeat(np.arange(6), 20)
    term = np.concatenate([np.sort(dice.choice(50, 20, replace=False)) for _ in range(6)])
    impact = dice.integers(1, search.IMPACT_LIMIT, len(term))
    order = np.argsort(term, kind="stable")
    got = tile_scores(tiles(asked), 5, term[order], impact[order], doc[order], 6)
    want = [[sum(q * int(weight[t]) * int(impact[(doc == d) & (term == t)].sum()) for i, t, q in pairs.itertuples(index=False) if i == item) for d in range(6)] for item in (3, 4, 9, 11, 20)]
    assert got.tolist() == want
    assert search.CELL_LIMIT * 1024 * search.IMPACT_LIMIT < 1 << 53


def test_lists_keep_ties_by_id():
    dice = random.Random(4)
    best, seen = Best(3, 5), [[], [], []]
    for _ in range(40):
        ids = np.array([dice.randrange(1000) for _ in range(7)])
        scores = np.array([[dice.randrange(4) for _ in range(7)] for _ in range(3)])
        best.add(0, scores, ids, np.zeros(7, bool))
        for i in range(3):
            seen[i] += [(-s, d) for s, d in zip(scores[i].tolist(), ids.tolist(), strict=True) if s]
    for i in range(3):
        assert [(-s, d) for s, d in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)] == sorted(seen[i])[:5]


def plain_resampled(rows, target, max_words, min_words, percent):
    def features(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 1000 for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]

    source, goal = Counter(), Counter()
    for _, t in rows:
        source.update(features(t))
    for t in target:
        goal.update(features(t))
    s_all, t_all = sum(source.values()) + 1000, sum(goal.values()) + 1000
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in source}
    scored = []
    for i, t in rows:
        f = features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(terms(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    quota = percent * len(able) // 100
    return sorted([(*r, n + 1 if n < quota else None) for n, r in enumerate(able)] + [(*r, None) for r in scored if r[1] < min_words], key=str)


@pytest.mark.parametrize("max_words, head", [(1, 50), (1, 0), (2, 50), (3, 30)])
def test_resampling(spark, max_words, head, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 1000)
    rows, target = corpus(), ["W1 w2 w3", None, "", "Élan größe w1 w9 w10"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n_features int")
    got = resampled(table(spark, rows), goal, max_words=max_words, buckets=1000, min_words=5, percent=25, head=head)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampled(rows, target, max_words, 5, 25)


def test_resampling_of_empty_tables(spark):
    goal = spark.createDataFrame([("w1",)], "text string")
    assert resampled(table(spark, []), goal).count() == 0
    rows = [(1, "a b"), (2, None)]
    got = resampled(table(spark, rows), goal.limit(0), buckets=1000, min_words=2, percent=50).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampled(rows, [], 1, 2, 50)


def test_tables_of_frequent_features(spark):
    """The tables hold the most frequent words and pairs, whole steps of the scale of counts, up to their size."""
    texts = spark.createDataFrame([("a b a b a b c",)] * 20 + [("rare word " + "x" * 100,)], "text string").repartition(3)
    assert frequent_features(texts, 1, 2) == [b"a", b"b"] or set(frequent_features(texts, 1, 2)) == {b"a", b"b"}
    assert set(frequent_features(texts, 2, 3)) == {b"a", b"b", b"c", b"a b", b"b a", b"b c"}
    assert frequent_features(texts, 2, 0) == []
    words = [f"w{i % 7}".encode() for i in range(25)]
    for n in (1, 2, 3, 4):
        want = [zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        assert Hasher([b"w1", b"w2", b"w1 w2"], n).runs(words) == want


def plain_next(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = Fingerprint(text), Fingerprint(edited), Fingerprint(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_fingerprints_beside_the_next(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for rows in (corpus(), [(i * i, f"text {i}") for i in range(40)], [(None, "only null ids"), (None, "two of them"), (None, None)], [(1, "single 😀 row")], [(1, "a"), (1, "b"), (1, "b"), (1, None)], []):
            got = compared_with_next(table(spark, rows)).collect()
            assert sorted(map(tuple, got), key=str) == plain_next(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ranges_spread(spark):
    rows = table(spark, [(i, "t") for i in range(4000)])
    sizes = [r["count"] for r in in_ranges(rows, 16).filter("NOT guest").groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_prefix_hashes():
    dice = random.Random(8)
    text = "".join(dice.choice("abé日😀") for _ in range(2 * PIECE + 77))
    shifted = "xyz" + text[5:PIECE] + "!" + text[PIECE:]
    one, two = Prefixes(text), Prefixes(shifted)
    assert one.span(0, len(text)) == sum(ord(c) * pow(0x1F3D5B79A2C4E681, j, (1 << 61) - 1) for j, c in enumerate(text)) % ((1 << 61) - 1)
    for step in (1, 64, 5000, 1 << 17):
        marks, end = prefix_values(np.array([ord(c) for c in text], np.uint64), step)
        assert marks == [int(one.values[i]) for i in range(0, len(text) + 1, step)] and end == int(one.values[-1])
    assert one.extension(5, two, 3) == PIECE - 5 and one.extension(PIECE, two, PIECE - 1) == len(text) - PIECE
    for _ in range(300):
        a, b, n = dice.randrange(200), dice.randrange(200), dice.randrange(4)
        assert one.same(a, a + n, two, b) == (text[a : a + n] == shifted[b : b + n])
        want = next((k for k in range(500) if text[a + k] != shifted[b + k]), 500)
        assert min(one.extension(a, two, b), 500) == want
    assert not one.same(len(text) - 3, len(text), two, len(two) - 2)


def test_extensions_of_rows(spark):
    rows = [(1, "abcdef", 2, "xcdez", 1), (2, None, None, "a", 0), (3, "same", 0, "same", 0), (4, "abc", 9, "abc", 0), (5, "", 0, "", 0)]
    got = common_extensions(spark.createDataFrame(rows, "pair long, one string, at long, two string, other_at long")).collect()
    assert dict(map(tuple, got)) == {1: 3, 2: 0, 3: 4, 4: 0, 5: 0}


def test_likeness():
    dice = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    one = " ".join(dice.choice(words) for _ in range(400))
    other = " ".join(dice.choice(words) for _ in range(380))
    like = lambda a, b: Fingerprint(a).likeness(Fingerprint(b))
    assert like(one, one) == like("", "") == 1 and like(one, "") == 0 and like(one, other) < 0.05
    assert 0.93 < like(one, one[:1000] + "inserted words " + one[1000:]) < 1
    assert 0.93 < like(one, one[:1000] + "#" + one[1001:]) < 1
    assert 0.4 < like(one, one[: len(one) // 2] + other[: len(one) // 2]) <= 0.55
    for a, b in [(one, other), (one, one[7:]), (one, one[:300]), ("kitten sitting", "kitchen sitting"), ("a", "b"), ("abc", "abd")]:
        assert like(a, b) == like(b, a) and 0 <= like(a, b) < 1
    for text in (one, "", "a", "😀" * 64, "x" * 65, "y" * 5000):
        again = Fingerprint.parse(str(Fingerprint(text)))
        assert str(again) == str(Fingerprint(text)) and again.likeness(Fingerprint(text)) == 1 and len(again.front) <= 65


def test_plain_fingerprints(spark):
    rows = corpus(20)
    got = sorted(map(tuple, fingerprints(table(spark, rows)).collect()), key=str)
    assert got == sorted([(i, len(t or ""), str(Fingerprint(t or ""))) for i, t in rows], key=str)
