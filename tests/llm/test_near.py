"""Signatures, word hashes and blocks of near-duplicates, apart from whole runs."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from busward.llm.near import SIDE, _compared, cells, signature
from busward.llm.text import shingle_sets, word_hashes, words_of


def test_signatures_agree_by_shared_shingles_only():
    """Sets without a common shingle have no common value, though their smallest halves are equal."""
    dice = np.random.default_rng(3)
    low = dice.integers(0, 1 << 32, 5000, np.uint64)
    one, two = (np.sort(low + (dice.permutation(1 << 20)[:5000].astype(np.uint64) << np.uint64(32))) for _ in range(2))
    assert not np.intersect1d(one, two).size
    assert (signature(one, 64) == signature(two, 64)).sum() == 0
    half = np.sort(np.concatenate([one[:4000], two[:1000]]))
    assert 25 < (signature(one, 64) == signature(half, 64)).sum() < 56
    assert (signature(one[:1], 64) == signature(one[:1], 64)).all()


def test_word_hashes_tell_words_apart():
    dice = random.Random(5)
    texts = ["", None, " \t", "a", "A b", "b\x0ba", "x" * 8, "x" * 9, "x" * 16, "é\x00 é", "\ud800 z", "y" * 3000, "y" * 2999 + "z", "y" * 3000 + " q"]
    texts += [" ".join("".join(dice.choice("abé\x00") for _ in range(dice.randrange(1, 22))) for _ in range(40)) for _ in range(30)]
    hashes, begin = word_hashes(texts)
    seen = {}
    for k, text in enumerate(texts):
        words = words_of(text or "")
        assert len(words) == begin[k + 1] - begin[k]
        for word, value in zip(words, hashes[begin[k] : begin[k + 1]].tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen) and len(word_hashes([])[0]) == 0
    for width in (1, 3, 5):
        for text, own in zip(texts, shingle_sets(texts, width), strict=True):
            words = words_of(text or "")
            want = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)} - {()}
            assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()


def test_blocks_meet_once_in_many_tasks(spark):
    """One family lies in many tasks; before, its pairs of blocks had one key."""
    rows = [(True, 7, k, 20, [k]) for k in range(21)] + [(False, 3, 0, 0, [99])]
    dealt = cells(spark.createDataFrame(rows, "large boolean, part long, chunk long, last long, id array<long>"))
    got = dealt.groupBy("large", "part", "x", "y").agg(F.collect_list("chunk").alias("chunks")).collect()
    family = {(r["x"], r["y"]): set(r["chunks"]) for r in got if r["large"]}
    sides = -(-21 // SIDE)
    assert len(family) == sides * (sides + 1) // 2 and len(got) == len(family) + 1
    for a, b in itertools.combinations_with_replacement(range(21), 2):
        assert {a, b} <= family[a // SIDE, b // SIDE]
    assert dealt.filter("large").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_compared_blocks_equal_all_pairs():
    dice = np.random.default_rng(8)
    base = dice.integers(0, 1 << 62, 120, np.uint64)
    sets = [np.unique(np.concatenate([dice.choice(base, 120 - k, replace=False), dice.integers(0, 1 << 62, k, np.uint64)])) for k in dice.integers(0, 40, 90)]
    roots = [dice.integers(0, 2) * 1000 if i % 5 == 0 else i for i in range(90)]

    def block(at):
        return {"id": np.array(at), "root": np.array([roots[i] for i in at]), "sig": [signature(sets[i], 64) for i in at], "own": [sets[i].tobytes() for i in at]}

    def joined(links, ids):
        up = {i: roots[i] for i in ids} | {roots[i]: roots[i] for i in ids}
        top = lambda x: x if up[x] == x else top(up[x])
        for a, b in links:
            x, y = top(roots[a]), top(roots[b])
            up[max(x, y)] = min(x, y)
        return {i: top(roots[i]) for i in ids}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    one, two = pd.DataFrame([block([*range(20)]), block([*range(20, 50)])]), pd.DataFrame([block([*range(50, 90)])])
    alone = [p for p in itertools.combinations(range(50), 2) if linked(*p)]
    across = [(a, b) for a in range(50) for b in range(50, 90) if linked(a, b)]
    got = _compared(one, None, 75, 30)
    assert set(got) <= set(alone) and joined(got, range(50)) == joined(alone, range(50))
    got = _compared(one, two, 75, 30)
    assert set(got) <= set(across) and joined(got, range(90)) == joined(across, range(90)) and len(got) < len(across)
    assert _compared(one, two.iloc[:0], 75, 30) == [] and _compared(one.iloc[:0], two, 75, 30) == []
