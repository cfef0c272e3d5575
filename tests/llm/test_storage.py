"""Shards, mixing, line dedup and archives against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from busward.llm import warc
from busward.llm.common import BLANKS, running
from busward.llm.lines import SortedRuns, deduplicated, dropped_lines
from busward.llm.mixing import mixed, source_targets, sized, taken_words
from busward.llm.shards import Packer, Rooms, pack_into, sharded, sized_documents


def test_rooms_finds_the_tightest():
    dice, tree, plain = random.Random(1), Rooms(), set()
    for step in range(3000):
        if plain and dice.random() < 0.45:
            key = dice.choice(sorted(plain))
            plain.discard(key)
            tree.remove(key)
        else:
            key = (dice.randrange(300), step)
            plain.add(key)
            tree.add(key)
        size = dice.randrange(300)
        assert tree.tightest(size) == min((k for k in plain if k[0] >= size), default=None)

    def depth(node):
        return 0 if node is None else 1 + max(depth(node[2]), depth(node[3]))

    for i in range(4096):
        tree.add((1000, 10_000 + i))
    assert depth(tree.root) <= 26


def test_packing():
    dice = random.Random(2)
    sizes = sorted((dice.randrange(1, 1000) for _ in range(3000)), reverse=True)
    packer, loads = Packer(5000), Counter()
    for s in sizes:
        loads[packer.place(s)] += s
    assert max(loads.values()) <= 5000 and len(loads) <= -(-sum(sizes) // 5000) + 1
    loads = Counter()
    for s, b in zip(sizes, pack_into(sizes, 16), strict=True):
        loads[b] += s
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 0.01 * sum(sizes) / 16
    giant = pack_into([10_000, *[10] * 150], 16)
    assert giant.count(giant[0]) == 1 and set(Counter(giant[1:]).values()) == {10}
    assert pack_into([], 4) == [] and pack_into([3], 4) == [0]


DOCS = "doc_id long, text string, source string, shard string, slot string"


def test_shards(spark):
    dice = random.Random(3)
    texts = ["x" * dice.randrange(0, 400) + str(i % 90) for i in range(600)] + ["copy"] * 90 + [None, "", ""]
    rows = [(i, t, "s", "clash", "clash") for i, t in enumerate(texts)] + [(None, "x", None, "", "")]
    docs = sized_documents(spark.createDataFrame(rows, DOCS))
    got = sharded(docs, "text_key", "size", shards=16, slot_order=["text_key", "doc_id"]).collect()
    assert len(got) == len(rows)
    shard_of, slots, loads = {}, defaultdict(list), Counter()
    for r in got:
        assert shard_of.setdefault(r["text_key"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "x"
        assert r["size"] == len(text or "") + 1 and r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
    assert set(shard_of.values()) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= 1.02 * min(loads.values())
    again = sharded(docs.repartition(7), "text_key", "size", shards=16).collect()
    assert len(again) == len(rows)


def test_shards_by_capacity_and_empty(spark):
    docs = sized_documents(spark.createDataFrame([(i, "y" * (i % 50) + str(i), None, "", "") for i in range(400)], DOCS))
    loads = Counter()
    for r in sharded(docs, "text_key", "size", capacity=1000).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 1000 and len(loads) <= -(-sum(loads.values()) // 1000) + 1
    assert sharded(docs.limit(0), "text_key", "size", shards=16, slot_order=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharded(docs, "text_key", "size")


def test_running_spreads_keys(spark):
    rows = [(0, i, i % 7) for i in range(500)] + [(1, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, o long, v long")
    got = sorted((r["k"], r["o"], r["s"]) for r in running(df, "k", [F.col("o")], "v", "s", "t").collect())
    want, sums = [], Counter()
    for k, o, v in sorted(rows):
        want.append((k, o, sums[k]))
        sums[k] += v
    assert got == want


def fair_targets(sizes, weights=(5, 2, 1), share=1.5):
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    capped = set()
    while True:
        level = (share * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / max(1, sum(w[s] for s in sizes if s not in capped))
        over = {s for s in sizes if s not in capped and w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in capped else w[s] * level for s in sizes}
        capped |= over


def test_mix(spark):
    dice = random.Random(4)
    sources = ["a"] * 300 + ["b", "c", "d"] * 40 + [None] * 20 + ["Ω"] * 3
    rows = [(i, "w " * dice.randrange(0, 120), s, "", "") for i, s in enumerate(sources)] + [(5, None, "a", "", ""), (None, "x y", "a", "", ""), (None, "x y", "a", "", "")]
    docs = sized(spark.createDataFrame(rows, DOCS))
    r, p = mixed(docs, block=64)
    got, pieces = taken_words(r, p).collect(), p.collect()
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = fair_targets(sizes)
    taken = Counter()
    assert len(got) == len(rows) and len({x["row"] for x in got}) == len(rows)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    # Every prefix of the schedule holds the sources nearly in proportion.
    of, total = {x["row"]: x["source"] for x in got}, sum(want.values())
    order, so_far = sorted(pieces, key=lambda x: x["point"]), Counter()
    for x in order:
        so_far[of[x["row"]]] += x["n_words"]
        done = sum(so_far.values())
        assert all(abs(so_far[s] - done * want[s] / total) <= 64 * 8 for s in sizes)
    blocks = Counter()
    for x in pieces:
        blocks[of[x["row"]], x["rank"]] += x["n_words"]
    assert all(n == 64 or rank == max(q for s2, q in blocks if s2 == s) for (s, rank), n in blocks.items())
    r2, p2 = mixed(docs.repartition(5), block=64)
    again = sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in taken_words(r2, p2).collect())
    assert again == sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in got)


def test_mix_of_nothing(spark):
    r, p = mixed(sized(spark.createDataFrame([], DOCS)))
    assert r.count() == 0 and p.count() == 0
    r, p = mixed(sized(spark.createDataFrame([(1, "", "a", "", ""), (2, None, "b", "", "")], DOCS)))
    assert [x["taken"] for x in taken_words(r, p).collect()] == [0, 0]
    assert source_targets(r.groupBy("source").agg(F.sum("size").alias("source_size"))).count() == 2


def plain_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            at = i if i is not None else 1 << 70
            first[key(line)] = min(at, first.get(key(line), at))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (i if i is not None else 1 << 70)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    dice = random.Random(5)
    pool = [f"shared line number {i}" for i in range(40)] + ["short", "", "  ", "É" * 10, "A" * 10, "\tSHARED line NUMBER 1 \r"]
    rows = [(i, "\n".join(dice.choice(pool) if dice.random() < 0.6 else f"own line {i} {dice.random()}" for _ in range(dice.randrange(0, 12)))) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "shared line number 3\nonly here, without id"), (None, "only here, without id"), (3, "twice the same id\nshared line number 5"), (3, "twice the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = deduplicated(docs, batches=5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines(rows)
    assert deduplicated(docs.limit(0)).count() == 0


def test_runs_compact_and_carry_over(spark):
    runs = SortedRuns(fan=2)
    old = spark.createDataFrame([(100 + i, f"line that is number {i % 30}") for i in range(120)], "doc_id long, text string")
    dropped_lines(old, batches=4, runs=runs)
    sizes = [[r.count() for r in level] for level in runs.levels]
    assert sum(map(sum, sizes)) == 30 and all(len(level) < 2 for level in runs.levels)
    new = spark.createDataFrame([(1, "line that is number 7\nsomething that is new")], "doc_id long, text string")
    (r,) = deduplicated(new, runs=runs).collect()
    assert r["kept_text"] == "something that is new"


def test_archives(spark, tmp_path):
    big, bigger = "<p>" + "same payload " * 20, "z" * 300_000
    rows = [(i, f"http://x/{i}", f"<html>{i} {'body ' * (i % 30)}</html>") for i in range(300)]
    rows += [(500, "http://x\r\nWARC-Type: fake/%41", big), (400, None, big), (450, "u", big), (600, "u", None), (601, "u", ""), (602, "u", "tiny"), (603, "u", "tiny"), (700, "é", bigger), ((1 << 60) + 1, "u", big)]
    rows += [(None, "u", big), (None, "u", "only a null id " * 20), (None, "u", "only a null id " * 20), (400, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages, path, archive_bytes=100_000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        of = first.get(h)
        revisit = of is not None and of != i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", of if revisit else None, None if revisit else body))
    back = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(back, key=str) == sorted(want, key=str)
    files = sorted(tmp_path.glob("a/part-*"))
    assert len(files) > 1
    for f in files:
        data = f.read_bytes()
        if data:
            size = int.from_bytes(data[4:8], "little")
            assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
            whole = opener.stream_reader(data[8 + size :], read_across_frames=True).read()
            assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc.archived(pages.limit(0)).count() == 0
