"""The pipeline stage by stage against a plain version, and all queries against DuckDB."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from busward.llm.common import staged
from busward.llm.queries import QUERIES, SQL
from tests.compare import difference, duck
from tests.llm.test_matching import plain_near
from tests.llm.test_native import counts
from tests.llm.test_storage import fair_targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], FOLDER), name))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(steps):
    kept = {r["doc_id"] for r in rows(steps[1])}
    for r in rows(steps[0]):
        n, _, _, _, repeated = counts(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in kept


def test_near_dedup_stage(steps):
    want = {i for i, _, _, kept in plain_near([(r["doc_id"], r["text"]) for r in rows(steps[1])]) if kept}
    assert sorted(r["doc_id"] for r in rows(steps[2])) == sorted(want)


def test_decontamination_stage(spark, steps):
    items = [" ".join(r["text"].split()) for r in rows(spark.read.parquet(f"{FOLDER}/benchmark.parquet"))]
    holds = lambda text: any(x in " ".join(text.split()) for x in items)
    kept = {r["doc_id"] for r in rows(steps[3])}
    assert {r["doc_id"] for r in rows(steps[2]) if not holds(r["text"])} == kept


def test_mix_stage(steps):
    given, got = rows(steps[3]), Counter(r["doc_id"] for r in rows(steps[4]))
    size = {r["doc_id"]: len(r["text"].split()) for r in given}
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += counts(r["text"])[0]
    want = fair_targets(sizes)
    expected = Counter()
    for source in sizes:
        own = sorted((hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest(), r["doc_id"]) for r in given if r["source"] == source)
        for epoch in range(2):
            at = epoch * sizes[source]
            for _, doc in own:
                if at < int(want[source]):
                    expected[doc] += 1
                at += size[doc]
    assert got == expected


def test_shard_stage(steps):
    given = rows(steps[4])
    got = rows(steps[5])
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in given)
    text = {r["doc_id"]: r["text"] for r in given}
    where, loads = {}, Counter()
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1
        assert where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in got)


def test_stages_survive_odd_rows(spark):
    base = " ".join(f"word{i} the of" for i in range(60))
    odd = [(None, base, None, None, None), (None, base, None, None, None), (None, None, "en", "s", 1), (1, base + " end", None, None, None), (1, base + " end", None, None, None), (2, "", "", "", 0)]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
    # The rows without an id are near copies of document 1, which stands for them.
    assert {r["doc_id"] for r in docs.collect()} == {1}
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, FOLDER), name)
    assert empty.count() == 0


def test_rows_that_share_an_id(spark):
    """Near-dedup keeps every text of its own and drops rows equal in id and text; the mix takes no row more than twice."""
    dice = random.Random(3)
    text = lambda n: " ".join(f"w{dice.randrange(5000)}" for _ in range(n))
    own, other, third, fourth = text(80), text(90), text(70), text(60)
    given = [(1, own), (1, other), (1, third), (1, third), (None, fourth), (None, own + " end"), (None, None), (7, other), (7, ""), (7, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, None, f"s{k % 2}", 0) for k, (i, t) in enumerate(given)], spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, FOLDER)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, own), (1, other), (1, third), (None, fourth), (None, None), (7, ""), (8, "")])
    rows = docs.unionAll(docs)
    mixed = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.source_mix(spark, rows, FOLDER).collect())
    allowed = Counter((r["doc_id"], r["text"], r["source"]) for r in rows.collect())
    assert set(mixed) <= set(allowed) and all(n <= 2 * allowed[row] for row, n in mixed.items())
    assert len({t for _, t, _ in mixed}) >= 3


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert SQL.keys() <= __spark_entry__.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    out = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert difference(out, duck(FOLDER), SQL[name]) in (None, "EMPTY")
    else:
        assert out.agg(F.count("*")).first()[0] > 0
