"""From raw documents to shards: quality rules, near-duplicates, benchmark leaks, source mix, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. A document that the mix takes twice has two rows after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from busward.llm.common import staged
from busward.llm.decontaminate import clean
from busward.llm.mixing import mixed, sized
from busward.llm.near import without_near_duplicates
from busward.llm.quality import judge
from busward.llm.shards import sharded, sized_documents

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table.

    A filter would be pushed into the projection and repeat its counts for each rule; an explode is not.
    """
    return judge(docs).withColumn("_pass", F.explode(F.when(F.col("kept"), F.array(F.lit(1))))).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id. Rows of one id with different texts are documents of their own,
    also those without an id; rows equal in id and text are one."""
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes a block in which it begins: not at all, once or twice.

    A row is told by all its columns, so rows that share an id count apart; of rows equal in all columns one
    comes out as often as all of them are taken.
    """
    parts = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    key = F.concat_ws(":", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("second"), *parts)))
    keyed = docs.withColumn("_whole", key)
    named = keyed.select(F.coalesce(F.col("doc_id").cast("string"), F.col("_whole")).alias("doc_id"), "source", "text", "_whole")
    rows, pieces = mixed(sized(named).drop("text"), keep=("_whole",))
    begun = pieces.filter("from_word = 0").groupBy("row").agg(F.count("*").alias("n"))
    times = rows.join(begun, "row").groupBy(F.col("_whole").alias("_taken")).agg(F.sum("n").cast("int").alias("_times"))
    taken = keyed.dropDuplicates(["_whole"]).join(times, F.col("_whole") == F.col("_taken"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def best_fit_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), shard and slot: shards of near equal size, equal texts together."""
    sizes = staged(sized_documents(docs), "sizes")
    out = sharded(sizes, "text_key", "size", shards=SHARDS, slot_order=["text_key", "doc_id"])
    return out.select("doc_id", "size", F.col("shard").cast("int").alias("shard"), "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("best_fit_shards", best_fit_shards),
]

#: Packing into shards is not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
