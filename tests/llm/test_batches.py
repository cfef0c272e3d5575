"""Texts go to Python workers in batches of bounded bytes."""

import pandas as pd
from pyspark.sql import functions as F

from busward.llm import common


def test_batches_hold_a_bounded_number_of_bytes(spark):
    docs = common.staged(spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("x"), 100_000).alias("text")), "texts")

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [pdf["text"].str.len().sum()]})

    most, total = docs.coalesce(1).mapInPandas(sizes, "n long").agg(F.max("n"), F.sum("n")).first()
    assert total == 30_000_000 and most <= common.BATCH_BYTES + 100_000
