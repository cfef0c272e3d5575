"""H3 looks at the development runs only, so the memory rules need their rows only."""

from pyspark.sql import functions as F

from busward.catalog.inferential import with_rules


def test_rules_of_some_runs_need_no_other_runs(spark):
    rows = [(run, seq, int((run * 7 + seq * seq * 3) % 5 < 2), int((run + seq) % 11 == 0)) for run in range(6) for seq in range(40)]
    df = spark.createDataFrame(rows, "run long, seq long, multi_instant int, context_only_no_state_alarm int")
    some = F.col("run").isin(0, 2, 5)
    before = sorted(tuple(r) for r in with_rules(df).where(some).collect())
    after = sorted(tuple(r) for r in with_rules(df.where(some)).collect())
    assert before == after and len(after) == 120
    assert len({r[4:] for r in after}) > 4
