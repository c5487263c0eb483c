"""The levelled runs: what they hold, and that merging and joining them shuffles nothing."""

import random
from collections import Counter

from pyspark.sql import functions as F

from orolith.llm.line_dedup import LineRuns, merge


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, keys):
    return spark.createDataFrame([(k, -k) for k in keys], "h1 long, h2 long")


def test_runs_are_merged_and_joined_without_a_shuffle(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = LineRuns(spark, 3, 3)
        for batch in range(2):
            index.add(frame(spark, range(batch, batch + 50)))
        assert [len(level) for level in index.levels] == [2]
        assert "Exchange" not in plan(merge(index.runs()))
        batch = frame(spark, range(60)).groupBy("h1", "h2").agg(F.count("*").alias("n"))
        joined = plan(index.unsettled(batch))
        assert joined.count("Exchange hashpartitioning") == 1 == plan(batch).count("Exchange hashpartitioning")  # the batch's own
        names = [name for name, _ in index.made]
        index.drop()
        assert not any(spark.catalog.tableExists(name) for name in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_frequent_keys_over_many_batches(spark):
    rng, seen = random.Random(1), Counter()
    index = LineRuns(spark, 6, 2)
    for _ in range(7):
        keys = [rng.randrange(30) ** 2 // 9 for _ in range(20)]
        seen.update(keys)
        index.add(frame(spark, keys))
    assert {r.h1 for r in index.frequent().collect()} == {k for k, n in seen.items() if n >= 6}
    # a key that was settled before a batch is not counted on
    assert all(r.n <= seen[r.h1] for run in index.runs() for r in run.collect())
    index.drop()
