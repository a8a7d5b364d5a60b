"""Scratch tables go with their block, and joins hold when one key holds a third of the rows."""

import os

from pyspark.sql import functions as F
from siltstone.operators.ranks import split_by_match
from siltstone.session import materialise, scratch, shared_dir


def folders(spark):
    root = shared_dir(spark).removeprefix("file:") + "/siltstone"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scratch_keeps_only_what_leaves(spark):
    before = folders(spark)
    with scratch() as outer:
        with scratch() as inner:
            step = materialise(spark.range(10), "loop")
            for _ in range(20):
                last, step = step, materialise(step.withColumn("id", F.col("id") + 1), "loop")
                inner.drop(last)
                assert len(folders(spark) - before) == 1
            bucketed = materialise(step, "wide", buckets=["id"])
            plan = bucketed.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan
            kept = inner.keep(bucketed.agg(F.sum("id").alias("s")))
        assert kept.first().s == 245 and len(folders(spark) - before) == 1
        result = outer.keep(kept)
    assert result.first().s == 245 and len(folders(spark) - before) == 1


def test_split_by_match(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) AS key", "id AS v")
    marks = rows.filter("key % 2 = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for share in (1000, 1):
        met, rest = split_by_match(rows, materialise(marks, "marks"), ["key"], share=share)
        assert met.count() == rows.filter("key % 2 = 0").count() and rest.count() == rows.filter("key % 2 <> 0").count()
        assert met.filter("key = 0").agg(F.min("n")).first()[0] == 3000
