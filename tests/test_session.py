"""Settled tables: written once, bucketed on demand, and removed when released."""

import os

from pyspark.sql import functions as F

from lifetrack import session


def test_settled_tables_are_removed_on_release(spark):
    session.release(spark)
    plain = session.settle(spark.range(10))
    dealt = session.settle_by(spark.range(100).withColumn("k", F.col("id") % 7).repartition("k"), "k")
    assert plain.count() == 10 and dealt.count() == 100
    folders = [f.rsplit("/", 1)[0].removeprefix("file://") for f in (*plain.inputFiles(), *dealt.inputFiles())]
    assert all(os.path.isdir(f) for f in folders)
    assert session.release(spark) == 2
    assert not any(os.path.exists(f) for f in folders)
    assert session.release(spark) == 0


def test_grouping_by_the_buckets_needs_no_exchange(spark):
    dealt = session.settle_by(spark.range(100).withColumn("k", F.col("id") % 7).repartition("k"), "k")
    counted = dealt.groupBy("k").count()
    assert sorted(r["count"] for r in counted.collect()) == [14, 14, 14, 14, 14, 15, 15]
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
