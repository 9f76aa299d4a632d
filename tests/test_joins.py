from pyspark.sql import functions as F

from lifetrack.operators import joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_matches_null_with_null(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 10), (2, 20)], "k int, y int")
    assert rows(joins.merge(a, b, ["k"])) == [(None, 1, 10)]
    assert rows(joins.merge(a, b, ["k"], null_safe=False)) == []
    assert rows(joins.merge(a, b, ["k"], "full")) == [(1, 2, None), (2, None, 20), (None, 1, 10)]


def test_natural_merge_and_suffixes(spark):
    a = spark.createDataFrame([(1, "p", 5)], "k int, s string, v int")
    b = spark.createDataFrame([(1, "p", 7), (1, "q", 8)], "k int, s string, w int")
    assert rows(joins.merge(a, b)) == [(1, "p", 5, 7)]
    clash = joins.merge(a, b.withColumnRenamed("w", "v"), ["k"])
    assert clash.columns == ["k", "s_x", "v_x", "s_y", "v_y"]


def test_natural_anti_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], "k int, s string")
    b = spark.createDataFrame([(2, "x")], "k int, s string")
    assert rows(joins.anti(a, b)) == [(1, None), (1, None)]


def test_keep_groups_counts_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    assert rows(joins.keep_groups(df, ["k"], lambda n: n > 1)) == [(None, 1), (None, 2)]
    assert rows(joins.with_group_count(df, ["k"], "n")) == [(1, 3, 1), (None, 1, 2), (None, 2, 2)]


def test_group_max_keeps_ties_and_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("a", None), ("b", None)], "k string, v int")
    assert rows(joins.keep_group_max(df, ["k"], "v")) == [("a", 2), ("a", 2)]


def test_role_playing_lookup(spark):
    df = spark.createDataFrame([(1, 2), (2, None)], "a int, b int")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    both = joins.lookup(joins.lookup(df, dim, {"a": "id"}, {"name": "name_a"}), dim, {"b": "id"}, {"name": "name_b"})
    assert rows(both) == [(1, 2, "one", "two"), (2, None, "two", None)]


def test_equal_tables_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert joins.equal_tables(a, a).first().equal
    report = joins.equal_tables(a, a.distinct()).first()
    assert (report.unmatched_rows, report.equal) == (1, False)


def test_hot_keys_do_not_change_joins(spark):
    facts = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 30 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("tie"), (F.col("id") % 11).alias("v"),
    )
    keys = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = joins.merge(facts, keys, ["k"], how, null_safe=False)
        assert joins.equal_tables(plain, joins.merge_settled(facts, keys, ["k"], how)).first().equal
    sizes = facts.groupBy("k").count()
    kept = {r["k"]: r["count"] for r in sizes.collect() if r["count"] > 60}
    assert {r["k"]: r["count"] for r in joins.keep_groups(facts, ["k"], lambda n: n > 60).groupBy("k").count().collect()} == kept
    counted = joins.with_group_count(facts, ["k"], "n").select("k", "n").distinct()
    assert joins.equal_tables(counted, sizes.withColumnRenamed("count", "n")).first().equal
    top = joins.keep_group_max(facts, ["k"], "v")
    assert {(r.k, r.v) for r in top.collect()} == {(r[0], r[1]) for r in facts.groupBy("k").agg(F.max("v")).collect()}


def test_null_key_lookup(spark):
    facts = spark.createDataFrame([(1,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (None, "b")], "d int, v string")
    plain = {r.k: r.v for r in joins.lookup(facts, dim, {"k": "d"}, {"v": "v"}).collect()}
    assert plain == {1: "a", None: None}
    safe = {r.k: r.v for r in joins.lookup(facts, dim, {"k": "d"}, {"v": "v"}, null_safe=True).collect()}
    assert safe == {1: "a", None: "b"}


def test_differences_name_keys_and_columns(spark):
    rows = [(k, k % 5, float(k), f"t{k}") for k in range(400)] + [(7, 1, 1.0, "second"), (None, 0, None, None)]
    left = spark.createDataFrame(rows, "k int, a int, b double, c string").repartition(3)
    changed = [r if r[0] != 9 else (9, r[1], -1.0, "other") for r in rows if r[0] != 11]
    changed = [r if r[:2] != (7, 1) else (7, 1, 1.0, None) for r in changed] + [(500, 0, 0.0, "new"), (12, 2, 12.0, "t12")]
    right = spark.createDataFrame(changed, left.schema).repartition(5)
    want = {9: (1, 1, ["b", "c"]), 7: (2, 2, ["c"]), 11: (1, 0, []), 500: (0, 1, []), 12: (1, 2, ["a", "b", "c"])}
    for limits in ({}, {"ranges": 3, "depth": 1}, {"depth": 0}):
        got = {r.k: (r.rows_left, r.rows_right, r["columns"]) for r in joins.differences(left, right, ["k"], **limits).collect()}
        assert got == want
    assert joins.differences(left, left.repartition(7), ["k"]).count() == 0
    assert joins.differences(left.limit(0), left.limit(0), ["k"]).count() == 0
