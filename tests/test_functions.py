import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lifetrack.functions import columns as c
from lifetrack.functions import dates as d
from lifetrack.functions.normal import norm_quantile


def values(df, column):
    return [r[column] for r in df.collect()]


def test_unknown_condition_gives_null_not_else(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    assert values(df.select(c.ifelse(F.col("x") == 1, "yes", "no").alias("v")), "v") == ["yes", "no", None]
    assert values(df.select(c.recode("x", {1: "one"}, "other").alias("v")), "v") == ["one", "other", None]
    assert values(df.select(c.two_codes("x", [1], 1, 2).alias("v")), "v") == [1, 2, None]


def test_strict_sum_and_mean_are_null_with_any_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(c.sum_strict("v").alias("s"), c.mean_strict("v").alias("m")).collect()}
    assert got == {"a": (3.0, 1.5), "b": (None, None)}


def test_substring_test_hits_parts_and_keeps_nulls(spark):
    df = spark.createDataFrame([("BrU",), ("NSA",), ("H",), (None,)], "s string")
    assert values(df.select(c.contains_any("s", ["U", "NS"]).alias("v")), "v") == [True, True, False, False]


def test_blank_cast_and_null_cells(spark):
    df = c.blank_to_null(spark.createDataFrame([("", "7"), ("x", "seven")], "a string, b string"))
    typed = c.cast_columns(df, {"b": "int"})
    assert [tuple(r) for r in typed.collect()] == [(None, 7), ("x", None)]
    assert c.null_cells(typed).first()[0] == 2


def test_dates(spark):
    df = spark.createDataFrame([("31/08/2019", "2020-02-29"), ("2019-08-31", "x")], "a string, b string")
    row, bad = df.select(d.parse_dmy("a").alias("a"), d.parse_iso("b").alias("b")).collect()
    assert row.a == dt.date(2019, 8, 31) and row.b == dt.date(2020, 2, 29)
    assert bad.a is None and bad.b is None


@pytest.mark.parametrize("first, second, want", [
    ("2020-01-01", "2020-01-05", "2020-01-03"),
    ("2020-01-01", "2020-01-04", "2020-01-02"),
    ("2020-01-04", "2020-01-01", "2020-01-02"),  # negative gaps round toward the past
])
def test_midpoint_rounds_toward_the_past(spark, first, second, want):
    df = spark.sql(f"select date '{first}' a, date '{second}' b")
    assert str(df.select(d.midpoint_date("a", "b").alias("m")).first().m) == want


def test_local_midnight_shifts_summer_ages(spark):
    df = spark.sql("select date '2019-01-01' a, date '2020-01-18' w, date '2020-07-01' s")
    row = df.select(d.days_between_local("a", "w").alias("w"), d.days_between_local("a", "s").alias("s")).first()
    assert row.w == 382 and abs(row.s - (547 - 1 / 24)) < 1e-9


def test_seasons(spark):
    df = spark.sql("select explode(sequence(date '2020-01-15', date '2020-12-15', interval 1 month)) as day")
    wide = "".join(values(df.select(d.season("day").alias("v")), "v"))
    narrow = "".join(values(df.select(d.season("day", d.NARROW_WINTER).alias("v")), "v"))
    assert (wide, narrow) == ("WWWWSSSSSWWW", "WWSSSSSSSSWW")
    assert values(df.limit(1).select(d.season(F.lit(None).cast("date")).alias("v")), "v") == [None]


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.0242, 0.02425, 0.3, 0.5, 0.7, 0.97575, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps + [0.0, 1.0]], "p double")
    got = values(df.select(norm_quantile("p").alias("z")), "z")
    assert got[-2:] == [None, None]
    for p, z in zip(ps, got):
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-7
