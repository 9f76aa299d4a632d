import math
import random

import pytest
from pyspark.sql import functions as F

from lifetrack.operators import ordered, periods
from lifetrack.operators.periods import overlap_calendar, overlap_join, period_chain


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_and_last_skip_nulls_and_break_ties(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", 5, 3), ("a", 5, 2), ("a", 7, 9), ("a", 7, 8), ("b", None, 4)],
        "k string, v int, tie int",
    )
    assert rows(ordered.first_by(df, ["k"], "v", "tie")) == [("a", 5, 2)]
    assert rows(ordered.last_by(df, ["k"], "v", "tie")) == [("a", 7, 8)]


def test_first_duplicate_kept_orders_nulls_last(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "x", 3, 2), ("a", "y", None, 3)], "e string, l string, s int, tie int")
    assert rows(ordered.drop_first_dup(df, ["e", "l"], "s", "tie")) == [("a", "x", 3, 2), ("a", "y", None, 3)]


def skewed(spark, n=3000, seed=3):
    """A third of all rows under one key, and a third of its order values equal; some null, some NaN."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 200)
        order = 50.0 if rng.random() < 0.35 else float(rng.randrange(100))
        order = None if i % 9 == 0 else math.nan if i % 23 == 0 else order
        value = rng.random() if rng.random() < 0.2 else None
        data.append((key, order, i, value))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k int, o double, tie int, v double").repartition(4)


@pytest.mark.parametrize("limits", [{}, {"parts": 16}, {"parts": 64}])
def test_numbering_and_fills_do_not_depend_on_blocks(spark, limits):
    data, df = skewed(spark)
    groups = {}
    place = lambda o: (2, 0) if o is None else (1, 0) if math.isnan(o) else (0, o)
    for row in sorted(data, key=lambda r: (r[0], place(r[1]), r[2])):
        groups.setdefault(row[0], []).append(row)
    want_n, want_before, want_after, running = {}, {}, {}, {}
    for members in groups.values():
        last, total = None, 0
        for i, (_, _, tie, v) in enumerate(members, start=1):
            last = v if v is not None else last
            total += tie
            want_n[tie], want_before[tie], running[tie] = i, last, total
        ahead = None
        for _, _, tie, v in reversed(members):
            ahead = v if v is not None else ahead
            want_after[tie] = ahead
    got = {r.tie: r.n for r in ordered.numbered(df, ["k"], "o", "tie", "n", **limits).collect()}
    assert got == want_n
    got = {r.tie: r.t for r in ordered.running_total(df, ["k"], "o", "tie", F.col("tie"), "t", **limits).collect()}
    assert got == running
    near = ordered.nearest_known(df, ["k"], "o", "tie", "v", **limits).collect()
    assert {r.tie: r.prev_known for r in near} == want_before
    assert {r.tie: r.next_known for r in near} == want_after


def test_hot_group_is_really_split(spark):
    _, df = skewed(spark)
    scan = ordered.Scan(df, ["k"], "o", "tie", parts=16)
    sizes = [r["count"] for r in scan.rows.groupBy("_part").count().collect()]
    # Neither the hot key nor the value holding a third of its rows stays in one part.
    assert len(sizes) == 16 and max(sizes) < 2.5 * sum(sizes) / 16
    assert scan.rows.where("k = 0").select("_part").distinct().count() >= 5
    brought = scan.brought({"n": F.count(F.lit(1))}, lambda earlier, later: {"before": F.sum("n").over(earlier)})
    assert brought.count() <= 2 * 16


@pytest.mark.parametrize("parts", [None, 1, 7])
@pytest.mark.parametrize("kind", ["empty", "no hot group", "one group", "all orders null", "null keys"])
def test_numbering_on_plain_tables(spark, kind, parts):
    data = {
        "empty": [],
        "no hot group": [(k, float(k % 7), k) for k in range(300)],
        "one group": [(1, float(i % 5), i) for i in range(300)],
        "all orders null": [(i % 3, None, i) for i in range(300)],
        "null keys": [(None if i % 2 else 4, float(i % 5), i) for i in range(300)],
    }[kind]
    df = spark.createDataFrame(data, "k int, o double, tie int")
    want, seen = {}, {}
    for k, o, tie in sorted(data, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0.0, r[2])):
        seen[k] = want[tie] = seen.get(k, 0) + 1
    assert {r.tie: r.n for r in ordered.numbered(df, ["k"], "o", "tie", "n", parts=parts).collect()} == want
    near = ordered.nearest_known(df.withColumn("v", F.lit(None).cast("string")), ["k"], "o", "tie", "v", parts=parts).collect()
    assert len(near) == len(data) and all(r.prev_known is None and r.next_known is None for r in near)


def test_running_totals_skip_null_amounts(spark):
    data = [(i, None if i % 3 else i) for i in range(1, 40)]
    df = spark.createDataFrame(data, "o int, a int")
    got = {r.o: r.t for r in ordered.running_total(df, [], "o", "o", F.col("a"), "t", parts=5).collect()}
    total = None
    for o, a in data:
        total = total if a is None else (total or 0) + a
        assert got[o] == total


def test_windows_over_parts_need_no_exchange(spark):
    """Rows are exchanged once, to be dealt by ranges; what comes after reads the buckets."""
    _, df = skewed(spark)
    text = ordered.numbered(df, ["k"], "o", "tie", "n", parts=4)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if " Exchange " in line]
    assert "Window" in text and all("ENSURE_REQUIREMENTS" in line and "_part" not in line for line in exchanges)


def test_whole_table_as_one_group(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("o"), F.col("id").alias("tie"))
    plain = ordered.numbered(df, [], "o", "tie", "n")
    split = ordered.numbered(df, [], "o", "tie", "n", parts=32)
    assert rows(plain) == rows(split)
    want = sorted((r.o, r.tie) for r in df.collect())
    assert [(r.o, r.tie) for r in sorted(plain.collect(), key=lambda r: r.n)] == want


def test_fill_directions(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (1, 4, 7.0), (1, 5, None), (2, 1, None)], "k int, o int, v double")
    up = [r.v for r in ordered.fill_nearest(df, ["k"], "o", "o", "v", "updown").orderBy("k", "o").collect()]
    down = [r.v for r in ordered.fill_nearest(df, ["k"], "o", "o", "v", "downup").orderBy("k", "o").collect()]
    assert up == [5.0, 5.0, 7.0, 7.0, 7.0, None] and down == [5.0, 5.0, 5.0, 7.0, 7.0, None]


def test_period_order_comes_from_dates_not_ids(spark):
    calendar = spark.sql(
        "select * from values (9, date '2000-01-01', date '2000-02-01'), (2, date '2000-06-01', date '2000-07-01'), "
        "(110, date '2000-08-01', date '2000-08-09'), (5, date '2001-01-01', date '2001-02-01') "
        "as t(period, period_start, period_end)"
    )
    chain = {r.period: (r.ordinal, r.prev_period, r.prev2_period) for r in period_chain(calendar, [110]).collect()}
    assert chain == {9: (1, None, None), 2: (2, 9, None), 5: (3, 2, 9)}


def day_rows(spark, rows, names):
    day = lambda c: F.date_from_unix_date(c).alias(c)
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).select(names[0], day(names[1]), day(names[2]))


def test_overlap_join_agrees_with_brute_force(spark):
    """Also for intervals given the wrong way round, before 1970, of one day, and for one span over all time."""
    rng = random.Random(1)
    spans = [(i, rng.randrange(-200, 900), rng.randrange(-200, 900)) for i in range(60)] + [(99, None, 10), (100, -700_000, 700_000), (101, 5, 5), (101, 5, 5)]
    times = [(p, s := rng.randrange(-100, 800), s + rng.randrange(0, 200)) for p in range(40)] + [(50, 30, 20), (51, 700, -60), (52, 5, 5), (53, None, 7), (54, -700_000, 700_000)]
    left, right = day_rows(spark, spans, ["e", "lo", "hi"]), day_rows(spark, times, ["p", "s", "t"])
    want = sorted((e, p) for e, lo, hi in spans for p, s, t in times if None not in (lo, hi, s, t) and t >= lo and hi >= s)
    for joined in (overlap_join(left, right, ("lo", "hi"), ("s", "t")), overlap_calendar(left, right, ("lo", "hi"), ("s", "t"))):
        assert sorted((r.e, r.p) for r in joined.collect()) == want
    for empty in (overlap_join(left.limit(0), right, ("lo", "hi"), ("s", "t")), overlap_join(left, right.limit(0), ("lo", "hi"), ("s", "t"))):
        assert empty.count() == 0


def test_an_interval_has_few_copies_however_long(spark):
    rng = random.Random(4)
    spans = [(i, lo := rng.randrange(-9000, 9000), lo + rng.randrange(0, 2**rng.randrange(1, 20))) for i in range(300)]
    df = day_rows(spark, spans, ["e", "lo", "hi"])
    nodes = df.select("e", periods._nodes(periods._day("lo"), periods._day("hi")).alias("nodes"))
    for (e, lo, hi), row in zip(spans, sorted(nodes.collect())):
        days = sorted(d for n in row.nodes for d in (n.number << n.level, (n.number + 1 << n.level) - 1))
        assert e == row.e and days[0] == lo + periods.FIRST_DAY and days[-1] == hi + periods.FIRST_DAY
        assert sum(1 << n.level for n in row.nodes) == hi - lo + 1
        assert len(row.nodes) <= 2 * (hi - lo + 1).bit_length()


@pytest.mark.parametrize("parts", [None, 1, 9])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_carries_the_last_row(spark, strict, parts):
    rng = random.Random(5)
    key = lambda: 0 if rng.random() < 0.5 else rng.choice([1, 2, None])
    time = lambda: None if rng.random() < 0.05 else rng.randrange(40)
    left = [(i, key(), time()) for i in range(200)]
    right = [(key(), time(), i, f"v{i}" if i % 4 else None) for i in range(150)]
    got = ordered.as_of(
        spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, u int, i int, v string"),
        ["k"], ("t", "u"), tie="i", take={"v": "v", "u": "at"}, count="n", strict=strict, parts=parts)
    for r in got.collect():
        came = sorted((u, i, v) for k, u, i, v in right if k == r.k and None not in (u, r.t) and (u < r.t or u == r.t and not strict))
        assert (r.n, r.at, r.v) == ((len(came), came[-1][0], came[-1][2]) if came else (0, None, None))
    assert got.count() == 200
