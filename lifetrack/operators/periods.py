"""The period dimension: order, previous periods and interval overlap."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from .joins import lookup


def period_chain(periods: DataFrame, exclude: Iterable = ()) -> DataFrame:
    """Each period with its ordinal and its previous and second-previous period.

    Order comes from the start date; period ids need not be in time order. The
    input is a calendar, one row per period, so its window is bounded by time
    and not by the size of the data.
    """
    kept = periods.where(~F.col("period").isin(list(exclude))) if exclude else periods
    w = Window.orderBy(F.asc_nulls_last("period_start"), F.asc("period"))
    back = lambda c, n: F.lag(c, n).over(w)
    return kept.select(
        "period", "period_start", "period_end",
        F.row_number().over(w).cast("long").alias("ordinal"),
        back("period", 1).alias("prev_period"),
        back("period_start", 1).alias("prev_start"),
        back("period_end", 1).alias("prev_end"),
        back("period", 2).alias("prev2_period"),
        back("period_start", 2).alias("prev2_start"),
        back("period_end", 2).alias("prev2_end"),
    )


def previous_period(
    df: DataFrame, chain: DataFrame, on: str = "last_period", prefix: str = "second_last"
) -> DataFrame:
    """Attach the period before ``on`` with its dates; rows without one drop out."""
    return lookup(
        df,
        chain.where(F.col("prev_period").isNotNull()),
        {on: "period"},
        {"prev_period": f"{prefix}_period", "prev_start": f"{prefix}_start", "prev_end": f"{prefix}_end"},
        how="inner",
    )


def _overlaps(lo, hi, start, end):
    return (end >= lo) & (hi >= start)


def overlap_calendar(
    spans: DataFrame, periods: DataFrame, span: tuple[str, str], period: tuple[str, str]
) -> DataFrame:
    """Pairs of spans and calendar periods with ``period end >= span from`` and ``span to >= period start``.

    A calendar grows with time, not with the data: its rows become one array that
    each span is held against where it stands, so spans are neither exchanged nor
    copied into buckets. Intervals with a missing end match nothing.
    """
    (lo, hi), (start, end) = span, period
    dated = periods.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    calendar = dated.agg(F.array_sort(F.collect_list(F.struct(start, end, *[c for c in periods.columns if c not in period])))).scalar()
    near = F.filter("_calendar", lambda p: _overlaps(F.col(lo), F.col(hi), p[start], p[end]))
    listed = spans.withColumn("_calendar", calendar).select(*spans.columns, F.explode(near).alias("_period"))
    return listed.select(*spans.columns, *[F.col("_period")[c].alias(c) for c in periods.columns])


#: Days are counted from so far before 1970 that all are positive, on an axis of 2^LEVELS days.
FIRST_DAY, LEVELS = 2**21, 22


def _nodes(low, high):
    """The fewest binary ranges that make up the days from ``low`` to ``high``: two per level at most.

    A range of level k starts at a multiple of 2^k and is 2^k long. On each level, what is left of the interval gives its
    first whole range if that has no partner of its own, and its last one likewise.
    """
    def at(k):
        first = F.ceil(low / F.pow(F.lit(2.0), k)).cast("long")
        stop = F.floor((high + 1) / F.pow(F.lit(2.0), k)).cast("long")
        odd = first % 2
        left = F.when((odd == 1) & (first < stop), F.struct(k.alias("level"), first.alias("number")))
        right = F.when((stop % 2 == 1) & (first + odd < stop), F.struct(k.alias("level"), (stop - 1).alias("number")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)), lambda n: n.isNotNull())


def _day(column: str):
    return F.unix_date(column) + F.lit(FIRST_DAY)


def _points_in(points: DataFrame, day, intervals: DataFrame, low, high) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` whose days hold ``day``, each pair once.

    Intervals are listed under the ranges that make them up, points under the ranges of the same sizes that hold them: a
    plain equi-join without candidates that fail. An interval has at most two copies for each doubling of its length and a
    point at most one for each such size, however the other side looks, and no single range holds an interval's time.
    """
    listed = intervals.withColumn("_node", F.explode(_nodes(low, high))).select(
        *intervals.columns, F.col("_node.level").alias("_level"), F.col("_node.number").alias("_number"))
    levels = listed.agg(F.array_sort(F.collect_set("_level"))).scalar()
    placed = points.withColumns({"_levels": levels, "_at": day})
    placed = placed.select(*points.columns, "_at", F.explode("_levels").alias("_level_p"))
    placed = placed.withColumn("_number_p", F.floor(F.col("_at") / F.pow(F.lit(2.0), F.col("_level_p"))))
    same = (F.col("_level") == F.col("_level_p")) & (F.col("_number") == F.col("_number_p"))
    return placed.join(listed, same).drop("_at", "_level", "_number", "_level_p", "_number_p")


def overlap_join(
    spans: DataFrame, periods: DataFrame, span: tuple[str, str], period: tuple[str, str]
) -> DataFrame:
    """The same pairs where both sides are large.

    Two intervals overlap if one begins inside the other: either the period begins in the span, or the span begins in the
    period, after its beginning. Both are joins of points with intervals, see ``_points_in``; their work grows with the
    rows and the pairs found. A span whose ``from`` lies after its ``to`` matches the periods that cover both, and a
    period given the wrong way round the spans that cover it. Intervals with a missing end match nothing.
    """
    (lo, hi), (start, end) = span, period
    spans = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    periods = periods.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    straight_span, straight_period = F.col(lo) <= F.col(hi), F.col(start) <= F.col(end)
    exact = _overlaps(F.col(lo), F.col(hi), F.col(start), F.col(end))
    columns = [*spans.columns, *periods.columns]
    begins = _points_in(
        periods, _day(F.least(start, end)), spans.where(straight_span), _day(lo), _day(hi)).where(exact).select(*columns)
    inside = _points_in(
        spans, _day(F.least(lo, hi)), periods.where(straight_period), _day(start), _day(end)
    ).where(exact & (~straight_span | (F.col(lo) > F.col(start)))).select(*columns)
    return begins.unionByName(inside)
