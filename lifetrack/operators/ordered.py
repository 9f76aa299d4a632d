"""First, last and n-th rows, running totals and gap filling inside groups.

The first or last row of a group is the smallest or largest struct of its
columns: an aggregate, so each task reduces a hot group to one row before the
exchange, also behind a join that Spark splits for skew. The n-th row filters on
``row_number() = n``, which Spark limits to n rows per group and task. Rules that
need every row in order (running totals, fills) are scans over parts of one
order, with what a group brings along from earlier parts added: see ``Scan``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle_by
from .joins import same_keys


def _pick(df: DataFrame, keys: Iterable[str], place, best) -> DataFrame:
    """One row per group: the one whose ``place`` columns are smallest or largest."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[e.alias(f"_{i}") for i, e in enumerate(place)], *rest)
    picked = df.groupBy(*keys).agg(best(row).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def first_by(df: DataFrame, keys, order: str, tie: str) -> DataFrame:
    """The row with the smallest ``order`` per group, ties broken by the smallest ``tie``.

    Null values never win; a group holding only nulls disappears.
    """
    return _pick(df.where(F.col(order).isNotNull()), keys, [F.col(order), F.col(tie)], F.min)


def last_by(df: DataFrame, keys, order: str, tie: str) -> DataFrame:
    """The row with the largest ``order`` per group, ties broken by the smallest ``tie``, a whole number."""
    place = [F.col(order), F.bitwise_not(F.col(tie))]
    return _pick(df.where(F.col(order).isNotNull()), keys, place, F.max)


def drop_first_dup(df: DataFrame, keys, order: str, tie: str) -> DataFrame:
    """Keep the earliest row per key; null order values come last but count."""
    place = [F.col(order).isNull(), F.col(order), F.col(tie)]
    return _pick(df, keys, place, F.min)


def nth_by(df: DataFrame, keys, order: str, tie: str, n: int) -> DataFrame:
    """The n-th row of each group, nulls ordered last; smaller groups drop out."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order), F.asc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == n).drop("_rn")


class Scan:
    """Rows in the order of (keys, order, tie), cut into parts of like size, wherever groups begin or end.

    Rows are dealt by ranges of that order, nulls of ``order`` last and NaN before them, and written once, bucketed by
    their part: a hot group, or one value that most rows share, is spread over as many parts as it needs, the windows
    inside a part need no further exchange, and a recomputed task sees the same parts. ``tie`` tells the rows of a
    group apart; rows with equal ties stand in any order. Parts and groups meet in at most two rows per part, the
    first and the last group in it: only these can reach into another part, so what earlier or later parts bring along
    is one small table. The same plan holds for any number of rows, also for none.

    ``parts`` is the number of parts, by default what Spark makes of the size of the rows.
    """

    def __init__(self, df: DataFrame, keys: Iterable[str], order: str, tie: str, *, parts: int | None = None):
        self.keys, self.order, self.tie, self.columns = list(keys), order, tie, df.columns
        place = [*[F.asc_nulls_first(k) for k in self.keys], F.asc_nulls_last(order), F.asc(tie)]
        dealt = df.repartitionByRange(parts, *place) if parts else df.repartitionByRange(*place)
        self.rows = settle_by(dealt.withColumn("_part", F.spark_partition_id()), "_part")
        self.inside = Window.partitionBy("_part", *self.keys)

    def upto(self):
        """The rows of a group in this part up to the current one."""
        w = self.inside.orderBy(F.asc_nulls_last(self.order), F.asc(self.tie))
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def onward(self):
        """The rows from the current one on: a frame in reverse order, as one reaching forward is computed anew for every row."""
        w = self.inside.orderBy(F.desc_nulls_first(self.order), F.desc(self.tie))
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def place(self) -> Column:
        """A value that orders the rows of a group."""
        return F.struct(F.col(self.order).isNull(), self.order, self.tie)

    def brought(self, parts: dict[str, Column], carries: Callable[[Window, Window], dict[str, Column]]) -> DataFrame:
        """What other parts bring to the groups at the borders: a row per part and such group, two per part at most.

        ``parts`` are aggregates over a group's rows in one part; ``carries`` makes columns of them, given windows over
        the same group's earlier and later parts.
        """
        per_group = self.rows.groupBy("_part", *self.keys).agg(*[e.alias(name) for name, e in parts.items()])
        if self.keys:
            key = F.struct(*self.keys)
            ends = per_group.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
            ends = ends.withColumnRenamed("_part", "_p")
            at_end = (F.col("_part") == F.col("_p")) & (key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
            per_group = per_group.join(F.broadcast(ends), at_end).drop("_p", "_low", "_high")
        group = Window.partitionBy(*self.keys)
        others = (Window.unboundedPreceding, -1)
        earlier = group.orderBy(F.asc("_part")).rowsBetween(*others)
        later = group.orderBy(F.desc("_part")).rowsBetween(*others)
        columns = carries(earlier, later)
        return per_group.select("_part", *self.keys, *[e.alias(name) for name, e in columns.items()])

    def add(self, rows: DataFrame, brought: DataFrame) -> DataFrame:
        """Attach what was brought; rows of other groups get nulls."""
        side = brought.withColumnsRenamed({c: "_b_" + c for c in ["_part", *self.keys]})
        same = (rows["_part"] == side["_b__part"]) & same_keys(rows, side, {k: "_b_" + k for k in self.keys}, True) \
            if self.keys else rows["_part"] == side["_b__part"]
        return rows.join(F.broadcast(side), same, "left").drop(*["_b_" + c for c in ["_part", *self.keys]])

    def total(self, amount: Column, name: str) -> DataFrame:
        """The rows with the running total of ``amount``, current row included, and the part they are in."""
        brought = self.brought({"_sum": F.sum(amount)}, lambda earlier, later: {"_carry": F.sum("_sum").over(earlier)})
        out = self.add(self.rows.withColumn(name, F.sum(amount).over(self.upto())), brought)
        total = F.coalesce(F.col(name) + F.col("_carry"), F.col(name), F.col("_carry"))
        return out.withColumn(name, total).drop("_carry")


def running_total(
    df: DataFrame, keys: Iterable[str], order: str, tie: str, amount: Column, name: str, *, parts: int | None = None
) -> DataFrame:
    """Running total of ``amount`` per group in (order, tie), current row included, null orders last."""
    return Scan(df, keys, order, tie, parts=parts).total(amount, name).drop("_part")


def numbered(
    df: DataFrame, keys: Iterable[str], order: str, tie: str, name: str, *, parts: int | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in (order, tie), null orders last."""
    return running_total(df, keys, order, tie, F.lit(1).cast("long"), name, parts=parts)


def nearest_known(
    df: DataFrame,
    keys: Iterable[str],
    order: str,
    tie: str,
    value: str,
    *,
    before: str = "prev_known",
    after: str = "next_known",
    parts: int | None = None,
) -> DataFrame:
    """Add the last known value up to each row and the first known one from it on; null orders come last."""
    scan = Scan(df, keys, order, tie, parts=parts)
    known = F.last(value, ignorenulls=True)
    out = scan.rows.withColumns({before: known.over(scan.upto()), after: known.over(scan.onward())})
    there = F.col(value).isNotNull()
    ends = {
        "_first": F.min_by(F.when(there, F.col(value)), F.when(there, scan.place())),
        "_last": F.max_by(F.when(there, F.col(value)), F.when(there, scan.place())),
    }
    carry = lambda c, w: F.last(c, ignorenulls=True).over(w)
    brought = scan.brought(ends, lambda earlier, later: {
        "_carry_before": carry("_last", earlier), "_carry_after": carry("_first", later)})
    return scan.add(out, brought).withColumns({
        before: F.coalesce(before, "_carry_before"),
        after: F.coalesce(after, "_carry_after"),
    }).drop("_carry_before", "_carry_after", "_part")


def fill_nearest(
    df: DataFrame, keys, order: str, tie: str, value: str, direction: str, *, parts: int | None = None
) -> DataFrame:
    """Fill nulls of ``value``: ``updown`` looks ahead first, ``downup`` looks back first."""
    pair = {"updown": ("_after", "_before"), "downup": ("_before", "_after")}[direction]
    out = nearest_known(df, keys, order, tie, value, before="_before", after="_after", parts=parts)
    return out.withColumn(value, F.coalesce(*pair)).drop("_before", "_after")


def as_of(
    left: DataFrame, right: DataFrame, keys: Iterable[str], on: tuple[str, str], *, tie: str, take: Mapping[str, str],
    count: str | None = None, strict: bool = False, parts: int | None = None,
) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key that is not later; with ``strict``, that is earlier.

    ``on`` names the time in each table, ``take`` columns of ``right`` and the names they get, ``tie`` the column of
    ``right`` by which the last of several rows of one time is the one with the largest value; ``count`` names a column
    for the number of such rows. Both tables are one stream per key in time order, along which the last row of ``right``
    is carried: no row of one side meets more than one of the other. A null key is a key like any other; a row of
    ``left`` without a time, or with nothing before it, gets nulls and a count of 0; rows of ``right`` without a time
    are left out.
    """
    keys, (at_l, at_r) = list(keys), on
    key = [F.col(k) for k in keys]
    taken = F.struct(*[F.col(c).alias(name) for c, name in take.items()])
    came = right.where(F.col(at_r).isNotNull()).select(
        *key, F.col(at_r).alias("_at"), F.struct(F.lit(1 if strict else 0).alias("side"), F.col(tie).alias("tie")).alias("_tie"),
        taken.alias("_row"))
    asks = left.select(
        *key, F.col(at_l).alias("_at"),
        F.struct(F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("tie")).alias("_tie"),
        F.struct(*left.columns).alias("_left"))
    scan = Scan(came.unionByName(asks, allowMissingColumns=True), keys, "_at", "_tie", parts=parts)
    there = F.col("_row").isNotNull()
    last = lambda w: F.last("_row", ignorenulls=True).over(w)
    out = scan.rows.withColumns({"_found": last(scan.upto()), "_n": F.count("_row").over(scan.upto())})
    ends = {"_end": F.max_by(F.when(there, F.col("_row")), F.when(there, scan.place())), "_came": F.count("_row")}
    brought = scan.brought(ends, lambda earlier, later: {
        "_before": F.last("_end", ignorenulls=True).over(earlier), "_more": F.sum("_came").over(earlier)})
    out = scan.add(out, brought).where(F.col("_left").isNotNull())
    timed = F.col("_at").isNotNull()
    found = F.when(timed, F.coalesce("_found", "_before"))
    n = F.when(timed, F.col("_n") + F.coalesce("_more", F.lit(0))).otherwise(0)
    own = {c for c in take.values() if c in left.columns}
    if own:
        raise ValueError(f"columns of both sides: {sorted(own)}")
    return out.select(
        *[F.col("_left").getField(c).alias(c) for c in left.columns], *[found[name].alias(name) for name in take.values()],
        *([n.alias(count)] if count else []))
