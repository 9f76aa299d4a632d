"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import running_total
from ..session import settle
from .common import digest, fraction, free_names, full_text

#: Rows that one window task sorts, about.
ROWS_PER_CELL = 8192


def interleave(
    docs: DataFrame,
    *,
    shards: int,
    by: str = "source",
    key: str = "doc_id",
    content: str = "text",
    keep: list[str] | None = None,
    seed: int = 17,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Deal rows to shards so that each holds every source in the corpus' proportion.

    The rows of a source are put in a seeded random order (a digest of ``key`` and ``content``). The r-th of n
    gets the fractional rank (r - 1/2) / n. Sorted by it, ties by source, the sources are evenly interleaved, and
    equal cuts give shards whose row counts, in all and by source, differ by at most one or two.

    Returns the columns ``keep`` (default: all) with ``shard`` (from 0) and ``slot`` (from 0 without gaps inside a
    shard) in place of columns of those names. Null is a source of its own; null keys and texts are dealt like any
    other; repeated rows are dealt one by one and are interchangeable; an empty table gives an empty table.

    Neither order needs one large sort. Digests are uniform, so cells of equal width in a source hold about
    ``rows_per_cell`` rows, whatever the source's share; the rank is the count in the cells before plus the place in
    the cell. Cells of fractional ranks are counted and added up the same way: work and tables grow with the rows, however
    many sources there are.
    """
    keep = [c for c in (keep or docs.columns) if c.lower() not in ("shard", "slot")]
    src, h, n, cells, cell, before, rank, across, place, total = free_names(
        [*keep, "shard", "slot"], "_src", "_h", "_n", "_cells", "_cell", "_before", "_rank", "_across", "_place", "_total"
    )
    spark = docs.sparkSession
    group = docs[f"`{by}`"].cast("string")
    sizes = settle(docs.select(group.alias(src)).groupBy(src).agg(F.count(F.lit(1)).alias(n)))
    count = sizes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    wide = max(1, -(-count // rows_per_cell))

    rows = docs.select(
        *[docs[f"`{c}`"] for c in keep],
        group.alias(src),
        digest(seed, docs[f"`{key}`"], F.md5(full_text(docs[f"`{content}`"]).cast("binary"))).alias(h),
    )
    rows = _with(rows, sizes, [src])
    rows = rows.withColumn(cell, F.floor(fraction(F.col(h)) * F.ceil(F.col(n) / rows_per_cell)))
    counts = settle(rows.groupBy(src, cell).agg(F.count(F.lit(1)).alias(cells)))
    earlier = Window.partitionBy(src).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(src, cell, F.coalesce(F.sum(cells).over(earlier), F.lit(0)).alias(before))
    rows = _with(rows, starts, [src, cell])
    inside = F.row_number().over(Window.partitionBy(src, cell).orderBy(h))
    rows = rows.withColumn(rank, F.col(before) + inside)

    # Cells of fractional rank in whole numbers: no rounding decides where a row counts.
    odd = 2 * F.col(rank) - 1
    rows = rows.withColumn(across, F.expr(f"((2 * `{rank}` - 1) * {wide}L) div (2 * `{n}`)"))
    rows = rows.withColumn(place, odd / (2 * F.col(n)))
    counted = rows.groupBy(across).agg(F.count(F.lit(1)).alias(total))
    offsets = running_total(counted, [], across, across, F.col(total), before)
    rows = rows.drop(before)
    rows = _with(rows, settle(offsets.select(across, (F.col(before) - F.col(total)).alias(total))), [across])
    order = Window.partitionBy(across).orderBy(F.asc(place), F.asc_nulls_first(src), F.asc(h))
    rows = rows.withColumn(place, F.col(total) + F.row_number().over(order) - 1)
    shard = F.expr(f"cast((`{place}` * {shards}L) div {max(1, count)}L as int)")
    rows = rows.withColumn("shard", shard)
    slot = F.col(place) - F.expr(f"(shard * {max(1, count)}L + {shards - 1}L) div {shards}L")
    return rows.select(*[F.col(f"`{c}`") for c in keep], "shard", slot.cast("int").alias("slot"))


def _with(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with a settled table of one row per key, null equal to null."""
    other = small.withColumnsRenamed({k: k + "_r" for k in on})
    same: Column = F.lit(True)
    for k in on:
        same = same & rows[k].eqNullSafe(other[k + "_r"])
    return rows.join(other, same).drop(*[k + "_r" for k in on])
