"""Joins, set operations and group filters with explicit null rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle


def same_keys(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], null_safe: bool) -> Column:
    """Equality of paired columns, optionally with null equal to null."""
    tests = [
        left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        for a, b in pairs.items()
    ]
    return reduce(lambda a, b: a & b, tests)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _aside(df: DataFrame, columns: Iterable[str], prefix: str = "_r_") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in columns})


def merge(
    left: DataFrame,
    right: DataFrame,
    by: Iterable[str] | None = None,
    how: str = "inner",
    *,
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on ``by``, or on all shared names (a natural join) when it is omitted.

    A null key matches a null key unless ``null_safe`` is off, which keeps the
    keys' partitioning usable for the next step and is right for keys that are
    never null. Clashing other columns get suffixes.
    """
    by = list(by) if by else shared_columns(left, right)
    clash = [c for c in shared_columns(left, right) if c not in by]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = _aside(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), by)
    joined = left.join(right, same_keys(left, right, {k: "_r_" + k for k in by}, null_safe), how)
    if how in ("right", "full", "outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col("_r_" + k)) for k in by})
    return joined.drop(*["_r_" + k for k in by])


def semi(df: DataFrame, keep: DataFrame, by: Iterable[str], *, null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keep``."""
    keep = _aside(keep.select(*by), by)
    return df.join(keep, same_keys(df, keep, {k: "_r_" + k for k in by}, null_safe), "left_semi")


def anti(
    df: DataFrame, drop: DataFrame, by: Iterable[str] | None = None, *, null_safe: bool | None = None
) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``drop``.

    Without ``by`` all shared columns count, null equal to null: the row-set
    difference that keeps duplicates of ``df``.
    """
    if null_safe is None:
        null_safe = by is None
    by = list(by) if by else shared_columns(df, drop)
    drop = _aside(drop.select(*by), by)
    return df.join(drop, same_keys(df, drop, {k: "_r_" + k for k in by}, null_safe), "left_anti")


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    values: Mapping[str, str],
    how: str = "left",
    *,
    null_safe: bool = False,
) -> DataFrame:
    """Attach columns of a keyed table under new names.

    ``on`` maps columns of ``df`` to key columns of ``dim``; ``values`` maps
    columns of ``dim`` to the names they get. One table can be attached several
    times in different roles; Spark then reuses its exchange. A null key finds the
    row with the null key if ``null_safe``, as merges do, and nothing otherwise,
    which is right for roles a row may not have (no destination, no period).
    """
    side = dim.select(
        *[F.col(k).alias("_k_" + k) for k in on.values()],
        *[F.col(v).alias(name) for v, name in values.items()],
    )
    cond = same_keys(df, side, {a: "_k_" + b for a, b in on.items()}, null_safe)
    return df.join(side, cond, how).drop(*["_k_" + k for k in on.values()])


def merge_settled(
    rows: DataFrame, per_key: DataFrame, by: Iterable[str], how: str = "inner", *, null_safe: bool = False
) -> DataFrame:
    """Join rows with a table of one row per key that was aggregated by that key.

    Joined directly, an aggregate keeps the partitioning it was made with, and Spark cannot split a hot key. Settled,
    it is a table like any other: small ones are broadcast by Spark's own size check, for large ones both sides are
    shuffled for the join and hot keys are split at run time. ``how`` is inner, left, left_semi or left_anti.
    """
    return merge(rows, settle(per_key), by, how, null_safe=null_safe)


def keep_groups(df: DataFrame, keys: Iterable[str], test) -> DataFrame:
    """Rows of the groups whose row count passes ``test(count)``.

    Counts are pre-aggregated, so the rows themselves are only filtered.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(test(F.col("_n"))).select(*keys)
    return merge_settled(df, sizes, keys, "left_semi", null_safe=True)


def keep_group_max(df: DataFrame, keys: Iterable[str], column: str) -> DataFrame:
    """Rows equal to their group's largest value, ties kept."""
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(column).alias("_top"))
    return merge_settled(df, top, keys, null_safe=True).where(F.col(column) == F.col("_top")).drop("_top")


def with_group_count(df: DataFrame, keys: Iterable[str], name: str) -> DataFrame:
    """Add the row count of each row's group."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return merge_settled(df, sizes, keys, null_safe=True)


def equal_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do both tables hold the same rows the same number of times?

    Counts and the differences per row content are aggregated, never collected.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_side")).unionByName(
        right.select(*columns, F.lit(-1).alias("_side"))
    )
    per_row = both.groupBy(*columns).agg(F.sum("_side").alias("_diff"))
    return per_row.agg(
        F.coalesce(F.sum(F.abs("_diff")), F.lit(0)).alias("unmatched_rows"),
        (F.coalesce(F.sum(F.abs("_diff")), F.lit(0)) == 0).alias("equal"),
    )


#: Into how many ranges each level of a comparison divides a range, and how many levels there are.
RANGES, DEPTH = 4096, 2


def differences(left: DataFrame, right: DataFrame, keys: Iterable[str], *, ranges: int = RANGES, depth: int = DEPTH) -> DataFrame:
    """Keys at which two tables differ: the keys, ``rows_left``, ``rows_right`` and the ``columns`` that differ.

    Keys need not be unique: the rows of a key are compared as a bag, column by column. ``columns`` is empty where only
    their number differs, or the rows of one side are missing; a null equals a null.

    Rows are summed up to fingerprints, a count and two sums of hashes per column, for each of ``ranges`` ranges of
    hashed keys; only ranges whose fingerprints differ are divided again, ``depth`` times, and only the rows of the last
    differing ranges meet their keys. Equal ranges exchange one small row per task and range. Tables with few differences
    are so compared by scans; different rows with equal hashes of 64 bits would go unseen.
    """
    keys = list(keys)
    rest = [c for c in left.columns if c not in keys]
    hashed = F.xxhash64(*keys)
    level = lambda d: F.pmod(F.shiftright(hashed, 12 * d), F.lit(ranges)).cast("int")

    def fingerprints(df: DataFrame, by: list[str], side: str) -> DataFrame:
        parts = [F.count(F.lit(1)).alias(f"{side}_n")]
        for i, c in enumerate(rest):
            h = F.xxhash64(*keys, F.col(c).isNull(), c)
            parts.append(F.struct(F.bit_xor(h), F.sum(F.pmod(h, F.lit(2**31)))).alias(f"{side}_{i}"))
        return df.groupBy(*by).agg(*parts)

    def compared(by: list[str]) -> DataFrame:
        other = fingerprints(right, by, "r")
        here = fingerprints(left, by, "l")
        return merge(here, other, by, "full").withColumns({s: F.coalesce(s, F.lit(0)) for s in ("l_n", "r_n")})

    unequal = lambda i: ~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}"))
    for d in range(depth):
        place = f"_range_{d}"
        left, right = left.withColumn(place, level(d)), right.withColumn(place, level(d))
        by = [f"_range_{k}" for k in range(d + 1)]
        differ = reduce(lambda a, b: a | b, [unequal(i) for i in range(len(rest))], F.col("l_n") != F.col("r_n"))
        found = settle(compared(by).where(differ).select(*by))
        left, right = semi(left, found, by), semi(right, found, by)
    there = (F.col("l_n") > 0) & (F.col("r_n") > 0)
    named = F.filter(F.array(*[F.when(there & unequal(i), F.lit(c)) for i, c in enumerate(rest)]), lambda c: c.isNotNull()) \
        if rest else F.expr("cast(array() as array<string>)")
    out = compared(keys).withColumn("columns", named)
    return out.where((F.col("l_n") != F.col("r_n")) | (F.size("columns") > 0)).select(
        *keys, F.col("l_n").alias("rows_left"), F.col("r_n").alias("rows_right"), "columns")
