"""Summaries of a long table of posterior draws.

A draw is ``model, chain, iteration, parameter, value``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import merge_settled
from .ordered import Scan, first_by


def wide_draws(draws: DataFrame, parameters: Iterable[str], by=("model", "chain", "iteration")) -> DataFrame:
    """One row per draw with the named parameters as columns."""
    picks = [F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters]
    wanted = draws.where(F.col("parameter").isin(list(parameters)))
    return wanted.groupBy(*by).agg(*picks)


def _over(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as doubles have it: over zero it is infinite, or NaN for zero itself, and not an error."""
    return F.when(bottom == 0, top * F.pow(bottom, F.lit(-1.0))).otherwise(top / bottom)


def posterior_ratio(draws: DataFrame, part: str, rest: str, by=("model", "chain", "iteration")) -> DataFrame:
    """Per draw: part / (part + rest), the share of variance between entities."""
    both = wide_draws(draws, [part, rest], by)
    return both.select(*by, (F.col(part) / (F.col(part) + F.col(rest))).alias("value"))


def posterior_correlation(
    draws: DataFrame, covariance: str, first: str, second: str, by=("model", "chain", "iteration")
) -> DataFrame:
    """Per draw: covariance over the product of both standard deviations; see ``_over`` for a variance of zero."""
    all3 = wide_draws(draws, [covariance, first, second], by)
    r = _over(F.col(covariance), F.sqrt(first) * F.sqrt(second))
    return all3.select(*by, r.alias("value"))


def posterior_mean(derived: DataFrame, by=("model",)) -> DataFrame:
    """Mean of the known draws; one that is infinite or NaN makes the mean so."""
    return derived.groupBy(*by).agg(F.avg("value").alias("mean"))


def hpd_interval(
    draws: DataFrame, keys: Iterable[str] = ("model", "parameter"), prob: float = 0.95, *,
    parts: int | None = None, rank_blocks: int = 1024,
) -> DataFrame:
    """Shortest interval holding ``prob`` of the draws per key, chains of a model pooled; the lowest one on ties.

    With n sorted draws it spans ``max(1, min(n - 1, round(prob * n)))`` steps.
    Equal draws are counted together first and ranked in one ordered scan. An
    interval of least width always starts at the first of several equal draws, so
    each distinct value whose span still fits is one candidate; its upper end is
    the distinct value whose ranks cover start plus span. Ranks are known exactly
    by then, so candidates and the values that can be upper ends, both tails only,
    meet in blocks of equal numbers of ranks (``rank_blocks`` per key): a value of
    many equal draws stands in every block that its ranks touch.
    """
    keys = list(keys)
    known = draws.where(F.col("value").isNotNull())
    counted = known.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    scan = Scan(counted, keys, "value", "_n", parts=parts)
    sizes = scan.rows.groupBy(*keys).agg(F.sum("_n").alias("n"))
    span = F.greatest(
        F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * F.lit(prob)).cast("long"))
    )
    sizes = sizes.withColumns({"_span": span, "_width": F.ceil(F.col("n") / rank_blocks)})
    ranked = merge_settled(scan.total(F.col("_n"), "_upto"), sizes, keys, null_safe=True)
    start = F.col("_upto") - F.col("_n") + 1
    block = lambda rank: F.floor(rank / F.col("_width"))

    def mark(block, rank, side, value, lower):
        null = F.lit(None).cast("double")
        return F.struct(
            block.alias("_block"), rank.alias("_rank"), F.lit(side).alias("_side"),
            (null if value is None else value).alias("value"), (null if lower is None else lower).alias("lower"))

    first_end, target = F.greatest(start, F.col("_span") + 1), start + F.col("_span")
    ends = F.transform(
        F.sequence(block(first_end), block(F.col("_upto"))), lambda b: mark(b, first_end, 0, F.col("value"), None))
    asks = F.array(mark(block(target), target, 1, None, F.col("value")))
    none = F.array()
    marks = F.concat(
        F.when(F.col("_upto") > F.col("_span"), ends).otherwise(none), F.when(target <= F.col("n"), asks).otherwise(none))
    w = Window.partitionBy(*keys, "_block").orderBy("_rank", "_side")
    upper = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranked.select(*keys, "n", F.inline(marks)).withColumn("upper", upper)
    intervals = placed.where(F.col("_side") == 1).select(
        *keys, "n", "lower", "upper", (F.col("upper") - F.col("lower")).alias("width")
    )
    return first_by(intervals, keys, "width", "lower")
