"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import digest, fraction, free_names, full_text, let

#: A rate above this is the sum of so many equal Poisson draws: exp(-rate) stays far from underflow, tables short.
LARGEST_RATE = 16
#: P(more than 96) at rate 16 is under 2e-41, below the step of a 52-bit draw.
LARGEST_DRAW = 96


def rates(
    docs: DataFrame,
    *,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    by: str = "source",
    text: str = "text",
    total: float | None = None,
) -> DataFrame:
    """One row per source: ``source``, ``bytes`` and ``rate``, how often a text of it is to be read on average.

    The target share of a source is its entry in ``weights`` (0 if absent), or its bytes to the power ``power``;
    shares are scaled to 1. The mixture has ``total`` bytes, by default as many as the input. A byte is added to each
    text, so sources of empty texts have a size as well. Null is a source of its own, with no entry in ``weights``.
    """
    size = (F.octet_length(full_text(docs[f"`{text}`"])) + 1).cast("bigint")
    sizes = docs.select(docs[f"`{by}`"].cast("string").alias("source"), size.alias("bytes"))
    sizes = settle(sizes.groupBy("source").agg(F.sum("bytes").alias("bytes")))
    if weights is None:
        share = F.sqrt(F.col("bytes")) if power == 0.5 else F.pow(F.col("bytes"), F.lit(power))
    elif weights:
        listed = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (str(k), float(v))])
        share = F.coalesce(F.element_at(listed, F.coalesce("source", F.lit(""))), F.lit(0.0))
        share = F.when(F.col("source").isNull(), 0.0).otherwise(share)
    else:
        raise ValueError("weights must name a source")
    sizes = sizes.withColumn("share", share)
    sums = sizes.agg(F.sum("share").alias("shares"), F.sum("bytes").alias("all_bytes")).first()
    if not sums["shares"]:
        return sizes.select("source", "bytes", F.lit(0.0).alias("rate"))
    goal = float(sums["all_bytes"] if total is None else total)
    return sizes.select("source", "bytes", (F.col("share") / F.lit(sums["shares"]) * F.lit(goal) / F.col("bytes")).alias("rate"))


def _below(rate):
    """Poisson distribution function at 0, 1, ... LARGEST_DRAW as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s, k):
        p = s["p"] * rate / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(s["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST_DRAW)), start, step, lambda s: s["all"])


def replicate(
    docs: DataFrame,
    rate_table: DataFrame | None = None,
    *,
    by: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: int = 29,
    keep: list[str] | None = None,
    **targets,
) -> DataFrame:
    """Repeat each row a Poisson number of times, with its source's rate as the mean, in a globally random order.

    The draw inverts the distribution at a number hashed from seed, key and text, so it is the same however often and
    wherever it is computed. Returns the columns ``keep`` (default: all), ``copy`` (1, 2, ...), ``rate`` and
    ``order_key``, in place of columns of those names. Rows are dealt to partitions by ``order_key``, a digest, and
    sorted by it inside: any order of the partitions is a random order of the corpus.

    Null sources, keys and texts take part like others. Repeated rows are drawn alike, each for itself. Rows of rate 0
    go. An empty table gives an empty table.
    """
    made = ("copy", "rate", "order_key")
    keep = [c for c in (keep or docs.columns) if c.lower() not in made]
    src, below, pieces, who, times = free_names([*keep, *made], "_src", "_below", "_pieces", "_who", "_times")
    table = rates(docs, by=by, text=text, **targets) if rate_table is None else rate_table
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE).cast("int"))
    table = table.select(F.col("source").alias(src + "_r"), "rate", parts.alias(pieces))
    table = settle(table.withColumn(below, _below(F.col("rate") / F.col(pieces))))
    rows = docs.select(
        *[docs[f"`{c}`"] for c in keep],
        docs[f"`{by}`"].cast("string").alias(src),
        digest(seed, docs[f"`{key}`"], F.md5(full_text(docs[f"`{text}`"]).cast("binary"))).alias(who),
    )
    rows = rows.join(table, rows[src].eqNullSafe(table[src + "_r"]))

    def draw(part, who_, below_):
        u = fraction(F.md5(F.concat_ws(":", who_, part.cast("string"))))
        return let(u, lambda v: F.size(F.filter(below_, lambda c: c <= v)))

    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(pieces)), F.lit(0).cast("bigint"),
        lambda total, part: total + draw(part, F.col(who), F.col(below)).cast("bigint"),
    )
    rows = rows.withColumn(times, drawn).where(F.col(times) > 0).drop(below, pieces)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))))
    rows = rows.withColumn("order_key", digest(seed + 1, F.col(who), F.col("copy")))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "copy", "rate", "order_key")
    return rows.repartition("order_key").sortWithinPartitions("order_key")
