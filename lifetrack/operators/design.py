"""Model-ready tables: typed frames, aligned repeats, trait-stacked design."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import cast_columns, ifelse
from .joins import merge, merge_settled
from .ordered import numbered


def typed_model_frame(df: DataFrame, types: Mapping[str, str], sex: str = "sex") -> DataFrame:
    """Cast columns and recode the sex estimate: 1 is M, others F, unknown stays null."""
    return cast_columns(df, types).withColumn(sex, ifelse(F.col(sex) == 1, "M", "F"))


def movers_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("moved") == "1")


def complete_for(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with no null in the given columns."""
    return df.dropna(how="any", subset=list(columns))


def attach_transformed(df: DataFrame, transformed: DataFrame) -> DataFrame:
    """Merge transformed per-entity responses back, by entity alone."""
    return merge_settled(df, transformed, ["entity"], "left")


def align_repeats(
    responses: DataFrame, assays: DataFrame, order: str, tie: str, response_order: str,
    response_tie: str, *, parts: int | None = None,
) -> DataFrame:
    """Pair the n-th distinct response row of an entity with its n-th assay.

    Responses with equal ``response_order`` follow ``response_tie``, a number that
    tells the distinct rows of an entity apart. A response that occurs once per entity so stands beside one assay only and
    is null beside the others.
    """
    distinct = responses.distinct()
    left = numbered(distinct, ["entity"], response_order, response_tie, "assay_number", parts=parts)
    right = numbered(assays, ["entity"], order, tie, "assay_number", parts=parts)
    return merge(left, right, ["entity", "assay_number"], "full", null_safe=False)


def bivariate_design(
    df: DataFrame,
    traits: Mapping[str, str],
    *,
    shared: Mapping[str, Iterable] | None = None,
    numeric: Mapping[str, Iterable[str]] | None = None,
    categorical: Mapping[str, Mapping[str, Iterable]] | None = None,
    keep: Iterable[str] = ("entity",),
) -> DataFrame:
    """Stack the responses and spell out the design columns of a two-trait model.

    ``traits`` maps trait labels to response columns. Each trait gets an
    indicator column. ``shared`` lists categorical columns, with their levels,
    that get an effect in every trait; ``numeric`` and ``categorical`` list the
    covariates of one trait only, zero for the others. The first level of a
    categorical column is its baseline. Rows without a response are dropped.
    """
    labels = list(traits)
    stacked = df.select(
        "*",
        F.inline(F.array(*[
            F.struct(F.lit(t).alias("trait"), F.col(c).cast("double").alias("y")) for t, c in traits.items()
        ])),
    ).where(F.col("y").isNotNull())
    on = lambda t: (F.col("trait") == t).cast("double")
    is_level = lambda c, v: (F.col(c) == F.lit(v)).cast("double")
    columns = {f"trait_{t}": on(t) for t in labels}
    for c, levels in (shared or {}).items():
        for t in labels:
            for v in list(levels)[1:]:
                columns[f"{t}_{c}_{v}"] = on(t) * is_level(c, v)
    at_trait = lambda t, value: F.when(F.col("trait") == t, value).otherwise(F.lit(0.0))
    for t, names in (numeric or {}).items():
        for c in names:
            columns[f"{t}_{c}"] = at_trait(t, F.col(c).cast("double"))
    for t, factors in (categorical or {}).items():
        for c, levels in factors.items():
            for v in list(levels)[1:]:
                columns[f"{t}_{c}_{v}"] = at_trait(t, is_level(c, v))
    return stacked.select(*keep, "trait", "y", *[e.alias(n) for n, e in columns.items()])
