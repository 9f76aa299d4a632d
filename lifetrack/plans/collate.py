"""The wide table: one row per entity with all covariates, then one per assay."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators.joins import merge, merge_settled
from ..session import settle_by


def by_entity(table: DataFrame) -> DataFrame:
    """A table of one row per entity as a store bucketed by entity: joined with others of its kind it moves no rows."""
    return settle_by(table.repartition("entity"), "entity")


def collate_wide(
    movement: DataFrame, required: Iterable[DataFrame], optional: Iterable[DataFrame] = ()
) -> DataFrame:
    """Join per-entity tables to the movement rows by entity.

    Rows must occur in every required table; optional tables only add columns.
    All joins share one key: tables stored ``by_entity`` meet bucket by bucket,
    and of others all but the first reuse the partitioning made for it.
    """
    out = movement
    for table, how in [*((t, "inner") for t in required), *((t, "left") for t in optional)]:
        out = merge(out, table, ["entity"], how, null_safe=False)
    return out


def with_assays(wide: DataFrame, assays: DataFrame) -> DataFrame:
    """One row per assay of the entities in the wide table."""
    return merge_settled(assays, wide, ["entity"])
