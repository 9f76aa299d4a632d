"""The movement table: one row per dated mover or usable non-mover."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import WIDE_WINTER
from ..operators.movement import (
    always_subordinate, dominance, inheritors, movement_events, origin_status_fill,
)
from ..operators.periods import period_chain, previous_period
from ..operators.residency import StatusRoles, life_profile, moves
from ..session import settle

COLUMNS = (
    "entity", "origin", "last_period", "last_start", "last_end",
    "second_last_period", "second_last_start", "second_last_end", "inherit", "moved",
    "tested_before", "method", "event_date", "event_month", "event_season",
    "dest_status", "dest_dominance", "dest_start", "dest_end", "dest_location", "dest_period",
    "origin_status", "origin_dominance",
)


def movement_table(
    residency: DataFrame,
    sightings: DataFrame,
    periods: DataFrame,
    births: DataFrame,
    *,
    roles: StatusRoles = StatusRoles(),
    exclude_periods: Iterable = (),
    winter: Iterable[int] = WIDE_WINTER,
) -> DataFrame:
    """Movers with their event, and non-movers with their last periods as subordinates.

    ``births`` holds ``entity, birth_date``. The per-entity profile is settled
    because movers and non-movers both read it. Several covariates read the
    result: write it, or settle it, before joining separate covariate tables.
    """
    chain = period_chain(periods, exclude_periods)
    life = settle(life_profile(residency, roles))
    events = movement_events(
        moves(life), residency, sightings, floating=roles.floating, winter=winter
    )
    events = origin_status_fill(previous_period(events, chain))
    moved = dominance(events, roles.dominant, roles.subordinate).withColumns({
        "moved": F.lit("1"), "tested_before": F.lit("UNK"),
    })
    stayed = inheritors(life, chain, births, roles.dominant_at_home).unionByName(
        always_subordinate(life, chain, roles.dominant_at_home)
    ).withColumn("moved", F.lit("0"))
    return stayed.unionByName(moved, allowMissingColumns=True).select(*COLUMNS)
