"""Queries for dating moves and for the movement table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import NARROW_WINTER, month_abbr, season, season_from_index
from ..operators import movement as move_ops
from ..operators.covariates import summer_winter_split
from ..operators.joins import lookup
from ..operators.periods import period_chain, previous_period
from ..operators.residency import life_profile, lost_entities, moves, origin_location
from ..session import settle
from ..sources import star
from ..sources.files import read_table
from . import sql_parts as sql
from .movement_table import movement_table
from .registry import query

EVENT_SPEC = (
    "entity:l origin:s dest_location:s dest_status:s dest_period:l dest_start:s dest_end:s "
    "last_period:l last_start:s last_end:s origin_status:s event_date:s method:s"
)


@query(EVENT_SPEC, f"WITH {sql.TWO_DAY}, {sql.FIRSTS}, {sql.MOVES}, {sql.PRECISE} SELECT * FROM p_events")
def event_date_precise(spark, folder):
    moved = moves(life_profile(star.two_day_residency(spark, folder), star.ROLES))
    return move_ops.precise_events(moved, star.two_day_sightings(spark, folder), ["P"])


@query(
    EVENT_SPEC,
    f"WITH {sql.TWO_DAY}, {sql.FIRSTS}, {sql.MOVES}, {sql.PRECISE}, {sql.BETWEEN} SELECT * FROM e_events",
)
def event_date_between(spark, folder):
    residency = star.two_day_residency(spark, folder)
    moved = settle(moves(life_profile(residency, star.ROLES)))
    precise = move_ops.precise_events(moved, star.two_day_sightings(spark, folder), ["P"])
    return move_ops.between_events(moved, precise, residency, ["P"])


@query(EVENT_SPEC, f"WITH {sql.RES}, {sql.FIRSTS}, {sql.MOVES}, {sql.FLOATS} SELECT * FROM f_events")
def event_date_floating(spark, folder):
    residency = star.residency(spark, folder)
    return move_ops.floating_events(_moves(spark, folder), residency, ["P"])


_EVENTS_SQL = f"""
    WITH {sql.RES}, {sql.FIRSTS}, {sql.MOVES}, {sql.ships()}, {sql.PRECISE}, {sql.BETWEEN}, {sql.FLOATS},
    {sql.EVENTS}"""


def _moves(spark, folder):
    return settle(moves(life_profile(star.residency(spark, folder), star.ROLES)))


def _events(spark, folder, moved=None):
    return move_ops.movement_events(
        _moves(spark, folder) if moved is None else moved, star.residency(spark, folder), star.sightings(spark, folder), floating=["P"]
    )


@query(EVENT_SPEC + " event_month:s event_season:s", _EVENTS_SQL + " SELECT * FROM dated")
def movement_events(spark, folder):
    return _events(spark, folder)


@query(
    "entity:l",
    _EVENTS_SQL + " SELECT entity FROM moves WHERE entity NOT IN (SELECT entity FROM dated)",
)
def movers_without_date(spark, folder):
    moved = _moves(spark, folder)
    return lost_entities(moved, _events(spark, folder, moved))


@query(
    "entity:l",
    f"""
    WITH {sql.RES}, {sql.FIRSTS}, {sql.MOVES}, {sql.ships()}
    SELECT entity FROM moves m WHERE NOT EXISTS (
      SELECT 1 FROM ships s WHERE s.entity = m.entity AND s.period = m.dest_period)
    """,
)
def movers_without_sighting(spark, folder):
    moved = _moves(spark, folder)
    seen = move_ops.sighting_ranges(star.sightings(spark, folder))
    seen = seen.select("entity", "period").distinct()
    return lost_entities(
        moved, lookup(moved, seen, {"entity": "entity", "dest_period": "period"}, {}, how="inner")
    )


@query(
    "tie:l month:s wide:s narrow:s indexed:s",
    """
    SELECT o_orderkey AS tie, strftime(o_orderdate, '%b') AS month,
           CASE WHEN month(o_orderdate) IN (1, 2, 3, 4, 10, 11, 12) THEN 'W' ELSE 'S' END AS wide,
           CASE WHEN month(o_orderdate) IN (1, 2, 11, 12) THEN 'W' ELSE 'S' END AS narrow,
           CASE WHEN o_totalprice / 500000.0 >= 0.5 THEN 'Summer' ELSE 'Winter' END AS indexed
    FROM orders
    """,
)
def seasons(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("tie"),
        month_abbr("o_orderdate").alias("month"),
        season("o_orderdate").alias("wide"),
        season("o_orderdate", NARROW_WINTER).alias("narrow"),
        season_from_index(F.col("o_totalprice") / F.lit(500000.0)).alias("indexed"),
    )


@query(
    "tie:l side:s",
    f"""
    WITH {sql.RES}
    SELECT tie, CASE WHEN month(period_start) IN (1, 2, 11, 12) THEN 'winter' ELSE 'summer' END AS side FROM res
    """,
)
def summer_winter(spark, folder):
    summer, winter = summer_winter_split(star.residency(spark, folder))
    return summer.withColumn("side", F.lit("summer")).unionByName(winter.withColumn("side", F.lit("winter")))


_FILLED_SQL = _EVENTS_SQL + f", {sql.MONTHS}, {sql.STATUS_FILL}, {sql.DOMINANCE}"


def _filled(spark, folder):
    chain = period_chain(star.months(spark, folder))
    return move_ops.origin_status_fill(previous_period(_events(spark, folder), chain))


@query(
    "entity:l origin_status:s method:s last_period:l second_last_period:l second_last_end:s",
    _FILLED_SQL + " SELECT * FROM filled",
)
def origin_status_fill(spark, folder):
    return _filled(spark, folder)


@query(
    "entity:l origin_status:s dest_status:s origin_dominance:l dest_dominance:l",
    _FILLED_SQL + " SELECT * FROM ranked_moves",
)
def dominance(spark, folder):
    return move_ops.dominance(_filled(spark, folder), star.ROLES.dominant, star.ROLES.subordinate)


_STAY_SQL = f"WITH {sql.HOME}, {sql.FIRSTS}, {sql.MONTHS}, {sql.BIRTHS}, {sql.NON_MOVERS}"
_STAY_SPEC = (
    "entity:l origin:s last_period:l last_start:s last_end:s second_last_period:l "
    "second_last_start:s second_last_end:s inherit:l"
)


@query(_STAY_SPEC, _STAY_SQL + " SELECT * FROM heirs")
def nonmover_inherit(spark, folder):
    chain = period_chain(star.months(spark, folder))
    life = life_profile(star.home_residency(spark, folder), star.ROLES)
    return move_ops.inheritors(life, chain, star.births(spark, folder), star.ROLES.dominant_at_home)


@query(_STAY_SPEC, _STAY_SQL + " SELECT * FROM subs")
def nonmover_subordinate(spark, folder):
    chain = period_chain(star.months(spark, folder))
    life = life_profile(star.home_residency(spark, folder), star.ROLES)
    return move_ops.always_subordinate(life, chain, star.ROLES.dominant_at_home)


def home_movement(spark, folder, calendar=None):
    """The movement table over the two-place history."""
    place = star.two_way_location()
    return movement_table(
        star.home_residency(spark, folder), star.sightings(spark, folder, place),
        star.months(spark, folder) if calendar is None else calendar,
        star.births(spark, folder), roles=star.ROLES,
    )


@query(
    "entity:l origin:s last_period:l last_start:s last_end:s second_last_period:l second_last_start:s "
    "second_last_end:s inherit:l moved:s tested_before:s method:s event_date:s event_month:s event_season:s "
    "dest_status:s dest_dominance:l dest_start:s dest_end:s dest_location:s dest_period:l "
    "origin_status:s origin_dominance:l",
    f"WITH {sql.MOVEMENT} SELECT * FROM movement",
)
def movement_table_full(spark, folder):
    return home_movement(spark, folder)


@query(
    "entity:l",
    f"""
    WITH {sql.MOVEMENT}
    SELECT entity FROM (SELECT DISTINCT entity FROM res) WHERE entity NOT IN (SELECT entity FROM movement)
    """,
)
def entities_lost(spark, folder):
    return lost_entities(star.home_residency(spark, folder), home_movement(spark, folder))


@query(
    "entity:l origin:s period:l",
    f"""
    WITH {sql.HOME}
    SELECT entity, location AS origin, period FROM res
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start, tie) = 1
    """,
)
def origin_projection(spark, folder):
    return origin_location(star.home_residency(spark, folder)).withColumnRenamed("location", "origin")
