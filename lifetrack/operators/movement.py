"""Movement events: dating a move, status at origin, dominance, non-movers.

Rules start from ``residency.life_profile`` (one row per entity) and add columns
to it; the history itself is read once more, for the last row at the origin and
the row after floating.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import two_codes
from ..functions.dates import WIDE_WINTER, midpoint_date, month_abbr, season
from .joins import anti, lookup, merge
from .periods import previous_period
from .residency import DOMINANT, DOMINANT_AT_HOME, FLOATING, SUBORDINATE

EVENT_COLUMNS = (
    "entity", "origin", "dest_location", "dest_status", "dest_period", "dest_start", "dest_end",
    "last_period", "last_start", "last_end", "origin_status", "home_status", "event_date", "method",
)
DESTINATION = {
    "location": "dest_location", "status": "dest_status", "period": "dest_period",
    "period_start": "dest_start", "period_end": "dest_end",
}
LAST_ROW = {
    "period": "last_period", "period_start": "last_start", "period_end": "last_end",
    "status": "origin_status",
}
LAST = {c: c for c in LAST_ROW.values()}
SEEN = {c: c for c in ("last_at_origin", "first_at_dest")}
DEST_PERIOD = {"last_period": "dest_period", "last_start": "dest_start", "last_end": "dest_end"}


def _floats(floating: Iterable[str]) -> Column:
    return F.coalesce(F.col("dest_status").isin(list(floating)), F.lit(False))


def all_sightings(*tables: DataFrame) -> DataFrame:
    """Union of sighting tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def sighting_ranges(sightings: DataFrame) -> DataFrame:
    """First and last date per entity, period and location: all that dating a move needs."""
    return sightings.groupBy("entity", "period", "location").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


def sighting_dates(moved: DataFrame, sightings: DataFrame) -> DataFrame:
    """Per mover: the last sighting at the origin and the first at the destination, in the destination period.

    Sightings shrink to one row per entity, period and location and meet the two
    places of each mover in a single join on that same partitioning.
    """
    place = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("place"))
    places = moved.select(
        "entity", "dest_period", F.inline(F.array(place("origin", "origin"), place("dest", "dest_location")))
    )
    seen = lookup(
        places, sighting_ranges(sightings),
        {"entity": "entity", "dest_period": "period", "place": "location"},
        {"first_seen": "first_seen", "last_seen": "last_seen"}, "inner",
    )
    return seen.groupBy("entity").agg(
        F.max(F.when(F.col("role") == "origin", F.col("last_seen"))).alias("last_at_origin"),
        F.min(F.when(F.col("role") == "dest", F.col("first_seen"))).alias("first_at_dest"),
    )


def later_rows(moved: DataFrame, residency: DataFrame, floating: Iterable[str] = FLOATING) -> DataFrame:
    """Per mover, from one pass over the history: the last row at the origin and the row that ends floating.

    ``last_*`` and ``origin_status`` are of the latest-ending row at the origin; it must not start after the
    destination period ends, and for floaters must not end after the floating period. ``settled_*`` is the first row
    of a floater ending after its last floating period. Either is null where there is no such row. Both are largest or
    smallest structs of one aggregate, so each task reduces a hot entity to one row before the exchange. Settle
    ``moved``, or what it is derived from: Spark then splits a hot entity in the join as well.
    """
    places = moved.select(
        "entity", F.col("origin").alias("_origin"), F.col("dest_end").alias("_dest_end"),
        F.col("float_end").alias("_float_end"), _floats(floating).alias("_floats"),
    )
    rows = residency.select("entity", "location", "status", "period", "period_start", "period_end", "tie")
    rows = merge(rows, places, ["entity"], null_safe=False)
    late = F.when(F.col("_floats"), F.col("_dest_end") < F.col("period_end")).otherwise(
        F.col("period_start") > F.col("_dest_end")
    )
    at_origin = (F.col("location") == F.col("_origin")) & ~late & F.col("period_end").isNotNull()
    after = F.col("_floats") & (F.col("period_end") > F.col("_float_end"))
    untie = F.bitwise_not("tie").alias("_untie")
    picked = rows.groupBy("entity").agg(
        F.max(F.when(at_origin, F.struct("period_end", untie, *[c for c in LAST_ROW if c != "period_end"]))).alias("_last"),
        F.min(F.when(after, F.struct("period_end", "tie", *[c for c in DESTINATION if c != "period_end"]))).alias("_settled"),
        F.max("_float_end").alias("float_end"),
    )
    return picked.select(
        "entity", "float_end",
        *[F.col("_last")[c].alias(name) for c, name in LAST_ROW.items()],
        *[F.col("_settled")[c].alias("settled_" + name) for c, name in DESTINATION.items()],
    )


SETTLED = {"settled_" + c: c for c in DESTINATION.values()}


def last_at_origin(moved: DataFrame, residency: DataFrame, floating: Iterable[str] = FLOATING) -> DataFrame:
    """Per mover with one: the latest-ending row at the origin, and its status; see ``later_rows``."""
    last = later_rows(moved, residency, floating).where(F.col("last_end").isNotNull())
    return last.select("entity", *LAST)


def with_settled(floaters: DataFrame, residency: DataFrame, floating: Iterable[str] = FLOATING) -> DataFrame:
    """Per floater that settled: the end of its last floating period and the first row ending after it."""
    rows = later_rows(floaters, residency, floating).where(F.col("settled_dest_end").isNotNull())
    return rows.select("entity", "float_end", *[F.col(c).alias(name) for c, name in SETTLED.items()])


def precise_events(moved: DataFrame, sightings: DataFrame, floating: Iterable[str] = FLOATING) -> DataFrame:
    """Method P: midpoint of the last sighting at the origin and the first at the destination.

    Without a sighting at the destination the date stays null.
    """
    dates = sighting_dates(moved, sightings)
    seen = lookup(moved, dates, {"entity": "entity"}, SEEN, "inner")
    settled = seen.where(F.col("last_at_origin").isNotNull() & ~_floats(floating))
    return settled.withColumns({
        **{last: F.col(dest) for last, dest in DEST_PERIOD.items()},
        "origin_status": F.lit(None).cast("string"),
        "event_date": midpoint_date("last_at_origin", "first_at_dest"), "method": F.lit("P"),
    }).select(*EVENT_COLUMNS)


def between_events(
    moved: DataFrame, precise: DataFrame, residency: DataFrame, floating: Iterable[str] = FLOATING
) -> DataFrame:
    """Method E: midpoint of the last origin period's end and the destination period's start."""
    settled = anti(moved, precise, ["entity"]).where(~_floats(floating))
    last = last_at_origin(settled, residency, floating)
    return lookup(settled, last, {"entity": "entity"}, LAST, "inner").withColumns({
        "event_date": midpoint_date("last_end", "dest_start"), "method": F.lit("E"),
    }).select(*EVENT_COLUMNS)


def floating_events(moved: DataFrame, residency: DataFrame, floating: Iterable[str] = FLOATING) -> DataFrame:
    """Method EF: midpoint of the last floating period's end and the next settled period's start.

    The settled row replaces the destination; entities that never settle drop out.
    """
    floaters = moved.where(_floats(floating)).drop("float_end", *DESTINATION.values())
    rows = later_rows(moved.where(_floats(floating)), residency, floating)
    rows = rows.where(F.col("last_end").isNotNull() & F.col("settled_dest_end").isNotNull())
    moved_on = lookup(floaters, rows, {"entity": "entity"}, {**LAST, **SETTLED, "float_end": "float_end"}, "inner")
    return moved_on.withColumns({
        "event_date": midpoint_date("float_end", "dest_start"), "method": F.lit("EF"),
    }).select(*EVENT_COLUMNS)


def movement_events(
    moved: DataFrame, residency: DataFrame, sightings: DataFrame, *,
    floating: Iterable[str] = FLOATING, winter: Iterable[int] = WIDE_WINTER,
) -> DataFrame:
    """All dated moves by the three methods, with month and season of the date.

    The same rules as the three operators above in one plan: two per-entity
    tables (sightings, later rows of the history) are attached to the movers, and
    the method decides which of them count. ``moved`` is read three times, so
    settle it, or what it is derived from, first.
    """
    key = {"entity": "entity"}
    both = lookup(moved.drop("float_end"), sighting_dates(moved, sightings), key, SEEN)
    later = {**LAST, "float_end": "float_end", **{c: c for c in SETTLED}}
    both = lookup(both, later_rows(moved, residency, floating), key, later)

    is_ef = _floats(floating)
    is_p = ~is_ef & F.col("last_at_origin").isNotNull()
    found = F.col("last_end").isNotNull() & (~is_ef | F.col("settled_dest_end").isNotNull())
    date = (
        F.when(is_p, midpoint_date("last_at_origin", "first_at_dest"))
        .when(is_ef, midpoint_date("float_end", "settled_dest_start"))
        .otherwise(midpoint_date("last_end", "dest_start"))
    )
    dated = both.where(is_p | found).select(
        "entity", "origin", "home_status",
        F.when(is_p, "P").when(is_ef, "EF").otherwise("E").alias("method"),
        F.when(~is_p, F.col("origin_status")).alias("origin_status"),
        *[F.when(is_p, F.col(dest)).otherwise(F.col(last)).alias(last) for last, dest in DEST_PERIOD.items()],
        *[F.when(is_ef, F.col("settled_" + c)).otherwise(F.col(c)).alias(c) for c in DESTINATION.values()],
        date.alias("event_date"),
    )
    return with_season(dated, winter)


def with_season(events: DataFrame, winter: Iterable[int] = WIDE_WINTER) -> DataFrame:
    return events.withColumns({
        "event_month": month_abbr("event_date"),
        "event_season": season("event_date", winter),
    })


def origin_status_fill(events: DataFrame) -> DataFrame:
    """Fill a missing origin status with the entity's latest status at the origin.

    Entities without any status there drop out.
    """
    known = events.where(F.col("home_status").isNotNull())
    return known.withColumn("origin_status", F.coalesce("origin_status", "home_status")).drop("home_status")


def dominance(events: DataFrame, dominant: Iterable[str] = DOMINANT, subordinate: Iterable[str] = SUBORDINATE) -> DataFrame:
    """Code both statuses as 1 dominant, 2 subordinate; keep moves out of a subordinate position."""
    coded = events.withColumns({
        "origin_dominance": two_codes("origin_status", dominant, 1, 2),
        "dest_dominance": two_codes("dest_status", subordinate, 2, 1),
    })
    return coded.where(F.col("origin_dominance") == 2)


def _stayers(life: DataFrame, chain: DataFrame, dominant: Iterable[str]) -> DataFrame:
    """Non-movers whose first status is not dominant, with the periods before they became so.

    The two periods are null for entities that never became dominant, or did so
    within the first two periods.
    """
    home = life.where(~F.col("mover") & ~F.col("origin_status").isin(list(dominant)))
    known = chain.where(F.col("prev2_period").isNotNull())
    values = {c: "_" + c for c in chain.columns if c.startswith("prev")}
    return lookup(home, known, {"dominant_period": "period"}, values)


def inheritors(
    life: DataFrame, chain: DataFrame, births: DataFrame, dominant: Iterable[str] = DOMINANT_AT_HOME
) -> DataFrame:
    """Non-movers that became dominant at home: their last two periods before.

    The last one must end after birth.
    """
    promoted = _stayers(life, chain, dominant).where(F.col("_prev2_period").isNotNull())
    born = lookup(promoted, births, {"entity": "entity"}, {"birth_date": "_birth"})
    return born.where(F.col("_prev_end") > F.col("_birth")).select(
        "entity", "origin",
        *[F.col(f"_prev_{c}").alias(f"last_{c}") for c in ("period", "start", "end")],
        *[F.col(f"_prev2_{c}").alias(f"second_last_{c}") for c in ("period", "start", "end")],
        F.lit(1).alias("inherit"),
    )


def always_subordinate(life: DataFrame, chain: DataFrame, dominant: Iterable[str] = DOMINANT_AT_HOME) -> DataFrame:
    """The other non-movers: their latest row gives the last period.

    Entities that were promoted but fail the birth check belong to neither set.
    """
    others = _stayers(life, chain, dominant).where(F.col("_prev2_period").isNull())
    latest = others.where(F.col("last_start").isNotNull()).select(
        "entity", "origin", "last_period", "last_start", "last_end"
    )
    return previous_period(latest, chain).withColumn("inherit", F.lit(0))
