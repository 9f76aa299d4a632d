"""Residency histories: collating, correcting, first and second locations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import recode
from ..session import settle
from .joins import anti, keep_groups, merge_settled
from .ordered import drop_first_dup, first_by, last_by, nth_by

# Status codes of the residency tables.
CHICK = "CH"
FOSTERED = "XF"
JUVENILE = ("CH", "FL", "OFL")
FLOATING = ("FLOAT",)
DOMINANT = ("BrM", "BrF", "TBRM")
DOMINANT_AT_HOME = ("BrF", "BrM")
SUBORDINATE = ("H", "AB", "ABX")
NOT_SEEN = ("NS", "NSA")

COLUMNS = ("entity", "location", "status", "period", "period_start", "period_end")


@dataclass(frozen=True)
class StatusRoles:
    """Which status codes play which part."""

    ladder: Iterable[str] = JUVENILE
    floating: Iterable[str] = FLOATING
    dominant: Iterable[str] = DOMINANT
    dominant_at_home: Iterable[str] = DOMINANT_AT_HOME
    subordinate: Iterable[str] = SUBORDINATE


def as_residency(df: DataFrame, tie: Column | None = None, **columns: Column | str) -> DataFrame:
    """Project any table onto the canonical residency columns.

    Without a tie column a hash of the row content stands in for one.
    """
    picked = [
        (columns[c] if isinstance(columns[c], Column) else F.col(columns[c])).alias(c)
        for c in COLUMNS
    ]
    if tie is None:
        return df.select(*picked).withColumn("tie", F.xxhash64(*COLUMNS))
    return df.select(*picked, tie.alias("tie"))


def collate_residency(
    parentage: Iterable[DataFrame], observed: DataFrame, *, min_p: float = 0.8, status: str = CHICK
) -> DataFrame:
    """Observed residency plus one juvenile row per well-supported parentage, without duplicates.

    Parentage tables hold ``entity, location, period, period_start, period_end, p``.
    """
    juvenile = [
        p.where(F.col("p") >= min_p).withColumn("status", F.lit(status)).select(*COLUMNS)
        for p in parentage
    ]
    parts = [*juvenile, observed.select(*COLUMNS)]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def location_conflicts(residency: DataFrame, statuses: Iterable[str] = JUVENILE) -> DataFrame:
    """Entities recorded at more than one location in the given statuses."""
    juvenile = residency.where(F.col("status").isin(list(statuses)))
    places = juvenile.groupBy("entity").agg(F.countDistinct("location").alias("locations"))
    return places.where(F.col("locations") > 1)


def _kinds(rules: DataFrame, fields: list[str]) -> list[tuple[str, ...]]:
    """The combinations of fields that rules name, the others being null: as many as there are kinds of rules."""
    named = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    return sorted(map(tuple, rules.agg(F.collect_set(named)).first()[0]))


def _of_kind(rules: DataFrame, fields: list[str], kind: tuple[str, ...]) -> DataFrame:
    return rules.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() == F.lit(c in kind) for c in fields], F.lit(True)))


def apply_corrections(residency: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace locations by an ordered rule table.

    ``rules`` holds ``rule, entity, status, period, location, new_location``; a
    null status, period or location matches anything, and the location tested is
    the one left by earlier rules. Rules are indexed by the fields they name: for
    each combination of them that occurs, a row looks up the rules of its own
    status and period, and applies what it found in the order of ``rule``. So an
    entity with very many rules costs a row no more than the rules that fit it.
    """
    fields, out, found = ["status", "period"], residency, []
    for i, kind in enumerate(_kinds(rules, fields)):
        by = ["entity", *kind]
        packed = _of_kind(rules, fields, kind).groupBy(*by).agg(
            F.collect_list(F.struct("rule", "location", "new_location")).alias(f"_rules_{i}"))
        out = merge_settled(out, packed, by, "left")
        found.append(F.col(f"_rules_{i}"))
    if not found:
        return residency

    def step(current: Column, rule: Column) -> Column:
        return F.when(rule["location"].isNull() | (rule["location"] == current), rule["new_location"]).otherwise(current)

    listed = F.sort_array(F.concat(*[F.coalesce(f, F.array().cast(dict(out.dtypes)[f"_rules_{i}"])) for i, f in enumerate(found)]))
    return out.withColumn("location", F.aggregate(listed, F.col("location"), step)).select(*residency.columns)


def apply_exclusions(df: DataFrame, patterns: DataFrame, key: str = "entity") -> DataFrame:
    """Drop rows matching any pattern; a null pattern field matches anything but ``key`` must be set.

    For each combination of fields that patterns name, rows look up their own values: no row meets a pattern that
    does not fit.
    """
    fields, out = [c for c in patterns.columns if c != key], df
    for kind in _kinds(patterns, fields):
        named = _of_kind(patterns, fields, kind).select(key, *kind).distinct()
        out = merge_settled(out, named, [key, *kind], "left_anti")
    return out


def resolve_fostered(residency: DataFrame, fostered: str = FOSTERED, young: str = CHICK) -> DataFrame:
    """For entities moved as young: drop their rows at the old place, keep the new place as their own."""
    ids = residency.where(F.col("status") == fostered).select("entity").distinct()
    flagged = merge_settled(residency, ids.withColumn("_moved", F.lit(True)), ["entity"], "left")
    old_place = F.col("_moved").isNotNull() & F.coalesce(F.col("status") == young, F.lit(True))
    return flagged.where(~old_place).drop("_moved").withColumn(
        "status", F.when(F.col("status") == fostered, F.lit(young)).otherwise(F.col("status"))
    )


def distinct_locations(residency: DataFrame) -> DataFrame:
    """The earliest row of each entity at each location."""
    return drop_first_dup(residency, ["entity", "location"], "period_start", "tie")


def movers(residency: DataFrame) -> DataFrame:
    """Earliest rows per location of the entities seen at two or more."""
    return keep_groups(distinct_locations(residency), ["entity"], lambda n: n > 1)


def non_movers(residency: DataFrame) -> DataFrame:
    """The earliest row of each entity that has only one location."""
    return keep_groups(distinct_locations(residency), ["entity"], lambda n: n == 1)


def second_location(residency: DataFrame) -> DataFrame:
    """The second distinct location of each mover in order of first residence: its destination."""
    return nth_by(distinct_locations(residency), ["entity"], "period_start", "tie", 2)


def origin_location(residency: DataFrame) -> DataFrame:
    """The first residency row of each entity."""
    return first_by(residency, ["entity"], "period_start", "tie")


def last_location(residency: DataFrame) -> DataFrame:
    """The latest-ending residency row of each entity."""
    return last_by(residency, ["entity"], "period_end", "tie")


def place_profile(residency: DataFrame, roles: StatusRoles = StatusRoles()) -> DataFrame:
    """What the movement rules need of each entity at each location, in one pass over the history.

    Per entity and location: the earliest row, the latest-ending status (the
    most advanced one within a period), the first dominant row, the
    latest-starting row and the last floating period's end. All are smallest or largest structs, so each task sends
    one row per key, however long a history is.
    """
    ladder = list(roles.ladder)
    grade = recode("status", {code: i for i, code in enumerate(ladder, start=1)}, len(ladder) + 1)
    start, end, tie = F.col("period_start"), F.col("period_end"), F.col("tie")
    # Orders ties downward without the overflow of a plain minus.
    untie = F.bitwise_not(tie).alias("untie")
    dominant = F.col("status").isin(list(roles.dominant_at_home))
    return residency.groupBy("entity", "location").agg(
        F.min(F.struct(start.isNull().alias("undated"), start, tie, "status", "period", end)).alias("first"),
        F.max(F.when(end.isNotNull() & grade.isNotNull(), F.struct(end, grade.alias("grade"), untie, "status")))
        .alias("latest"),
        F.min(F.when(dominant & start.isNotNull(), F.struct(start, tie, "period"))).alias("dominant"),
        F.max(F.when(start.isNotNull(), F.struct(start, untie, "period", end))).alias("last"),
        F.max(F.when(F.col("status").isin(list(roles.floating)), end)).alias("float_end"),
    )


def life_profile(residency: DataFrame, roles: StatusRoles = StatusRoles()) -> DataFrame:
    """One row per entity: its first two locations and its milestones at the first.

    ``origin*`` is the earliest row, ``home_status`` the latest status at the
    origin, ``dominant_period`` the first dominant period there, ``last_*`` the
    latest-starting row there, ``dest_*`` the earliest row at the second location,
    null for entities that never moved (``mover`` false). ``float_end`` is the end
    of the last floating period anywhere.
    """
    w = Window.partitionBy("entity")
    first_two = place_profile(residency, roles).withColumns({
        "_rn": F.row_number().over(w.orderBy("first")), "float_end": F.max("float_end").over(w),
    }).where("_rn <= 2")
    at = lambda n, c, name: F.max(F.when(F.col("_rn") == n, F.col(c))).alias(name)
    row = {"status": "status", "period": "period", "period_start": "start", "period_end": "end"}
    return first_two.groupBy("entity").agg(
        (F.max("_rn") == 2).alias("mover"),
        at(1, "location", "origin"),
        *[at(1, f"first.{c}", f"origin_{name}") for c, name in row.items()],
        at(1, "latest.status", "home_status"),
        at(1, "dominant.period", "dominant_period"),
        at(1, "last.period", "last_period"),
        at(1, "last.period_start", "last_start"),
        at(1, "last.period_end", "last_end"),
        at(2, "location", "dest_location"),
        *[at(2, f"first.{c}", f"dest_{name}") for c, name in row.items()],
        F.max("float_end").alias("float_end"),
    )


def moves(life: DataFrame) -> DataFrame:
    """One row per mover: origin with its latest status, the destination row, the end of floating.

    An entity whose first place carries no date has no known origin.
    """
    known = F.col("mover") & F.col("origin_start").isNotNull()
    return life.where(known).select(
        "entity", "origin", "home_status",
        "dest_location", "dest_status", "dest_period", "dest_start", "dest_end", "float_end",
    )


def juvenile_destinations(residency: DataFrame, statuses: Iterable[str] = JUVENILE) -> DataFrame:
    """Movers whose destination row still has a juvenile status: should be empty."""
    return second_location(residency).where(F.col("status").isin(list(statuses)))


def lost_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities present before a step and missing after it."""
    return anti(before.select("entity").distinct(), after, ["entity"])
