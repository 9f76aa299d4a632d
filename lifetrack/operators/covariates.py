"""Covariates of a movement table, each added as columns to the rows it is given.

Adding in place keeps one row per entity through all steps, so covariates chain
without joining the movement table to itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import contains_any, ifelse, sum_strict
from ..functions.dates import (
    NARROW_WINTER, days_between, days_between_local, midpoint_days, season, season_from_index,
)
from ..session import settle, together
from .joins import anti, lookup, merge, merge_settled
from .ordered import as_of, first_by, nearest_known, numbered
from .periods import overlap_calendar
from .residency import NOT_SEEN

# Status lists of the population and group-size rules.
UNUSABLE_PARTS = ("U", "NS", "EGG", "XF")
YOUNG_PARTS = ("FL", "CH")
VAGUE = ("SEEN1", "SEEN2", "U", "NS", "EGG", "FLOAT", "BrU", "NSA")
YOUNG = ("CH", "FL", "OFL", "XF")
NO_LOCATION = -3
# Periods that count as close to, or as, a translocation.
FLAGGED_PERIODS = (110, 112, 34, 32, 10, 12, 8)
EXPOSURE_PERIODS = (33, 45, 119, 120)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


# Undated periods sort behind every dated one.
UNDATED = 1e9

# Assays and ages ---------------------------------------------------------------


def first_assay(assays: DataFrame, score: str, date: str = "date", tie: str = "tie") -> DataFrame:
    """The earliest complete assay per entity; rows with any null of the three are dropped."""
    complete = assays.select("entity", score, date, tie).dropna(how="any")
    return first_by(complete, ["entity"], date, tie)


def tested_before_event(
    movement: DataFrame, first: DataFrame, date: str = "date", event: str = "event_date"
) -> DataFrame:
    """Entities with an assay, flagged 1 if it came no later than the event, 0 if later."""
    both = merge(movement.drop("tested_before"), first.drop("tie"), ["entity"], null_safe=False)
    return both.withColumn("tested_before", ifelse(F.col(date) > F.col(event), 0, 1))


def stack_assays(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Several assay types below one another, labelled in ``assay``; columns that a type lacks are null."""
    labelled = [df.withColumn("assay", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def age_at_event(
    movement: DataFrame, births: DataFrame, *, birth: str = "birth_date", name: str = "age",
    zone: str | None = None,
) -> DataFrame:
    """Days from birth to the event; with a zone, events count from local midnight."""
    dated = lookup(movement, births, {"entity": "entity"}, {birth: birth}, how="inner")
    age = days_between_local(birth, "event_date", zone) if zone else days_between(birth, "event_date")
    return dated.withColumn(name, age)


def split_by_age(df: DataFrame, age: str = "age", days: int = 150) -> tuple[DataFrame, DataFrame]:
    """Rows below the age limit, and rows at or above it."""
    return df.where(F.col(age) < days), df.where(F.col(age) >= days)


def refine_birth_date(
    origins: DataFrame, births: DataFrame, nests: DataFrame, chicks: DataFrame, catches: DataFrame,
    exclusions: DataFrame | None = None, *, fledge_days: int = 14, parts: int | None = None,
) -> DataFrame:
    """A second birth date for entities whose recorded one is an estimate: one row per entity.

    A nest fits if it fledged in the origin location and birth period, has the
    entity as a known chick or no known chick, and hatched no later than the
    entity's first catch; its hatch date may be the fledge date minus
    ``fledge_days``. The latest fitting hatch date is the second birth date, and
    ``fitting_nests`` says how many there were. Without one the recorded date
    stays. ``exclusions`` (entity, nest_id) names nests that are wrong for an
    entity.

    Entities never meet all nests of their place: an entity's own nests are found
    by its name, and of the nests without chicks the last one before its first
    catch is carried to it, with the number of those before.

    ``births``: entity, birth_date, birth_period, estimated. ``nests``: nest_id (a
    number), location, period, hatch_date, fledge_date. ``chicks``: entity,
    nest_id. ``catches``: entity, date.
    """
    cell = ["origin", "birth_period"]
    first_catch = catches.groupBy("entity").agg(F.min("date").alias("first_catch"))
    known = merge(origins.select("entity", "origin"), births, ["entity"], null_safe=False)
    known = settle(merge(known, first_catch, ["entity"], "left", null_safe=False))
    unsure = known.where(F.col("estimated") & F.col("first_catch").isNotNull())
    fledged = nests.where(F.col("fledge_date").isNotNull()).select(
        F.col("location").alias("origin"), F.col("period").alias("birth_period"), "nest_id",
        F.coalesce("hatch_date", F.date_sub("fledge_date", fledge_days)).alias("hatch_date"),
    )
    chicks = chicks.select("entity", "nest_id").distinct()

    own = merge(merge(fledged, chicks, ["nest_id"], null_safe=False), unsure, ["entity", *cell], null_safe=False)
    own = own.where(F.col("hatch_date") <= F.col("first_catch"))
    free = anti(fledged, chicks, ["nest_id"]).withColumn("_tie", F.col("nest_id").cast("long"))
    places = unsure.dropna(subset=cell).select("entity", *cell, "first_catch")
    asked = as_of(
        places, free, cell, ("first_catch", "hatch_date"), tie="_tie", take={"hatch_date": "day"}, count="number", parts=parts)
    if exclusions is None:
        taken = asked.where(F.col("number") > 0).select("entity", "day", F.col("number").alias("_free"))
    else:
        # Only a wrong nest makes the number of the one before it matter.
        pairs = exclusions.select("entity", "nest_id").distinct()
        own = anti(own, pairs, ["entity", "nest_id"])
        latest, nests_in_order = together(
            lambda: settle(asked), lambda: settle(numbered(free, cell, "hatch_date", "_tie", "_n", parts=parts)))
        wrong = merge(pairs, nests_in_order.select("nest_id", *cell, "_n"), ["nest_id"], null_safe=False)
        wrong = merge(latest, wrong.drop("nest_id"), ["entity", *cell], null_safe=False).where("_n <= number")
        wrong = wrong.groupBy("entity").agg(F.sort_array(F.collect_list("_n"), asc=False).alias("_wrong"))
        latest = merge(latest, wrong, ["entity"], "left", null_safe=False)
        latest = latest.withColumn("_wrong", F.coalesce("_wrong", F.expr("cast(array() as array<bigint>)")))
        step_down = F.aggregate("_wrong", F.col("number"), lambda n, wrong: F.when(n == wrong, n - 1).otherwise(n))
        latest = latest.select("entity", *cell, step_down.alias("_n"), (F.col("number") - F.size("_wrong")).alias("_free"))
        nest_days = nests_in_order.select(*cell, "_n", F.col("hatch_date").alias("day"))
        taken = merge(latest, nest_days, [*cell, "_n"], null_safe=False)
    fitting = taken.select("entity", F.col("day").alias("_hatch"), F.col("_free").alias("_fits")).unionByName(
        own.select("entity", F.col("hatch_date").alias("_hatch"), F.lit(1).cast("long").alias("_fits"))
    ).groupBy("entity").agg(F.max("_hatch").alias("_hatch"), F.sum("_fits").alias("_fits"))
    out = merge(known, fitting, ["entity"], "left", null_safe=False)
    return out.select(
        "entity",
        F.col("birth_date").alias("birth_date_1"),
        F.coalesce("_hatch", "birth_date").alias("birth_date_2"),
        F.coalesce("_fits", F.lit(0).cast("long")).alias("fitting_nests"),
    )


def ci_limits(
    df: DataFrame, column: str, *, confidence: float = 0.95, n: int | None = None
) -> DataFrame:
    """One row: mean, sd, n and the normal confidence limits of the mean."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    size = F.lit(n).cast("long") if n else F.count(column)
    stats = df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), size.alias("n")
    )
    error = F.lit(z) * F.col("sd") / F.sqrt("n")
    return stats.withColumns({"lower": F.col("mean") - error, "upper": F.col("mean") + error})


def last_seen(residency: DataFrame, not_seen: Iterable[str] = NOT_SEEN) -> DataFrame:
    """The last day each entity can have been seen: its latest period end in a seen status."""
    seen = residency.where(~F.col("status").isin(list(not_seen)))
    return seen.groupBy("entity").agg(F.max("period_end").alias("date_last_seen"))


def reached_min_age(
    movement: DataFrame, births: DataFrame, seen: DataFrame, *, birth: str = "birth_date",
    bound: str = "upper", n: int | None = None, name: str = "reached_min_age",
) -> DataFrame:
    """Flag non-movers last seen at an age above the movers' mean age limit; null for movers."""
    aged = age_at_event(movement, births, birth=birth, name="_age")
    limit = ci_limits(aged.where(F.col("moved") == "1"), "_age", n=n).select(bound).scalar()
    dated = lookup(aged, seen, {"entity": "entity"}, {"date_last_seen": "_seen"})
    old_enough = days_between(birth, "_seen") > limit
    flag = F.when(F.col("moved") == "0", _flag(old_enough))
    return dated.withColumn(name, flag).drop("_age", "_seen", birth)


def with_years(df: DataFrame, dates: Mapping[str, str]) -> DataFrame:
    """Add calendar years: new column -> date column."""
    return df.withColumns({name: F.year(c) for name, c in dates.items()})


# Population and group ----------------------------------------------------------


def population_by_period(statuses: DataFrame) -> DataFrame:
    """Entities with a usable status per period: all, and those beyond the young statuses.

    Rows shrink to one per period and entity first; both counts then come from
    one pass without distinct counting.
    """
    usable = statuses.where(~contains_any("status", UNUSABLE_PARTS))
    per_entity = usable.groupBy("period", "entity").agg(
        F.max((~contains_any("status", YOUNG_PARTS)).cast("long")).alias("_old")
    )
    return per_entity.groupBy("period").agg(
        F.count(F.lit(1)).alias("population_all"),
        F.nullif(F.sum("_old"), F.lit(0).cast("long")).alias("population_old"),
    )


def with_population(movement: DataFrame, statuses: DataFrame | None = None, *, counts: DataFrame | None = None) -> DataFrame:
    """Population in the last origin period, of ``statuses`` or as counted before.

    The counts are settled, so that Spark sees how small they are and does not
    shuffle the movement rows by period.
    """
    values = {"population_all": "population_all", "population_old": "population_old"}
    counts = settle(population_by_period(statuses)) if counts is None else counts
    return lookup(movement, counts, {"last_period": "period"}, values)


def group_sizes(
    statuses: DataFrame, *, base: str = "filtered", vague: Iterable[str] = VAGUE,
    unseen: str = "NSA", young: Iterable[str] = YOUNG, no_location=NO_LOCATION,
) -> DataFrame:
    """Rows per period and location: all, and without young statuses.

    Vague statuses do not count, except that an entity unseen but assigned to
    one place in the period counts there. ``base="as_written"`` counts those
    unseen rows on top of the whole unfiltered table instead.
    """
    placed = statuses.where((F.col("status") == unseen) & (F.col("location") != F.lit(no_location)))
    assigned = placed.groupBy("entity", "period").agg(
        F.count(F.lit(1)).alias("_n"), F.max("location").alias("location"), F.max("status").alias("status")
    ).where(F.col("_n") == 1)
    core = statuses if base == "as_written" else statuses.where(~F.col("status").isin(list(vague)))
    columns = ["period", "location", "status"]
    rows = core.select(*columns).unionByName(assigned.select(*columns))
    old = (~F.col("status").isin(list(young))).cast("long")
    return rows.groupBy("period", "location").agg(
        F.count(F.lit(1)).alias("group_all"),
        F.nullif(F.sum(old), F.lit(0).cast("long")).alias("group_old"),
    )


def with_group_size(movement: DataFrame, sizes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Group size at the origin in the last period, else in the second-last one.

    ``sizes`` is looked up twice: settle it if it was just aggregated.
    ``overrides`` holds ``entity, skip_last, blank, group_all, group_old``:
    ignore the last period, blank both sizes, or replace a size where given.
    """
    out = movement
    for period, turn in (("last_period", "1"), ("second_last_period", "2")):
        out = lookup(
            out, sizes, {period: "period", "origin": "location"},
            {c: f"_{c}_{turn}" for c in ("group_all", "group_old")},
        )
    if overrides is None:
        picked = {c: F.coalesce(f"_{c}_1", f"_{c}_2") for c in ("group_all", "group_old")}
        return out.select(*movement.columns, *[e.alias(c) for c, e in picked.items()])
    out = lookup(
        out, overrides, {"entity": "entity"},
        {c: "_set_" + c for c in ("skip_last", "blank", "group_all", "group_old")},
    )
    skip, blank = (F.coalesce(F.col("_set_" + c), F.lit(False)) for c in ("skip_last", "blank"))
    picked = {
        c: F.when(~blank, F.coalesce(f"_set_{c}", F.when(~skip, F.col(f"_{c}_1")), f"_{c}_2"))
        for c in ("group_all", "group_old")
    }
    return out.select(*movement.columns, *[e.alias(c) for c, e in picked.items()])


# Events in periods -------------------------------------------------------------


def with_period_flag(movement: DataFrame, flagged: Iterable = FLAGGED_PERIODS, name: str = "near_event") -> DataFrame:
    """1 if the last origin period is one of the flagged periods, else 0."""
    return movement.withColumn(name, _flag(F.col("last_period").isin(list(flagged))))


def residence_periods(
    movement: DataFrame, births: DataFrame, periods: DataFrame, months: int
) -> DataFrame:
    """Periods overlapping the time from birth plus ``months`` to the start of the last origin period."""
    spans = lookup(
        movement.select("entity", "last_start"), births, {"entity": "entity"},
        {"birth_date": "_birth"}, how="inner",
    ).withColumn("_eligible", F.add_months("_birth", months))
    calendar = periods.select("period", "period_start", "period_end")
    return overlap_calendar(spans, calendar, ("_eligible", "last_start"), ("period_start", "period_end")).drop("_birth")


def with_exposure(
    movement: DataFrame, births: DataFrame, periods: DataFrame, *,
    events: Iterable = EXPOSURE_PERIODS, months: int = 5, overrides: DataFrame | None = None,
) -> DataFrame:
    """Number of event periods lived through at the origin, and Y/N; the number is null for N.

    The listed event periods become one small array that every row counts over:
    no pairs are formed and the movement table is read once. Entities without a
    birth record get null for both. ``overrides`` (entity, exposures) sets counts
    by hand.
    """
    listed = periods.where(F.col("period").isin(list(events)))
    spans = listed.agg(F.collect_list(F.struct("period_start", "period_end"))).scalar()
    born = births.withColumn("_born", F.lit(True))
    out = lookup(movement, born, {"entity": "entity"}, {"birth_date": "_birth", "_born": "_born"})
    eligible = F.add_months("_birth", months)
    overlap = lambda p: (p["period_end"] >= eligible) & (F.col("last_start") >= p["period_start"])
    dated = F.col("_birth").isNotNull() & F.col("last_start").isNotNull()
    out = out.withColumn("_spans", spans)
    out = out.withColumn("exposures", F.when(dated, F.nullif(F.size(F.filter("_spans", overlap)), F.lit(0))))
    if overrides is not None:
        out = lookup(out, overrides, {"entity": "entity"}, {"exposures": "_set"})
        out = out.withColumn("exposures", F.coalesce("_set", "exposures")).drop("_set")
    code = F.when(F.col("exposures").isNotNull(), "Y").when(F.col("_born"), "N")
    return out.withColumn("exposed", code).drop("_birth", "_born", "_spans")


# Places ------------------------------------------------------------------------


def preferred_measurement(measurements: DataFrame) -> DataFrame:
    """One row per location and period: among rows with a coordinate, the alphabetically first method."""
    located = measurements.where(F.col("easting").isNotNull())
    return first_by(located, ["location", "period"], "method", "tie")


def with_distance(movers: DataFrame, places: DataFrame) -> DataFrame:
    """Straight-line distance from origin to destination, with both sizes.

    Each value is that of the destination period, else of the last origin
    period. ``places`` holds one row per location and period: easting,
    northing, size. It is looked up four times: settle it if it was derived.
    """
    out = movers
    for place, side in (("origin", "_o"), ("dest_location", "_d")):
        for period, turn in (("dest_period", "1"), ("last_period", "2")):
            out = lookup(
                out, places, {place: "location", period: "period"},
                {c: f"{side}_{c}_{turn}" for c in ("easting", "northing", "size")},
            )
    value = lambda side, c: F.coalesce(f"{side}_{c}_1", f"{side}_{c}_2")
    east = value("_d", "easting") - value("_o", "easting")
    north = value("_d", "northing") - value("_o", "northing")
    out = out.withColumns({
        "distance": F.sqrt(east * east + north * north),
        "origin_size": value("_o", "size"),
        "dest_size": value("_d", "size"),
    })
    return out.select(*movers.columns, "distance", "origin_size", "dest_size")


def summer_winter_split(
    df: DataFrame, date: str = "period_start", winter: Iterable[int] = NARROW_WINTER
) -> tuple[DataFrame, DataFrame]:
    """Summer rows and winter rows."""
    code = season(date, winter)
    return df.where(code == "S"), df.where(code == "W")


def food_density_by_year(
    means: DataFrame, periods: DataFrame, *, stand_in_years: Iterable[int] = (2020,)
) -> DataFrame:
    """Summer values by year, with winter values standing in for years without summer work."""
    dated = lookup(means, periods, {"period": "period"}, {"period_start": "period_start"}, how="inner")
    summer, winter = summer_winter_split(dated)
    kept = summer.unionByName(winter.where(F.col("year").isin(list(stand_in_years))))
    return kept.select("year", F.col("value").alias("food_density"))


def food_abundance_by_year(quality: DataFrame, periods: DataFrame) -> DataFrame:
    """Summer totals by year over rows with a known quality; null if any term is null."""
    dated = lookup(quality, periods, {"period": "period"}, {"period_start": "period_start"}, how="inner")
    summer, _ = summer_winter_split(dated)
    known = summer.where(F.col("quality").isNotNull())
    return known.groupBy("year").agg(sum_strict("food").alias("food_abundance"))


def with_year_value(
    movement: DataFrame, by_year: DataFrame, value: str, overrides: Mapping[int, float] | None = None
) -> DataFrame:
    """Attach a yearly value by the year of the last origin period; overrides replace whole years."""
    out = movement.withColumn("last_year", F.year("last_start"))
    out = lookup(out, by_year, {"last_year": "year"}, {value: value})
    fixed = F.lit(None).cast("double")
    for year, number in (overrides or {}).items():
        fixed = F.when(F.col("last_year") == year, F.lit(float(number))).otherwise(fixed)
    return out.withColumn(value, F.coalesce(fixed, F.col(value)))


# Tests -------------------------------------------------------------------------


def test_records(tests: DataFrame) -> DataFrame:
    """Distinct test records: entity, test period, result, date."""
    return tests.select("entity", F.col("period").alias("test_period"), "result", "date").distinct()


def test_overview(movement: DataFrame, tests: DataFrame) -> DataFrame:
    """Each entity with its distinct test counts; entities without tests keep one row."""
    kept = movement.select("entity", "last_period", "second_last_period", "event_date")
    return merge(kept, tests.select("entity", "n_tests").distinct(), ["entity"], "left", null_safe=False)


def tests_in_last_period(movement: DataFrame, tests: DataFrame) -> DataFrame:
    """Entities tested in their last origin period, with the number of tests there."""
    counts = test_records(tests).groupBy("entity", "test_period").agg(F.count(F.lit(1)).alias("tests"))
    tested = lookup(
        movement.select("entity", "last_period"), counts,
        {"entity": "entity", "last_period": "test_period"}, {"tests": "tests"}, how="inner",
    )
    return tested.select("entity", "tests")


def last_period_gaps(movement: DataFrame, tests: DataFrame) -> DataFrame:
    """Each distinct test in an entity's last origin period, with the days from the test to the event."""
    places = movement.where(F.col("event_date").isNotNull()).select(
        "entity", F.col("last_period").alias("test_period"), "event_date")
    records = merge_settled(test_records(tests), places, ["entity", "test_period"])
    return records.withColumn("days_to_event", days_between("date", "event_date"))


def tests_near_event(movement: DataFrame, tests: DataFrame, days: int) -> DataFrame:
    """Distinct tests within ``days`` whole days on either side of the entity's event.

    Duplicates are dropped among the few tests near an event, not among all.
    """
    dated = movement.where(F.col("event_date").isNotNull()).select("entity", "event_date")
    rows = tests.select("entity", F.col("period").alias("test_period"), "result", "date")
    pairs = merge_settled(rows, dated, ["entity"])
    gap = days_between("date", "event_date")
    near = pairs.withColumn("days_to_event", gap).where(F.col("days_to_event").between(-days, days))
    return near.distinct()


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# Quality series ----------------------------------------------------------------


def gap_fill_by_season(measured: DataFrame, calendar: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Complete a quality series per location and season.

    ``measured``: location, period, quality. ``calendar``: location, period,
    period_start, period_end, season_index. A gap becomes the mean of the nearest
    known values around it, or the only one there is; known values stay.
    """
    dated = calendar.select(
        "location", "period",
        season_from_index("season_index").alias("season"),
        midpoint_days("period_start", "period_end").alias("midpoint"),
    )
    series = merge(measured.select("location", "period", "quality").distinct(), dated,
                   ["location", "period"], "full", null_safe=False).distinct()
    placed = series.where(F.col("season").isNotNull()).withColumn(
        "midpoint", F.coalesce("midpoint", F.lit(UNDATED))
    )
    near = nearest_known(placed, ["location", "season"], "midpoint", "period", "quality", parts=parts)
    ahead = F.coalesce("next_known", "prev_known")
    back = F.coalesce("prev_known", "next_known")
    return near.select("location", "period", "season", ((ahead + back) / 2).alias("quality"))


def with_quality(movement: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality of both places in both periods: four roles of one table, settled if it was derived."""
    out = movement
    for place, place_name in (("dest_location", "dest"), ("origin", "origin")):
        for period, period_name in (("dest_period", "dest"), ("last_period", "last")):
            out = lookup(
                out, quality, {place: "location", period: "period"},
                {"quality": f"quality_{place_name}_place_{period_name}_period"},
            )
    return out
