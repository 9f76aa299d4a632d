import datetime as dt

import pytest
from pyspark.sql import functions as F

from lifetrack.operators import covariates as cov
from tests import histories as h


def by(df, key="entity"):
    return {r[key]: r for r in df.collect()}


def test_assay_before_event(spark):
    assays = spark.sql(
        "select * from values (1, 2.0D, date '2020-05-02', 1), (1, 3.0D, date '2020-05-01', 2), "
        "(1, null, date '2020-01-01', 3), (2, 1.0D, date '2020-05-05', 4), (3, 1.0D, date '2020-05-01', 5) "
        "as t(entity, score, date, tie)"
    )
    movement = spark.sql(
        "select * from values (1, date '2020-05-01'), (2, date '2020-05-01'), (3, cast(null as date)), "
        "(4, date '2020-05-01') as t(entity, event_date)"
    )
    first = cov.first_assay(assays, "score")
    got = by(cov.tested_before_event(movement, first))
    assert {e: r.tested_before for e, r in got.items()} == {1: 1, 2: 0, 3: None}
    assert got[1].score == 3.0


def test_refined_birth_dates(spark):
    births = spark.sql(
        "select * from values (1, date '2020-01-01', 5, true), (2, date '2020-01-01', 5, false), "
        "(3, date '2020-01-01', 5, true), (4, date '2020-01-01', 6, true) as t(entity, birth_date, birth_period, estimated)"
    )
    origins = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "entity int, origin string")
    nests = spark.sql(
        "select * from values (11, 1, 'A', 5, date '2020-01-09', date '2020-01-25'), "
        "(12, 2, 'A', 5, cast(null as date), cast(null as date)), "
        "(13, 1, 'B', 5, cast(null as date), date '2020-02-20'), (14, 2, 'B', 5, date '2020-03-20', date '2020-04-01'), "
        "(15, 1, 'B', 6, date '2020-01-20', date '2020-02-01') "
        "as t(nest_id, nest_number, location, period, hatch_date, fledge_date)"
    )
    chicks = spark.createDataFrame([(99, 15), (1, 11)], "entity int, nest_id int")
    catches = spark.sql(
        "select * from values (1, date '2020-06-01'), (3, date '2020-03-01'), (3, date '2020-05-01'), (4, date '2020-06-01') as t(entity, date)"
    )
    got = {e: r.birth_date_2 for e, r in by(cov.refine_birth_date(origins, births, nests, chicks, catches)).items()}
    # 1: its own nest; 2: exact date stays; 3: fledge minus 14, the later nest hatched after the first catch;
    # 4: the nest held another chick.
    assert got == {1: dt.date(2020, 1, 9), 2: dt.date(2020, 1, 1), 3: dt.date(2020, 2, 6), 4: dt.date(2020, 1, 1)}
    wrong = spark.createDataFrame([(3, 13)], "entity int, nest_id int")
    again = by(cov.refine_birth_date(origins, births, nests, chicks, catches, wrong))
    assert again[3].birth_date_2 == dt.date(2020, 1, 1)


def test_min_age_uses_the_movers_upper_limit(spark):
    movement = spark.sql(
        "select * from values (1, '1', date '2020-04-10'), (2, '1', date '2020-04-30'), (3, '0', cast(null as date)), "
        "(4, '0', cast(null as date)), (5, '0', cast(null as date)) as t(entity, moved, event_date)"
    )
    births = movement.select("entity", F.lit("2020-01-01").cast("date").alias("birth_date"))
    seen = spark.sql("select * from values (3, date '2020-05-20'), (4, date '2020-02-01') as t(entity, date_last_seen)")
    got = {e: r.reached_min_age for e, r in by(cov.reached_min_age(movement, births, seen)).items()}
    assert got == {1: None, 2: None, 3: 1, 4: 0, 5: 0}
    limits = cov.ci_limits(spark.createDataFrame([(100.0,), (120.0,)], "a double"), "a").first()
    assert abs(limits.upper - (110 + 1.959963984540054 * 14.142135623730951 / 2**0.5)) < 1e-9
    fixed = cov.ci_limits(spark.createDataFrame([(100.0,), (120.0,)], "a double"), "a", n=90).first()
    assert fixed.n == 90 and abs(fixed.upper - fixed.mean - 1.959963984540054 * fixed.sd / 90**0.5) < 1e-9


STATUSES = [
    # entity, period, location, status
    (1, 1, "A", "BrM"), (1, 1, "A", "H"), (2, 1, "A", "FL"), (3, 1, "A", "BrU"), (4, 1, "B", "NSA"),
    (5, 1, "B", "NSA"), (5, 1, "C", "NSA"), (6, 1, "-3", "NSA"), (7, 2, "A", "CH"), (8, 2, "B", None),
]


@pytest.fixture()
def statuses(spark):
    return spark.createDataFrame(STATUSES, "entity int, period int, location string, status string")


def test_population_counts_usable_entities(statuses):
    got = {p: (r.population_all, r.population_old) for p, r in by(cov.population_by_period(statuses), "period").items()}
    # BrU holds "U", NSA holds "NS"; an unknown status is not excluded.
    assert got == {1: (2, 1), 2: (2, 1)}


def test_group_sizes_and_fallback(spark, statuses):
    sizes = cov.group_sizes(statuses, no_location="-3")
    got = {(r.period, r.location): (r.group_all, r.group_old) for r in sizes.collect()}
    assert got == {(1, "A"): (3, 2), (1, "B"): (1, 1), (2, "A"): (1, None)}
    as_written = cov.group_sizes(statuses, base="as_written", no_location="-3")
    got = {(r.period, r.location): r.group_all for r in as_written.collect()}
    assert got[(1, "B")] == 3 and got[(1, "C")] == 1
    movement = spark.createDataFrame(
        [(1, "A", 2, 1), (2, "A", 1, 2), (3, "B", 9, 1), (4, "C", 1, 2), (5, "A", 1, 2)],
        "entity int, origin string, last_period int, second_last_period int",
    )
    plain = {e: (r.group_all, r.group_old) for e, r in by(cov.with_group_size(movement, sizes)).items()}
    assert plain == {1: (1, 2), 2: (3, 2), 3: (1, 1), 4: (None, None), 5: (3, 2)}
    overrides = spark.createDataFrame(
        [(2, True, False, None, None), (3, False, True, None, None), (4, False, False, 4, None)],
        "entity int, skip_last boolean, blank boolean, group_all int, group_old int",
    )
    fixed = {e: (r.group_all, r.group_old) for e, r in by(cov.with_group_size(movement, sizes, overrides)).items()}
    assert fixed == {1: (1, 2), 2: (1, None), 3: (None, None), 4: (4, None), 5: (3, 2)}


def test_exposure(spark):
    movement = spark.sql(
        "select * from values (1, 3, date '2001-07-01'), (2, 10, date '2000-01-01'), (3, 3, date '2001-07-01'), "
        "(4, 3, date '2001-07-01') as t(entity, last_period, last_start)"
    )
    births = spark.sql(
        "select * from values (1, date '1999-08-31'), (2, date '2000-01-20'), (3, date '2001-06-01') as t(entity, birth_date)"
    )
    periods = h.periods(spark)
    # 31 August plus 6 months is the end of February: period 10 (January) is over by then.
    lived = cov.residence_periods(movement, births, periods, 6)
    assert sorted(r.period for r in lived.where("entity = 1").collect()) == [3, 7, 12]
    got = by(cov.with_exposure(movement, births, periods, events=[7, 12, 15], months=6))
    assert (got[1].exposures, got[1].exposed) == (2, "Y")
    assert (got[2].exposures, got[2].exposed) == (None, "N")
    assert (got[3].exposures, got[3].exposed) == (None, "N")
    assert (got[4].exposures, got[4].exposed) == (None, None)  # no birth record
    by_hand = spark.createDataFrame([(2, 1)], "entity int, exposures int")
    fixed = by(cov.with_exposure(movement, births, periods, events=[7], months=6, overrides=by_hand))
    assert (fixed[2].exposures, fixed[2].exposed) == (1, "Y")
    flags = by(cov.with_period_flag(movement, [10]))
    assert (flags[1].near_event, flags[2].near_event) == (0, 1)


def test_distance_falls_back_to_the_last_period(spark):
    measured = spark.sql(
        "select * from values ('A', 1, 0.0D, 0.0D, 'G', 5.0D, 1), ('A', 1, 9.0D, 9.0D, 'P', 6.0D, 2), "
        "('A', 1, null, 1.0D, 'D', 7.0D, 3), ('B', 2, 3.0D, 4.0D, 'D', 8.0D, 4) "
        "as t(location, period, easting, northing, method, size, tie)"
    )
    places = cov.preferred_measurement(measured)
    assert sorted((r.location, r.method) for r in places.collect()) == [("A", "G"), ("B", "D")]
    movers = spark.createDataFrame(
        [(1, "A", "B", 1, 2), (2, "A", "C", 1, 2)],
        "entity int, origin string, dest_location string, last_period int, dest_period int",
    )
    got = by(cov.with_distance(movers, places))
    assert (got[1].distance, got[1].origin_size, got[1].dest_size) == (5.0, 5.0, 8.0)
    assert got[2].distance is None and got[2].origin_size == 5.0


def test_food_by_year(spark):
    periods = spark.sql(
        "select * from values (1, date '2019-07-01'), (2, date '2019-12-01'), (3, date '2020-01-05'), (4, date '2018-06-01') "
        "as t(period, period_start)"
    )
    means = spark.createDataFrame([(2019, 1, 1.5), (2019, 2, 9.0), (2020, 3, 2.5), (2018, 4, None)], "year int, period int, value double")
    density = {r.year: r.food_density for r in cov.food_density_by_year(means, periods).collect()}
    assert density == {2019: 1.5, 2020: 2.5, 2018: None}
    quality = spark.createDataFrame(
        [(2019, 1, 1.0, 10.0), (2019, 1, None, 99.0), (2019, 2, 1.0, 99.0), (2018, 4, 1.0, 5.0), (2018, 4, 1.0, None)],
        "year int, period int, quality double, food double",
    )
    abundance = cov.food_abundance_by_year(quality, periods)
    assert {r.year: r.food_abundance for r in abundance.collect()} == {2019: 10.0, 2018: None}
    movement = spark.sql("select * from values (1, date '2019-02-01'), (2, date '2020-02-01') as t(entity, last_start)")
    got = by(cov.with_year_value(movement, abundance, "food_abundance", {2020: 1101.6218}))
    assert (got[1].food_abundance, got[2].food_abundance) == (10.0, 1101.6218)


def test_tests_around_events(spark):
    movement = spark.sql(
        "select * from values (1, 5, 4, date '2020-03-15'), (2, 5, 4, cast(null as date)) "
        "as t(entity, last_period, second_last_period, event_date)"
    )
    tests = spark.sql(
        "select * from values (1, 5, 0, date '2020-03-01', 2), (1, 5, 0, date '2020-03-01', 2), (1, 5, 1, date '2020-03-29', 2), "
        "(1, 6, 1, date '2020-03-30', 2), (2, 4, 1, date '2020-03-15', 1) as t(entity, period, result, date, n_tests)"
    )
    assert [tuple(r) for r in cov.tests_in_last_period(movement, tests).collect()] == [(1, 2)]
    assert sorted(r.days_to_event for r in cov.tests_near_event(movement, tests, 14).collect()) == [-14, 14]
    assert cov.tests_near_event(movement, tests, 21).count() == 3
    overview = cov.test_overview(movement, tests)
    assert sorted(tuple(r) for r in cov.frequency(overview, "n_tests").collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("limits", [{}, {"parts": 64}])
def test_gap_fill_keeps_seasons_apart(spark, limits):
    known = {1: None, 2: 100.0, 3: 4.0, 4: None, 5: None, 6: None, 7: 8.0, 8: None}
    calendar = spark.createDataFrame([(1, p, 0.5 if p % 2 else 0.4) for p in known], "location int, period int, season_index double")
    calendar = calendar.select(
        "*", F.date_from_unix_date(F.col("period") * 100).alias("period_start"),
        F.date_from_unix_date(F.col("period") * 100 + 31).alias("period_end"),
    )
    measured = spark.createDataFrame([(1, p, v) for p, v in known.items() if v is not None], "location int, period int, quality double")
    got = {r.period: (r.season, r.quality) for r in cov.gap_fill_by_season(measured, calendar, **limits).collect()}
    assert got == {
        1: ("Summer", 4.0), 3: ("Summer", 4.0), 5: ("Summer", 6.0), 7: ("Summer", 8.0),
        2: ("Winter", 100.0), 4: ("Winter", 100.0), 6: ("Winter", 100.0), 8: ("Winter", 100.0),
    }
