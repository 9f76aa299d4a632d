import pytest
from pyspark.sql import functions as F

from lifetrack.operators import movement as m
from lifetrack.operators import residency as r
from lifetrack.operators.joins import equal_tables
from lifetrack.operators.periods import period_chain, previous_period
from lifetrack.plans.movement_table import COLUMNS, movement_table
from lifetrack.sources.files import to_movement_file
from lifetrack.sources.layouts import MOVEMENT_FILE_COLUMNS
from tests import histories as h


@pytest.fixture(scope="module")
def history(spark):
    return r.resolve_fostered(h.residency(spark))


@pytest.fixture(scope="module")
def moved(history):
    return r.moves(r.life_profile(history))


def entities(df):
    return sorted(row.entity for row in df.select("entity").collect())


def by_entity(df):
    return {row.entity: row for row in df.collect()}


def test_fostered_rows_replace_the_old_place(history):
    rows = [(x.location, x.status) for x in history.where("entity = 7").orderBy("tie").collect()]
    assert rows == [("B", "CH"), ("B", "H"), ("C", "BrF")]


def test_conflicts_and_corrections(spark, history):
    assert entities(r.location_conflicts(history)) == [8]
    rules = spark.createDataFrame(
        [(1, 8, "OFL", None, None, "Z"), (2, 8, None, None, "Z", "A"), (3, 2, "BrM", 7, None, "never")],
        "rule int, entity int, status string, period int, location string, new_location string",
    )
    fixed = r.apply_corrections(history, rules)
    # The second rule sees the place the first one left.
    assert [x.location for x in fixed.where("entity = 8").collect()] == ["A", "A"]
    assert entities(r.location_conflicts(fixed)) == []
    assert fixed.count() == history.count()
    unchanged = fixed.where("entity <> 8").select("entity", "location", "tie")
    assert equal_tables(unchanged, history.where("entity <> 8").select("entity", "location", "tie")).first().equal


def test_exclusions_match_wildcards(spark, history):
    patterns = spark.createDataFrame([(2, None, 7), (8, "D", None)], "entity int, location string, period int")
    left = r.apply_exclusions(history, patterns)
    assert history.count() - left.count() == 2
    assert [x.period for x in left.where("entity = 2").orderBy("tie").collect()] == [10, 3]


def test_movers_and_locations(history):
    assert set(entities(r.movers(history))) == {1, 2, 3, 4, 7, 8, 9, 11}
    assert entities(r.non_movers(history)) == [5, 6, 13, 14, 16]
    second = by_entity(r.second_location(history))
    assert (second[3].location, second[3].period) == ("-3", 7)
    assert by_entity(r.origin_location(history))[7].location == "B"
    assert by_entity(r.last_location(history))[3].location == "C"
    assert entities(r.juvenile_destinations(history)) == [8]


def test_profile_agrees_with_the_single_operators(history):
    life = by_entity(r.life_profile(history))
    for e, row in by_entity(r.second_location(history)).items():
        assert (life[e].dest_location, life[e].dest_period, life[e].dest_status) == (row.location, row.period, row.status)
    for e, row in by_entity(r.origin_location(history)).items():
        assert (life[e].origin, life[e].origin_period) == (row.location, row.period)
    # Within one period the more advanced status counts.
    assert life[1].home_status == "FL" and life[5].home_status == "BrF"


def test_undated_and_tied_rows(spark):
    rows = h.residency(spark, [(1, "A", "CH", 10), (1, "B", "H", 10), (2, "A", "CH", 10), (2, "B", "H", 7)])
    tied = by_entity(r.life_profile(rows))
    assert (tied[1].origin, tied[1].dest_location) == ("A", "B")
    import pyspark.sql.functions as F

    undated = rows.withColumn("period_start", F.when(F.col("location") == "B", F.col("period_start")))
    life = by_entity(r.life_profile(undated))
    assert (life[2].origin, life[2].dest_location) == ("B", "A")
    nothing = rows.withColumn("period_start", F.lit(None).cast("date"))
    assert r.moves(r.life_profile(nothing)).count() == 0


def test_three_dating_methods(spark, history, moved):
    sightings = h.sightings(spark)
    precise = m.precise_events(moved, sightings)
    p = by_entity(precise)
    # Last seen at A on the 10th, first at B on the 1st: the midpoint rounds back.
    assert list(p) == [1] and str(p[1].event_date) == "2000-07-05" and p[1].last_period == 7
    between = by_entity(m.between_events(moved, precise, history))
    assert sorted(between) == [2, 7, 8, 9, 11]
    # From the end of period 7 (31 July 2000) to the start of period 3 (1 July 2001).
    assert str(between[2].event_date) == "2001-01-14" and between[2].origin_status == "OFL"
    floating = by_entity(m.floating_events(moved, history))
    # Entity 4 floats and never settles; entity 3 settles at C in period 3.
    assert list(floating) == [3]
    assert (floating[3].dest_location, floating[3].dest_period, floating[3].last_period) == ("C", 3, 10)
    assert str(floating[3].event_date) == "2001-04-16"
    assert entities(r.lost_entities(moved, precise.unionByName(m.between_events(moved, precise, history)))) == [3, 4]


def test_one_plan_equals_the_union_of_methods(spark, history, moved):
    sightings = h.sightings(spark)
    precise = m.precise_events(moved, sightings)
    parts = precise.unionByName(m.between_events(moved, precise, history)).unionByName(
        m.floating_events(moved, history)
    )
    whole = m.movement_events(moved, history, sightings)
    assert equal_tables(parts, whole.select(*parts.columns)).first().equal


def test_status_and_dominance(spark, history, moved):
    chain = period_chain(h.periods(spark), [110])
    events = m.movement_events(moved, history, h.sightings(spark))
    filled = m.origin_status_fill(previous_period(events, chain))
    # Entity 3 and 11 last lived at home in the first period, which has none before it.
    assert entities(filled) == [1, 2, 7, 8, 9]
    coded = by_entity(m.dominance(filled))
    assert sorted(coded) == [1, 2, 7, 8]  # 9 moved out of a dominant position
    assert coded[1].origin_status == "FL"
    assert (coded[1].dest_dominance, coded[2].dest_dominance) == (2, 1)


def test_non_movers(spark, history):
    chain = period_chain(h.periods(spark), [110])
    life = r.life_profile(history)
    heirs = by_entity(m.inheritors(life, chain, h.births(spark)))
    assert list(heirs) == [5]
    assert (heirs[5].last_period, heirs[5].second_last_period) == (12, 7)
    subs = by_entity(m.always_subordinate(life, chain))
    # 14 became dominant too early to have two periods before; 16 fails the birth check.
    assert sorted(subs) == [6, 14]
    assert (subs[6].last_period, subs[6].second_last_period) == (15, 3)


def test_movement_table(spark, history):
    table = movement_table(
        history, h.sightings(spark), h.periods(spark), h.births(spark), exclude_periods=[110]
    )
    assert table.columns == list(COLUMNS) and len(COLUMNS) == 23
    rows = by_entity(table)
    assert {e: x.moved for e, x in rows.items()} == {1: "1", 2: "1", 7: "1", 8: "1", 5: "0", 6: "0", 14: "0"}
    assert rows[1].event_month == "Jul" and rows[1].event_season == "S" and rows[1].method == "P"
    assert rows[2].event_season == "W" and rows[5].inherit == 1 and rows[5].event_date is None
    assert to_movement_file(table).columns == list(MOVEMENT_FILE_COLUMNS)


def test_collated_residency(spark, history):
    columns = ["entity", "location", "period", "period_start", "period_end"]
    parentage = history.where("entity = 5").select(*columns).distinct().selectExpr("*", "0.8D as p")
    weak = history.where("entity = 6").select(*columns).selectExpr("*", "0.79D as p")
    seen = history.where("entity = 5 and status = 'CH'")
    total = r.collate_residency([parentage, parentage, weak], seen)
    assert total.count() == 4 and entities(total) == [5, 5, 5, 5]


def test_very_many_rules_for_one_entity(spark):
    """A hundred thousand rules of one entity: rows meet only those that fit them."""
    rules = spark.range(100_000).select(
        F.col("id").alias("rule"), F.lit("e").alias("entity"), F.when(F.col("id") % 2 == 0, "B").alias("status"), F.col("id").alias("period"),
        F.when(F.col("id") % 3 == 0, "home").alias("location"), F.concat(F.lit("new"), "id").alias("new_location"))
    rows = spark.range(0, 100_000, 97).select(
        F.lit("e").alias("entity"), F.lit("home").alias("location"), F.lit("B").alias("status"), F.col("id").alias("period"))
    fixed = r.apply_corrections(rows, rules)
    assert fixed.where(F.col("location") != F.concat(F.lit("new"), "period")).count() == 0 and fixed.count() == 1031
    patterns = rules.select("entity", "status", "period")
    assert r.apply_exclusions(rows, patterns.where("rule % 2 = 0")).count() == 515
    assert r.apply_exclusions(rows, patterns.limit(0)).count() == 1031
    assert r.apply_corrections(rows, rules.limit(0)).count() == 1031
