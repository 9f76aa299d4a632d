"""What the physical plans must and must not hold."""

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lifetrack.operators.joins import merge, merge_settled
from lifetrack.plans.collate import by_entity, collate_wide

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parent.parent / "lifetrack"


def plan(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()[name](spark, FOLDER).explain("formatted")
    return text.getvalue()


def test_nth_row_is_limited_before_the_exchange(spark):
    text = plan(spark, "second_location")
    assert re.findall(r"WindowGroupLimit", text) and "Partial" in text


@pytest.mark.parametrize("name", ["origin_location", "last_location", "first_dup_kept", "preferred_measurement"])
def test_picks_are_partial_aggregates(spark, name):
    text = plan(spark, name)
    assert "partial_min" in text or "partial_max" in text
    assert "Window" not in text


def test_hot_key_is_split_at_run_time(spark):
    """Against a settled table Spark splits the hot key; against the aggregate itself it cannot."""
    rows = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        skewed = []
        for joined in (merge(rows, sizes, ["k"], null_safe=False), merge_settled(rows, sizes, ["k"])):
            assert joined.count() == 400_000
            run = joined.agg(F.sum("n"))
            run.collect()
            skewed.append("skew=true" in run._jdf.queryExecution().executedPlan().toString())
        assert skewed == [False, True]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_movement_reads_the_history_once_more(spark):
    text = plan(spark, "movement_events")
    scans = re.findall(r"Location: \w+ \[file:\S+?/(\w+)\.parquet", text)
    assert sorted(scans) == ["lineitem", "orders", "orders"]


def test_the_calendar_join_exchanges_no_spans_by_bucket(spark):
    for name in ("range_join_exposure", "range_join_bucketed"):
        assert "_bucket" not in plan(spark, name)


def test_tables_stored_by_entity_are_joined_in_place(spark):
    """Also where none is small enough to be broadcast: every join reads matching buckets."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        stored = plan(spark, "collate_by_entity")
        spark.conf.set(limit, "-1")
        tables = [by_entity(spark.range(100).select(F.col("id").alias("entity"), (F.col("id") * k).alias(f"v{k}"))) for k in range(4)]
        joined = collate_wide(tables[0], tables[1:3], tables[3:])
        assert joined.count() == 100
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "SortMergeJoin" in text
    for found in (text, stored):
        assert "Exchange hashpartitioning" not in found and "Exchange rangepartitioning" not in found


def test_box_cox_copies_no_rows(spark):
    assert "Generate" not in plan(spark, "boxcox")


def test_no_rows_are_counted_while_a_plan_is_built():
    for path in (PACKAGE / "operators").glob("*.py"):
        assert ".count()" not in path.read_text(), path.name


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_refined_births_are_one_row_per_entity(spark, folder):
    out = entry.queries()["refined_start"](spark, f"/root/testdata/{folder}")
    assert out.count() == out.select("entity").distinct().count()


WHOLE = ["movement_events", "movement_table_full", "collate_wide", "group_size", "distance", "day_range_proximity", "orq", "hpd", "range_join_exposure"]


@pytest.mark.parametrize("name", WHOLE)
def test_no_cross_products_and_no_python_in_plans(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "tested_before_event")
    assert "EqualTo(event_type,signup)" in text and "EqualTo(event_type,purchase)" in text
    for schema in re.findall(r"ReadSchema: (struct<.*?>)\n", text):
        assert "props" not in schema


@pytest.mark.parametrize("name", ["gap_fill_by_season", "gap_fill_hot_locations", "fill_directions", "hpd", "row_in_group"])
def test_no_window_frame_reaches_forward_to_the_end(spark, name):
    """Spark computes such frames anew for every row."""
    assert "unboundedfollowing" not in plan(spark, name)


def test_sources_hold_no_local_checkpoints_or_row_collects():
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        for word in ("localCheckpoint", ".collect()", "toPandas", "crossJoin", ".rdd"):
            assert word not in text, (path.name, word)
