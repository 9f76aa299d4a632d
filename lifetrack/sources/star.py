"""The test tables in their analytic roles.

``orders`` is a residency history by month, ``lineitem`` gives sightings and
tests of the ordering customer, ``events`` is a second history in two-day
periods, a set of draws and a quality series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import midpoint_date
from ..operators.residency import StatusRoles, as_residency, life_profile
from ..session import settle
from .files import read_table

ROLES = StatusRoles(
    ladder=("O", "P"), floating=("P",), dominant=("F",), dominant_at_home=("F",), subordinate=("O",)
)


def month_id(c: Column | str) -> Column:
    return F.year(c) * 100 + F.month(c)


def month_start(c: Column | str) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")


def residency(spark: SparkSession, folder: str, location: Column | None = None) -> DataFrame:
    """Customers by month: place is the order priority, status the order status."""
    orders = read_table(spark, folder, "orders")
    return as_residency(
        orders,
        entity="o_custkey",
        location=F.col("o_orderpriority") if location is None else location,
        status="o_orderstatus",
        period=month_id("o_orderdate"),
        period_start=month_start("o_orderdate"),
        period_end=F.last_day("o_orderdate"),
        tie=F.col("o_orderkey"),
    )


def two_way_location() -> Column:
    return F.when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("OTHER")


def home_residency(spark: SparkSession, folder: str) -> DataFrame:
    """The same history over two places only, which leaves many non-movers."""
    return residency(spark, folder, two_way_location())


def months(spark: SparkSession, folder: str) -> DataFrame:
    """The period dimension: the months in which orders were placed, as a small table of its own."""
    starts = read_table(spark, folder, "orders").select(
        month_start("o_orderdate").alias("period_start")
    ).distinct()
    return settle(starts.select(
        month_id("period_start").alias("period"), "period_start",
        F.last_day("period_start").alias("period_end"),
    ))


def births(spark: SparkSession, folder: str) -> DataFrame:
    """First order date per customer, with its month, as birth."""
    first = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.min("o_orderdate").cast("date").alias("birth_date")
    )
    return first.withColumn("birth_period", month_id("birth_date"))


def shipments(spark: SparkSession, folder: str, location: Column | None = None) -> DataFrame:
    """Line items with the customer and place of their order."""
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"),
        (F.col("o_orderpriority") if location is None else location).alias("location"),
    )
    items = read_table(spark, folder, "lineitem")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def sightings(spark: SparkSession, folder: str, location: Column | None = None) -> DataFrame:
    """Shipments seen as sightings of the customer."""
    return shipments(spark, folder, location).select(
        "entity", month_id("l_shipdate").alias("period"),
        F.col("l_shipdate").cast("date").alias("date"), "location",
    )


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """One row per moving customer: origin and destination rows and a date between them."""
    moved = life_profile(residency(spark, folder), ROLES).where("mover").drop(
        "last_period", "last_start", "last_end"
    ).withColumnsRenamed(
        {"origin_period": "last_period", "origin_start": "last_start", "origin_end": "last_end"}
    )
    return moved.select(
        "entity", "origin", "origin_status", "last_period", "last_start", "last_end", "dest_location",
        "dest_status", "dest_period", "dest_start", "dest_end",
        midpoint_date("last_end", "dest_start").alias("event_date"),
    )


def two_day_residency(spark: SparkSession, folder: str) -> DataFrame:
    """Users by two-day period: place is the event type."""
    events = read_table(spark, folder, "events")
    number = F.floor(F.unix_date(F.col("ts").cast("date")) / F.lit(2.0)).cast("int")
    return as_residency(
        events,
        entity="user_id", location="event_type", status=F.lit("SEEN"),
        period=number,
        period_start=F.date_from_unix_date(number * 2),
        period_end=F.date_from_unix_date(number * 2 + 1),
        tie=F.col("event_id"),
    )


def two_day_sightings(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    day = F.col("ts").cast("date")
    return events.select(
        F.col("user_id").alias("entity"),
        F.floor(F.unix_date(day) / F.lit(2.0)).cast("int").alias("period"),
        day.alias("date"), F.col("event_type").alias("location"),
    )


def draws(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior draws: one parameter per event type, one iteration per user and day.

    Two models by odd and even users, the odd one 1000 higher, of three chains each.
    """
    events = read_table(spark, folder, "events")
    odd = F.col("user_id") % 2
    iteration = F.col("user_id") * 100 + F.dayofmonth("ts")
    return events.groupBy(
        F.concat(F.lit("m"), odd).alias("model"), (F.col("user_id") % 3 + 1).alias("chain"),
        iteration.alias("iteration"), F.col("event_type").alias("parameter"), odd.alias("odd"),
    ).agg(F.max("value").alias("top")).select(
        "model", "chain", "iteration", "parameter", (F.col("top") + F.col("odd") * 1000).alias("value"))


def quality_series(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Daily quality per user, unknown on days with a single event, and its calendar."""
    events = read_table(spark, folder, "events")
    day = F.unix_date(F.col("ts").cast("date"))
    daily = events.groupBy(F.col("user_id").alias("location"), day.alias("period")).agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n")
    )
    measured = daily.where(F.col("n") > 1).select("location", "period", F.col("value").alias("quality"))
    calendar = daily.select(
        "location", "period",
        F.date_from_unix_date("period").alias("period_start"),
        F.date_from_unix_date(F.col("period") + 1).alias("period_end"),
        ((F.col("period") % 10) / F.lit(10.0)).alias("season_index"),
    )
    return measured, calendar
