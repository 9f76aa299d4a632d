"""Synthetic histories, one entity per branch of the movement rules."""

from pyspark.sql import functions as F

# period id -> first month; ids are not in time order.
STARTS = {10: "2000-01", 7: "2000-07", 12: "2001-01", 3: "2001-07", 15: "2002-01", 110: "2002-04", 1: "2002-07", 20: "2003-01"}
ORDER = list(STARTS)  # time order, 110 is to be excluded

HISTORY = [
    # entity, location, status, period
    (1, "A", "CH", 10), (1, "A", "FL", 7), (1, "B", "H", 7),       # precise
    (2, "A", "CH", 10), (2, "A", "OFL", 7), (2, "B", "BrM", 3),      # between
    (3, "A", "CH", 10), (3, "-3", "FLOAT", 7), (3, "-3", "FLOAT", 12), (3, "C", "H", 3),  # floating
    (4, "A", "CH", 10), (4, "-3", "FLOAT", 7),                       # floats, never settles
    (5, "A", "CH", 10), (5, "A", "H", 7), (5, "A", "H", 12), (5, "A", "BrF", 3),  # inherits
    (6, "A", "CH", 7), (6, "A", "H", 12), (6, "A", "H", 15),         # stays subordinate
    (7, "A", "CH", 7), (7, "B", "XF", 7), (7, "B", "H", 12), (7, "C", "BrF", 3),  # fostered
    (8, "A", "CH", 7), (8, "D", "OFL", 12),                          # conflict
    (9, "A", "BrM", 7), (9, "B", "BrM", 3),                          # moves from dominance
    (11, "A", "CH", 10), (11, "B", "H", 7),                          # no period before its first
    (13, "A", "BrF", 10), (13, "A", "BrF", 7),                       # dominant from the start
    (14, "A", "CH", 10), (14, "A", "BrM", 7),                        # promoted too early for two periods
    (16, "A", "H", 15), (16, "A", "BrM", 1),                         # promoted, but before birth
]
SIGHTINGS = [
    # entity, period, date, location
    (1, 7, "2000-07-03", "A"), (1, 7, "2000-07-10", "A"), (1, 7, "2000-07-15", "B"), (1, 7, "2000-07-01", "B"),
    (1, 7, "2000-07-20", "B"), (2, 3, "2001-07-09", "B"), (3, 7, "2000-07-05", "A"), (9, 3, "2001-07-05", "B"),
]
BIRTHS = {e: "2000-01-10" for e in range(1, 15)} | {16: "2009-01-01"}


def periods(spark):
    rows = [(p, m + "-01") for p, m in STARTS.items()]
    df = spark.createDataFrame(rows, "period int, start string")
    start = F.col("start").cast("date")
    return df.select("period", start.alias("period_start"), F.date_add(start, 30).alias("period_end"))


def residency(spark, rows=HISTORY):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "entity int, location string, status string, period int, tie int")
    return df.join(periods(spark), "period")


def sightings(spark):
    df = spark.createDataFrame(SIGHTINGS, "entity int, period int, date string, location string")
    return df.withColumn("date", F.col("date").cast("date"))


def births(spark):
    df = spark.createDataFrame(list(BIRTHS.items()), "entity int, birth_date string")
    return df.withColumn("birth_date", F.col("birth_date").cast("date"))
