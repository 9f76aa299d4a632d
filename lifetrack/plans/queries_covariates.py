"""Queries for covariates and the wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import null_cells
from ..functions.dates import days_between, days_between_local, midpoint_date, midpoint_days, parse_dmy, parse_iso
from ..operators import covariates as cov
from ..operators.joins import lookup
from ..operators.ordered import fill_nearest
from ..operators.periods import period_chain, previous_period
from ..operators.residency import origin_location
from ..operators.stats import overview as overview_of
from ..session import settle, settle_by, together
from ..sources import star
from ..sources.files import read_table
from . import sql_parts as sql
from .collate import by_entity, collate_wide as collate
from .collate import with_assays
from .queries_movement import home_movement
from .registry import query

# Dates, assays, ages -------------------------------------------------------------------


@query(
    "tie:l parsed:s bad:s iso:s days:l exact:d midpoint:s half:d later:s earlier:s",
    """
    SELECT o_orderkey AS tie, cast(o_orderdate AS date) AS parsed, cast(NULL AS date) AS bad,
           cast(o_orderdate AS date) AS iso,
           cast(o_orderdate AS date) - DATE '1998-01-31' AS days,
           (epoch(timezone('Europe/London', cast(cast(o_orderdate AS date) AS timestamp)))
            - epoch(TIMESTAMP '1998-01-31')) / 86400.0 AS exact,
           DATE '1998-01-31' + cast(floor((cast(o_orderdate AS date) - DATE '1998-01-31') / 2.0) AS integer) AS midpoint,
           (DATE '1998-01-31' - DATE '1970-01-01') + (cast(o_orderdate AS date) - DATE '1998-01-31') / 2.0 AS half,
           cast(cast(o_orderdate AS date) + INTERVAL 6 MONTH AS date) AS later,
           cast(o_orderdate AS date) - 14 AS earlier
    FROM orders
    """,
)
def date_functions(spark, folder):
    orders = read_table(spark, folder, "orders")
    text = orders.select(
        F.col("o_orderkey").alias("tie"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ymd"),
        F.lit("1998-01-31").cast("date").alias("since"),
    )
    dated = text.select(
        "tie", "since", parse_dmy("dmy").alias("parsed"), parse_dmy("ymd").alias("bad"),
        parse_iso("ymd").alias("iso"),
    )
    return dated.withColumns({
        "days": days_between("since", "parsed"),
        "exact": days_between_local("since", "parsed"),
        "midpoint": midpoint_date("since", "parsed"),
        "half": midpoint_days("since", "parsed"),
        "later": F.add_months("parsed", 6),
        "earlier": F.date_sub("parsed", 14),
    })


@query(
    "entity:l score:d date:s event_date:s tested_before:l",
    """
    WITH assay AS (
      SELECT user_id AS entity, nullif(value, 0.01) AS score, cast(ts AS date) AS date, event_id AS tie
      FROM events WHERE event_type = 'signup'),
    first AS (
      SELECT * FROM assay WHERE score IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date, tie) = 1),
    bought AS (
      SELECT user_id AS entity, cast(min(ts) AS date) AS event_date FROM events
      WHERE event_type = 'purchase' GROUP BY 1)
    SELECT entity, score, date, event_date,
           CASE WHEN date > event_date THEN 0 WHEN date <= event_date THEN 1 END AS tested_before
    FROM first JOIN bought USING (entity)
    """,
)
def tested_before_event(spark, folder):
    events = read_table(spark, folder, "events")
    assays = events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("entity"), F.nullif(F.col("value"), F.lit(0.01)).alias("score"),
        F.col("ts").cast("date").alias("date"), F.col("event_id").alias("tie"),
    )
    bought = events.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("entity")).agg(
        F.min("ts").cast("date").alias("event_date")
    )
    return cov.tested_before_event(bought, cov.first_assay(assays, "score"))


_ASSAY_SQL = """
    bought AS (
      SELECT user_id AS entity, cast(min(ts) AS date) AS event_date FROM events
      WHERE event_type = 'purchase' GROUP BY 1),
    firsts AS (
      SELECT event_type AS assay, user_id AS entity, value AS score, cast(ts AS date) AS date FROM events
      WHERE event_type IN ('signup', 'view')
      QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY cast(ts AS date), event_id) = 1)"""


@query(
    "entity:l assay:s score:d date:s event_date:s tested_before:l",
    f"""
    WITH {_ASSAY_SQL}
    SELECT entity, assay, score, date, event_date,
           CASE WHEN date > event_date THEN 0 WHEN date <= event_date THEN 1 END AS tested_before
    FROM firsts JOIN bought USING (entity)
    """,
)
def tested_before_in_either(spark, folder):
    """Both assay types below one another, each entity's first of each type."""
    events = read_table(spark, folder, "events")
    bought = settle(events.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("entity")).agg(
        F.min("ts").cast("date").alias("event_date")
    ))
    def one(kind):
        assays = events.where(F.col("event_type") == kind).select(
            F.col("user_id").alias("entity"), F.col("value").alias("score"),
            F.col("ts").cast("date").alias("date"), F.col("event_id").alias("tie"),
        )
        return cov.tested_before_event(bought, cov.first_assay(assays, "score"))
    return cov.stack_assays({kind: one(kind) for kind in ("signup", "view")})


@query(
    "entity:l age:l young:l",
    f"""
    WITH {sql.TRIPS}, {sql.BIRTHS}
    SELECT entity, event_date - birth_date AS age, cast(event_date - birth_date < 150 AS integer) AS young
    FROM trips JOIN births USING (entity)
    """,
)
def age_at_event(spark, folder):
    aged = cov.age_at_event(star.trips(spark, folder), star.births(spark, folder))
    young, old = cov.split_by_age(aged)
    return young.withColumn("young", F.lit(1)).unionByName(old.withColumn("young", F.lit(0)))


def _refined_sql(location: str = "o_orderpriority") -> str:
    """Tables up to ``refined_births``; needs ``firsts`` and ``births``."""
    return f"""
    nests AS (
      SELECT o_orderkey AS nest_id, {location} AS location,
             year(o_orderdate) * 100 + month(o_orderdate) AS period,
             CASE WHEN o_orderstatus <> 'P' THEN cast(o_orderdate AS date) END AS hatch_date,
             CASE WHEN o_totalprice > 60000 THEN cast(o_orderdate AS date) + 20 END AS fledge_date
      FROM orders),
    chicks AS (SELECT o_orderkey AS nest_id, o_custkey AS chick FROM orders WHERE o_orderstatus = 'F'),
    catches AS (SELECT o_custkey AS entity, min(cast(l_shipdate AS date)) AS first_catch
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    known AS (
      SELECT b.*, f.location AS origin, c_mktsegment <> 'BUILDING' AS estimated
      FROM births b JOIN firsts f ON f.entity = b.entity AND f.place = 1 JOIN customer ON c_custkey = b.entity),
    fitting AS (
      SELECT k.entity, max(coalesce(n.hatch_date, n.fledge_date - 14)) AS hatch_date, count(*) AS fits
      FROM known k JOIN nests n ON n.location = k.origin AND n.period = k.birth_period
      LEFT JOIN chicks c ON c.nest_id = n.nest_id JOIN catches t ON t.entity = k.entity
      WHERE k.estimated AND n.fledge_date IS NOT NULL AND (c.chick IS NULL OR c.chick = k.entity)
        AND NOT (coalesce(n.hatch_date, n.fledge_date - 14) > t.first_catch)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000 AND o_custkey = k.entity AND o_orderkey + 1 = n.nest_id)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000 AND o_custkey = k.entity AND o_orderkey = n.nest_id)
      GROUP BY k.entity),
    refined_births AS (
      SELECT k.entity, k.birth_date AS birth_date_1, coalesce(r.hatch_date, k.birth_date) AS birth_date_2,
             coalesce(r.fits, 0) AS fitting_nests
      FROM known k LEFT JOIN fitting r USING (entity))"""


def _refined(spark, folder, history, births, place=None):
    orders = read_table(spark, folder, "orders")
    day = F.col("o_orderdate").cast("date")
    nests = orders.select(
        F.col("o_orderkey").alias("nest_id"),
        (F.col("o_orderpriority") if place is None else place).alias("location"), star.month_id("o_orderdate").alias("period"),
        F.when(F.col("o_orderstatus") != "P", day).alias("hatch_date"),
        F.when(F.col("o_totalprice") > 60000, F.date_add(day, 20)).alias("fledge_date"),
    )
    # Each dear order names itself and the next nest as wrong for its customer.
    wrong = orders.where(F.col("o_totalprice") > 300000).select(
        F.col("o_custkey").alias("entity"),
        F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1)).alias("nest_id"),
    )
    chicks = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("nest_id"), F.col("o_custkey").alias("entity")
    )
    segments = read_table(spark, folder, "customer")
    births = lookup(
        births, segments, {"entity": "c_custkey"}, {"c_mktsegment": "_segment"}, how="inner"
    ).withColumn("estimated", F.col("_segment") != "BUILDING").drop("_segment")
    origins = origin_location(history).withColumnRenamed("location", "origin")
    return cov.refine_birth_date(origins, births, nests, chicks, star.sightings(spark, folder), wrong)


@query(
    "entity:l birth_date_1:s birth_date_2:s fitting_nests:l",
    f"WITH {sql.RES}, {sql.FIRSTS}, {sql.BIRTHS}, {_refined_sql()} SELECT * FROM refined_births",
)
def refined_start(spark, folder):
    return _refined(spark, folder, star.residency(spark, folder), star.births(spark, folder))


@query(
    "mean:d sd:d n:l lower:d upper:d",
    """
    SELECT avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n,
           avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value)) AS lower,
           avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value)) AS upper
    FROM events
    """,
)
def ci_threshold(spark, folder):
    return cov.ci_limits(read_table(spark, folder, "events"), "value")


@query(
    "n:l mean:d sd:d min:d max:d",
    """
    SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max
    FROM events
    """,
)
def overview(spark, folder):
    return overview_of(read_table(spark, folder, "events"), "value")


@query(
    "entity:l moved:s reached_min_age:l event_year:l",
    f"""
    WITH {sql.MOVEMENT},
    seen AS (SELECT entity, max(period_end) AS last_day FROM res WHERE status <> 'P' GROUP BY entity),
    aged AS (SELECT m.*, event_date - birth_date AS age, birth_date FROM movement m JOIN births USING (entity)),
    ci AS (SELECT avg(age) + 1.959963984540054 * stddev_samp(age) / sqrt(count(age)) AS upper
           FROM aged WHERE moved = '1')
    SELECT entity, moved, year(event_date) AS event_year,
           CASE WHEN moved = '0' THEN cast(coalesce(last_day - birth_date > upper, false) AS integer) END AS reached_min_age
    FROM aged LEFT JOIN seen USING (entity), ci
    """,
)
def reached_min_age(spark, folder):
    seen = cov.last_seen(star.home_residency(spark, folder), ["P"])
    flagged = cov.reached_min_age(home_movement(spark, folder), star.births(spark, folder), seen)
    return cov.with_years(flagged, {"event_year": "event_date"})


# Population and groups -------------------------------------------------------------------


@query(
    "entity:l last_period:l population_all:l population_old:l",
    f"""
    WITH {sql.TRIPS},
    usable AS (SELECT entity, period, replace(replace(status, 'F', 'FL'), 'P', 'NSA') AS status FROM res),
    everyone AS (SELECT period, count(DISTINCT entity) AS n FROM usable
                 WHERE status NOT LIKE '%NS%' GROUP BY period),
    grown AS (SELECT period, count(DISTINCT entity) AS n FROM usable
              WHERE status NOT LIKE '%NS%' AND status NOT LIKE '%FL%' GROUP BY period)
    SELECT entity, last_period, e.n AS population_all, g.n AS population_old FROM trips
    LEFT JOIN everyone e ON e.period = last_period LEFT JOIN grown g ON g.period = last_period
    """,
)
def population_density(spark, folder):
    status = F.replace(F.replace("status", F.lit("F"), F.lit("FL")), F.lit("P"), F.lit("NSA"))
    statuses = star.residency(spark, folder).withColumn("status", status)
    return cov.with_population(star.trips(spark, folder), statuses)


def _group_sql(core: str) -> str:
    return f"""
    WITH {sql.TRIPS}, {sql.MONTHS},
    statuses AS (SELECT entity, period, location,
                        CASE status WHEN 'P' THEN 'NSA' WHEN 'O' THEN 'CH' ELSE status END AS status FROM res),
    single AS (SELECT entity, period, max(location) AS location, max(status) AS status FROM statuses
               WHERE status = 'NSA' AND location <> '5-LOW' GROUP BY entity, period HAVING count(*) = 1),
    counted AS (SELECT period, location, status FROM statuses {core}
                UNION ALL SELECT period, location, status FROM single),
    sizes AS (SELECT period, location, count(*) AS n FROM counted GROUP BY period, location),
    olds AS (SELECT period, location, count(*) AS n FROM counted WHERE status NOT IN ('CH', 'FL', 'OFL', 'XF')
             GROUP BY period, location)
    SELECT t.entity, coalesce(a.n, c.n) AS group_all, coalesce(b.n, d.n) AS group_old
    FROM trips t LEFT JOIN months m ON m.period = t.last_period
    LEFT JOIN sizes a ON a.period = t.last_period AND a.location = t.origin
    LEFT JOIN olds b ON b.period = t.last_period AND b.location = t.origin
    LEFT JOIN sizes c ON c.period = m.prev_period AND c.location = t.origin
    LEFT JOIN olds d ON d.period = m.prev_period AND d.location = t.origin
    WHERE m.prev_period IS NOT NULL
    """


def _with_group_size(spark, folder, base):
    status = F.when(F.col("status") == "P", "NSA").when(F.col("status") == "O", "CH").otherwise(F.col("status"))
    statuses = star.residency(spark, folder).withColumn("status", status)
    chain = period_chain(star.months(spark, folder))
    trips = previous_period(star.trips(spark, folder), chain)
    sizes = settle(cov.group_sizes(statuses, base=base, no_location="5-LOW"))
    return cov.with_group_size(trips, sizes)


@query("entity:l group_all:l group_old:l", _group_sql("WHERE status <> 'NSA'"))
def group_size(spark, folder):
    return _with_group_size(spark, folder, "filtered")


@query("entity:l group_all:l group_old:l", _group_sql(""))
def group_size_as_written(spark, folder):
    return _with_group_size(spark, folder, "as_written")


# Events, places, food ----------------------------------------------------------------------

FLAGGED = (199601, 199602, 199707, 199808, 200001)


@query(
    "entity:l near_event:l",
    f"""
    WITH {sql.TRIPS}
    SELECT entity, CASE WHEN last_period IN {FLAGGED} THEN 1 ELSE 0 END AS near_event FROM trips
    """,
)
def period_flag(spark, folder):
    return cov.with_period_flag(star.trips(spark, folder), FLAGGED)


@query(
    "entity:l exposures:l exposed:s",
    f"""
    WITH {sql.TRIPS}, {sql.MONTHS}, {sql.BIRTHS},
    hits AS (
      SELECT t.entity, count(*) AS n FROM trips t JOIN births b USING (entity)
      JOIN months m ON m.period_end >= cast(b.birth_date + INTERVAL 6 MONTH AS date) AND t.dest_start >= m.period_start
      WHERE m.period IN {FLAGGED} GROUP BY t.entity)
    SELECT entity, n AS exposures, CASE WHEN n IS NULL THEN 'N' ELSE 'Y' END AS exposed
    FROM trips LEFT JOIN hits USING (entity)
    """,
)
def exposure_count(spark, folder):
    trips = star.trips(spark, folder).withColumn("last_start", F.col("dest_start"))
    return cov.with_exposure(
        trips, star.births(spark, folder), star.months(spark, folder), events=FLAGGED, months=6
    )


def _measurements(spark, folder, location=None):
    """Parts shipped from each place and month: size as easting, price as northing."""
    shipped = star.shipments(spark, folder, location)
    items = shipped.select(
        "location", star.month_id("l_shipdate").alias("period"), "l_partkey",
        F.col("l_returnflag").alias("method"),
    ).distinct()
    part = read_table(spark, folder, "part")
    located = lookup(
        items, part, {"l_partkey": "p_partkey"}, {"p_size": "_size", "p_retailprice": "northing"}, how="inner"
    )
    return located.select(
        "location", "period", "method", F.col("l_partkey").alias("tie"),
        F.nullif(F.col("_size").cast("double"), F.lit(50.0)).alias("easting"), "northing",
        (F.col("_size") / F.lit(2.0)).alias("size"),
    )


def _places_sql(location: str = "o_orderpriority") -> str:
    return f"""
    items AS (SELECT DISTINCT {location} AS location, year(l_shipdate) * 100 + month(l_shipdate) AS period,
                     l_partkey, l_returnflag AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    places AS (
      SELECT location, period, method, l_partkey AS tie, cast(p_size AS double) AS easting,
             p_retailprice AS northing, p_size / 2.0 AS size
      FROM items JOIN part ON l_partkey = p_partkey WHERE p_size <> 50
      QUALIFY row_number() OVER (PARTITION BY location, period ORDER BY method, l_partkey) = 1)"""


_PLACES_SQL = _places_sql()


@query(
    "location:s period:l method:s easting:d northing:d size:d",
    f"WITH {_PLACES_SQL} SELECT * FROM places",
)
def preferred_measurement(spark, folder):
    return cov.preferred_measurement(_measurements(spark, folder))


@query(
    "entity:l distance:d origin_size:d dest_size:d",
    f"""
    WITH {sql.TRIPS}, {_PLACES_SQL},
    spots AS (SELECT nullif(location, '5-LOW') AS location, period, easting, northing, size FROM places),
    found AS (
      SELECT t.entity, coalesce(o1.easting, o2.easting) AS oe, coalesce(o1.northing, o2.northing) AS ono,
             coalesce(o1.size, o2.size) AS origin_size, coalesce(d1.easting, d2.easting) AS de,
             coalesce(d1.northing, d2.northing) AS dn, coalesce(d1.size, d2.size) AS dest_size
      FROM trips t
      LEFT JOIN spots o1 ON o1.location = t.origin AND o1.period = t.dest_period
      LEFT JOIN spots o2 ON o2.location = t.origin AND o2.period = t.last_period
      LEFT JOIN spots d1 ON d1.location = t.dest_location AND d1.period = t.dest_period
      LEFT JOIN spots d2 ON d2.location = t.dest_location AND d2.period = t.last_period)
    SELECT entity, sqrt(power(de - oe, 2) + power(dn - ono, 2)) AS distance, origin_size, dest_size FROM found
    """,
)
def distance(spark, folder):
    places = cov.preferred_measurement(_measurements(spark, folder))
    spots = settle(places.withColumn("location", F.nullif(F.col("location"), F.lit("5-LOW"))))
    return cov.with_distance(star.trips(spark, folder), spots)


@query(
    "entity:l",
    f"""
    WITH {sql.TRIPS}, {_PLACES_SQL},
    spots AS (SELECT nullif(location, '5-LOW') AS location, period FROM places)
    SELECT t.entity FROM trips t
    WHERE NOT EXISTS (SELECT 1 FROM spots s WHERE s.location = t.origin AND s.period IN (t.dest_period, t.last_period))
       OR NOT EXISTS (SELECT 1 FROM spots s WHERE s.location = t.dest_location
                      AND s.period IN (t.dest_period, t.last_period))
    """,
)
def missing_distance(spark, folder):
    return distance(spark, folder).where(F.col("distance").isNull()).select("entity")


@query(
    "entity:l last_year:l food_density:d",
    f"""
    WITH {sql.TRIPS},
    means AS (SELECT nullif(year(o_orderdate), 1995) AS year, year(o_orderdate) * 100 +
                     CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 AND year(o_orderdate) <> 1997 THEN 7 ELSE 12 END AS period,
                     max(o_totalprice) AS value FROM orders GROUP BY ALL),
    kept AS (SELECT year, value FROM means WHERE period % 100 = 7 OR period = 199712)
    SELECT entity, year(last_start) AS last_year, value AS food_density
    FROM trips LEFT JOIN kept ON year = year(last_start)
    """,
)
def food_density(spark, folder):
    orders = read_table(spark, folder, "orders")
    year = F.year("o_orderdate")
    # Each half-year is surveyed once; 1997 has no summer survey, and that of 1995 names no year.
    survey = F.when(F.month("o_orderdate").between(4, 9) & (year != 1997), 7).otherwise(12)
    means = orders.groupBy(
        F.when(year != 1995, year).alias("year"), (year * 100 + survey).alias("period")
    ).agg(F.max("o_totalprice").alias("value"))
    by_year = settle(cov.food_density_by_year(means, star.months(spark, folder), stand_in_years=[1997]))
    return cov.with_year_value(star.trips(spark, folder), by_year, "food_density")


_ABUNDANCE_SQL = """
    quality AS (
      SELECT year(l_shipdate) AS year, nullif(l_quantity, 50) AS quality,
             CASE WHEN l_quantity = 1 AND year(l_shipdate) = 1999 THEN NULL ELSE cast(l_extendedprice AS decimal(18, 2)) END AS food
      FROM lineitem WHERE month(l_shipdate) IN (3, 4, 5, 6, 7, 8, 9, 10)
        AND year(l_shipdate) * 100 + month(l_shipdate) IN (SELECT year(o_orderdate) * 100 + month(o_orderdate) FROM orders)),
    sums AS (SELECT year, CASE WHEN count(food) = count(*) THEN sum(food) END AS total
             FROM quality WHERE quality IS NOT NULL GROUP BY year)"""


@query(
    "entity:l last_year:l food_abundance:d",
    f"""
    WITH {sql.TRIPS}, {_ABUNDANCE_SQL},
    latest AS (SELECT o_custkey AS entity, max(date_trunc('month', o_orderdate)) AS last_start FROM orders GROUP BY o_custkey)
    SELECT entity, year(last_start) AS last_year, CASE WHEN year(last_start) = 1996 THEN 123.25 ELSE total END AS food_abundance
    FROM (SELECT entity, last_start FROM trips UNION ALL SELECT entity, last_start FROM latest) LEFT JOIN sums ON year = year(last_start)
    """,
)
def food_abundance(spark, folder):
    """Of the last origin period of each move, and of each customer's last month: the calendar ends within the last summer."""
    latest = star.residency(spark, folder).groupBy("entity").agg(F.max("period_start").alias("last_start"))
    places = star.trips(spark, folder).select("entity", "last_start").unionByName(latest)
    return _with_abundance(spark, folder, places, star.months(spark, folder))


def _with_abundance(spark, folder, movement, calendar):
    return cov.with_year_value(movement, _abundance(spark, folder, calendar), "food_abundance", {1996: 123.25})


def _abundance(spark, folder, calendar):
    items = read_table(spark, folder, "lineitem")
    quality = items.select(
        F.year("l_shipdate").alias("year"), star.month_id("l_shipdate").alias("period"),
        F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("quality"),
        F.when(~((F.col("l_quantity") == 1) & (F.year("l_shipdate") == 1999)), F.col("l_extendedprice").cast("decimal(18, 2)")).alias("food"),
    )
    return settle(cov.food_abundance_by_year(quality, calendar))


# Tests ---------------------------------------------------------------------------------------


def _tests(spark, folder):
    return star.shipments(spark, folder).select(
        "entity", star.month_id("l_shipdate").alias("period"), F.col("l_returnflag").alias("result"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("n_tests"),
    )


_TESTS_SQL = f"""
    WITH {sql.TRIPS},
    tests AS (SELECT o_custkey AS entity, year(l_shipdate) * 100 + month(l_shipdate) AS period,
                     l_returnflag AS result, cast(l_shipdate AS date) AS date, l_linenumber AS n_tests
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    records AS (SELECT DISTINCT entity, period, result, date FROM tests)"""


@query(
    "entity:l test_period:l result:s date:s days_to_event:l",
    _TESTS_SQL + """
    SELECT entity, period AS test_period, result, date, event_date - date AS days_to_event
    FROM trips JOIN records USING (entity) WHERE abs(event_date - date) <= 14
    """,
)
def day_range_proximity(spark, folder):
    return cov.tests_near_event(star.trips(spark, folder), _tests(spark, folder), 14)


@query(
    "entity:l test_period:l result:s date:s days_to_event:l",
    _TESTS_SQL + """
    SELECT entity, period AS test_period, result, date, event_date - date AS days_to_event
    FROM trips JOIN records USING (entity) WHERE abs(event_date - date) <= 21
    """,
)
def three_week_proximity(spark, folder):
    return cov.tests_near_event(star.trips(spark, folder), _tests(spark, folder), 21)


@query(
    "entity:l test_period:l result:s date:s days_to_event:l",
    _TESTS_SQL + """
    SELECT entity, period AS test_period, result, date, event_date - date AS days_to_event
    FROM trips JOIN records USING (entity) WHERE period = last_period
    """,
)
def last_period_gaps(spark, folder):
    return cov.last_period_gaps(star.trips(spark, folder), _tests(spark, folder))


@query(
    "entity:l tests:l",
    _TESTS_SQL + """
    SELECT entity, count(*) AS tests FROM trips JOIN records USING (entity) WHERE period = last_period
    GROUP BY entity
    """,
)
def tests_in_last_period(spark, folder):
    return cov.tests_in_last_period(star.trips(spark, folder), _tests(spark, folder))


_OVERVIEW_SQL = _TESTS_SQL + f""", {sql.MONTHS},
    kept AS (SELECT t.entity, n.n_tests, t.last_period, m.prev_period AS second_last_period, event_date
             FROM trips t JOIN months m ON m.period = t.last_period AND m.prev_period IS NOT NULL
             LEFT JOIN (SELECT DISTINCT entity, nullif(n_tests, 4) AS n_tests FROM tests) n
             ON n.entity = t.entity)"""


def _test_overview(spark, folder):
    tests = _tests(spark, folder).withColumn("n_tests", F.nullif(F.col("n_tests"), F.lit(4)))
    trips = previous_period(star.trips(spark, folder), period_chain(star.months(spark, folder)))
    return cov.test_overview(trips, tests)


@query("n_tests:l n:l", _OVERVIEW_SQL + """
    SELECT n_tests, count(*) AS n FROM kept WHERE n_tests IS NOT NULL GROUP BY n_tests
""")
def test_frequency(spark, folder):
    return cov.frequency(_test_overview(spark, folder), "n_tests")


@query("null_cells:l", _OVERVIEW_SQL + " SELECT count(*) AS null_cells FROM kept WHERE n_tests IS NULL")
def null_cell_count(spark, folder):
    return null_cells(_test_overview(spark, folder))


# Quality series --------------------------------------------------------------------------------

_SERIES_SQL = """
    WITH daily AS (SELECT user_id AS location, cast(ts AS date) - DATE '1970-01-01' AS period,
                          CASE WHEN count(*) > 1 THEN max(value) END AS quality
                   FROM events GROUP BY ALL),
    series AS (SELECT *, CASE WHEN (period % 10) / 10.0 >= 0.5 THEN 'Summer' ELSE 'Winter' END AS season FROM daily),
    filled AS (
      SELECT location, period, season, quality,
             last_value(quality IGNORE NULLS) OVER past AS prev_known,
             first_value(quality IGNORE NULLS) OVER future AS next_known
      FROM series
      WINDOW past AS (PARTITION BY location, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             future AS (PARTITION BY location, season ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    complete AS (
      SELECT location, period, season,
             (coalesce(next_known, prev_known) + coalesce(prev_known, next_known)) / 2 AS quality FROM filled)"""


@query("location:l period:l season:s quality:d", _SERIES_SQL + " SELECT * FROM complete")
def gap_fill_by_season(spark, folder):
    return cov.gap_fill_by_season(*star.quality_series(spark, folder))


@query("location:l period:l season:s quality:d", _SERIES_SQL + " SELECT * FROM complete")
def gap_fill_hot_locations(spark, folder):
    """The same fill with every location treated as hot: series are split into blocks."""
    return cov.gap_fill_by_season(*star.quality_series(spark, folder), parts=64)


@query(
    "location:l period:l ahead:d back:d",
    _SERIES_SQL + """
    SELECT location, period, coalesce(next_known, prev_known) AS ahead, coalesce(prev_known, next_known) AS back
    FROM filled
    """,
)
def fill_directions(spark, folder):
    measured, calendar = star.quality_series(spark, folder)
    series = lookup(
        calendar, measured, {"location": "location", "period": "period"}, {"quality": "ahead"}
    ).withColumns({"back": F.col("ahead"), "season": F.col("season_index") >= 0.5})
    keys = ["location", "season"]
    filled = fill_nearest(series, keys, "period", "period", "ahead", "updown")
    return fill_nearest(filled, keys, "period", "period", "back", "downup")


@query(
    "entity:l quality_dest_place_dest_period:d quality_origin_place_dest_period:d "
    "quality_dest_place_last_period:d quality_origin_place_last_period:d",
    f"""
    WITH {sql.TRIPS},
    q AS (SELECT nullif(o_orderpriority, '5-LOW') AS location, year(o_orderdate) * 100 + month(o_orderdate) AS period,
                 max(o_totalprice) AS quality FROM orders GROUP BY ALL)
    SELECT entity, a.quality AS quality_dest_place_dest_period, b.quality AS quality_origin_place_dest_period,
           c.quality AS quality_dest_place_last_period, d.quality AS quality_origin_place_last_period
    FROM trips
    LEFT JOIN q a ON a.location = dest_location AND a.period = dest_period
    LEFT JOIN q b ON b.location = origin AND b.period = dest_period
    LEFT JOIN q c ON c.location = dest_location AND c.period = last_period
    LEFT JOIN q d ON d.location = origin AND d.period = last_period
    """,
)
def multi_lookup(spark, folder):
    place = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    quality = read_table(spark, folder, "orders").groupBy(
        place.alias("location"), star.month_id("o_orderdate").alias("period")
    ).agg(F.max("o_totalprice").alias("quality"))
    return cov.with_quality(star.trips(spark, folder), settle(quality))


# Wide table --------------------------------------------------------------------------------------

_WIDE_SQL = f"""
    WITH {sql.MOVEMENT}, {_refined_sql(sql.TWO_WAY)}, {_places_sql(sql.TWO_WAY)}, {_ABUNDANCE_SQL},
    aged AS (SELECT entity, birth_date_1, birth_date_2, event_date - birth_date_1 AS age, event_date - birth_date_2 AS age_2
             FROM movement JOIN refined_births USING (entity)),
    limits AS (SELECT avg(age) FILTER (moved = '1') + 1.959963984540054e0 * stddev_samp(age) FILTER (moved = '1')
                      / sqrt(count(age) FILTER (moved = '1')) AS upper_1,
                      avg(age_2) FILTER (moved = '1') + 1.959963984540054e0 * stddev_samp(age_2) FILTER (moved = '1')
                      / sqrt(count(age_2) FILTER (moved = '1')) AS upper_2 FROM movement JOIN aged USING (entity)),
    seen AS (SELECT entity, max(period_end) AS last_day FROM res WHERE status <> 'P' GROUP BY entity),
    old AS (SELECT m.entity,
                   CASE WHEN m.moved = '0' THEN cast(coalesce(last_day - birth_date_1 > upper_1, false) AS int) END AS reached_min_age,
                   CASE WHEN m.moved = '0' THEN cast(coalesce(last_day - birth_date_2 > upper_2, false) AS int) END AS reached_min_age_2
            FROM movement m JOIN aged USING (entity) LEFT JOIN seen USING (entity), limits),
    apart AS (
      SELECT t.entity, coalesce(o1.easting, o2.easting) AS oe, coalesce(o1.northing, o2.northing) AS ono,
             coalesce(o1.size, o2.size) AS origin_size, coalesce(d1.easting, d2.easting) AS de,
             coalesce(d1.northing, d2.northing) AS dn, coalesce(d1.size, d2.size) AS dest_size
      FROM movement t
      LEFT JOIN places o1 ON o1.location = t.origin AND o1.period = t.dest_period
      LEFT JOIN places o2 ON o2.location = t.origin AND o2.period = t.last_period
      LEFT JOIN places d1 ON d1.location = t.dest_location AND d1.period = t.dest_period
      LEFT JOIN places d2 ON d2.location = t.dest_location AND d2.period = t.last_period),
    pops AS (SELECT period, count(DISTINCT entity) AS population_all FROM res GROUP BY period),
    sizes AS (SELECT period, location, count(*) AS group_all FROM res GROUP BY period, location),
    hits AS (
      SELECT m.entity, count(*) AS exposures FROM movement m JOIN births b USING (entity)
      JOIN months c ON c.period_end >= cast(b.birth_date + INTERVAL 5 MONTH AS date) AND m.last_start >= c.period_start
      WHERE c.period IN {FLAGGED} GROUP BY m.entity),
    food AS (SELECT nullif(year(o_orderdate), 1995) AS year, max(o_totalprice) AS food_density FROM orders GROUP BY 1),
    wide AS (
      SELECT m.entity, m.moved, m.inherit, m.event_date, m.event_season, a.birth_date_1, a.birth_date_2, a.age, a.age_2,
             reached_min_age, reached_min_age_2, sqrt(power(de - oe, 2) + power(dn - ono, 2)) AS distance, origin_size, dest_size,
             CASE WHEN year(m.last_start) = 1996 THEN 123.25 ELSE total END AS food_abundance, p.population_all,
             coalesce(s1.group_all, s2.group_all) AS group_all, h.exposures,
             CASE WHEN h.exposures IS NULL THEN 'N' ELSE 'Y' END AS exposed,
             CASE WHEN m.last_period IN {FLAGGED} THEN 1 ELSE 0 END AS near_event,
             f.food_density, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS sex
      FROM movement m JOIN aged a USING (entity) JOIN old USING (entity) JOIN apart USING (entity)
      LEFT JOIN sums ON sums.year = year(m.last_start)
      LEFT JOIN pops p ON p.period = m.last_period
      LEFT JOIN sizes s1 ON s1.period = m.last_period AND s1.location = m.origin
      LEFT JOIN sizes s2 ON s2.period = m.second_last_period AND s2.location = m.origin
      LEFT JOIN hits h ON h.entity = m.entity
      LEFT JOIN food f ON f.year = year(m.last_start)
      LEFT JOIN customer ON c_custkey = m.entity)"""
_WIDE_SPEC = (
    "entity:l moved:s inherit:l event_date:s event_season:s birth_date_1:s birth_date_2:s age:l age_2:l "
    "reached_min_age:l reached_min_age_2:l distance:d origin_size:d dest_size:d food_abundance:d population_all:l group_all:l "
    "exposures:l exposed:s near_event:l food_density:d sex:l"
)


def _group_sizes(history):
    return settle(cov.group_sizes(history, vague=[], unseen="-", no_location="-"))


def _yearly_food(spark, folder):
    year = F.year("o_orderdate")
    by_year = read_table(spark, folder, "orders").groupBy(F.when(year != 1995, year).alias("year"))
    return settle(by_year.agg(F.max("o_totalprice").alias("food_density")))


def _sex(spark, folder):
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") > 5000).cast("int").alias("sex")
    )


def _aged(movement, refined, seen):
    """Both birth dates with the ages they give, and for non-movers whether they reached the movers' age."""
    out = movement
    for birth, name in (("birth_date_1", "reached_min_age"), ("birth_date_2", "reached_min_age_2")):
        out = cov.reached_min_age(out, refined, seen, birth=birth, name=name)
    for birth, name in (("birth_date_1", "age"), ("birth_date_2", "age_2")):
        out = cov.age_at_event(out, refined, birth=birth, name=name)
    return out


def _places(spark, folder):
    return settle(cov.preferred_measurement(_measurements(spark, folder, star.two_way_location())))


class _Parts:
    """The movement table and all tables that its covariates come from, made side by side."""

    def __init__(self, spark, folder):
        self.history = star.home_residency(spark, folder)
        self.births, self.calendar = star.births(spark, folder), star.months(spark, folder)
        self.seen = cov.last_seen(self.history, ("P",))
        self.movement, self.refined, self.places, self.abundance, self.population, self.sizes, self.food = together(
            lambda: settle(home_movement(spark, folder, self.calendar)),
            lambda: settle(_refined(spark, folder, self.history, self.births, star.two_way_location())),
            lambda: _places(spark, folder),
            lambda: _abundance(spark, folder, self.calendar),
            lambda: settle(cov.population_by_period(self.history)),
            lambda: _group_sizes(self.history),
            lambda: _yearly_food(spark, folder),
        )

    def with_abundance(self, movement):
        return cov.with_year_value(movement, self.abundance, "food_abundance", {1996: 123.25})

    def with_food(self, movement):
        return cov.with_year_value(movement, self.food, "food_density")

    def with_exposure(self, movement):
        return cov.with_exposure(movement, self.births, self.calendar, events=FLAGGED)


def wide_table(spark, folder):
    """Every covariate added to the movement table in place."""
    parts = _Parts(spark, folder)
    out = _aged(parts.movement, parts.refined, parts.seen)
    out = cov.with_distance(out, parts.places)
    out = parts.with_abundance(out).drop("last_year")
    out = cov.with_population(out, counts=parts.population)
    out = cov.with_group_size(out, parts.sizes)
    out = cov.with_period_flag(parts.with_exposure(out), FLAGGED)
    out = parts.with_food(out)
    return lookup(out, _sex(spark, folder), {"entity": "entity"}, {"sex": "sex"})


@query(_WIDE_SPEC, _WIDE_SQL + " SELECT * FROM wide")
def collate_wide(spark, folder):
    return wide_table(spark, folder)


@query(_WIDE_SPEC, _WIDE_SQL + " SELECT * FROM wide")
def collate_by_entity(spark, folder):
    """The same table from separate per-entity covariate tables, each a store bucketed by entity, joined by entity."""
    parts = _Parts(spark, folder)
    movement = settle_by(parts.movement.repartition("entity"), "entity")
    only = lambda df, *columns: df.select("entity", *columns)
    stored = lambda df, *columns: lambda: by_entity(only(df, *columns))
    tables = together(
        stored(_aged(movement, parts.refined, parts.seen), "birth_date_1", "birth_date_2", "age", "age_2", "reached_min_age", "reached_min_age_2"),
        stored(cov.with_distance(movement, parts.places), "distance", "origin_size", "dest_size"),
        stored(parts.with_abundance(movement), "food_abundance"),
        stored(cov.with_population(movement, counts=parts.population), "population_all"),
        stored(cov.with_group_size(movement, parts.sizes), "group_all"),
        stored(parts.with_exposure(movement), "exposures", "exposed"),
        stored(cov.with_period_flag(movement, FLAGGED), "near_event"),
        stored(parts.with_food(movement), "food_density"),
        lambda: by_entity(_sex(spark, folder)),
    )
    return collate(only(movement, "moved", "inherit", "event_date", "event_season"), tables[:5], tables[5:])


@query(
    "entity:l moved:s age:l event_id:l score:d",
    _WIDE_SQL + """
    SELECT entity, moved, age, event_id, value AS score FROM wide JOIN events ON user_id = entity
    WHERE event_type = 'signup'
    """,
)
def wide_with_assays(spark, folder):
    assays = read_table(spark, folder, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("entity"), "event_id", F.col("value").alias("score")
    )
    return with_assays(wide_table(spark, folder), assays)
