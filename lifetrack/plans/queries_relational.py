"""Queries for scans, filters, joins, set operations and group rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, cast_columns, contains_any, ifelse, recode
from ..operators import joins, ordered, residency as res_ops
from ..operators.covariates import last_seen as last_seen_of, residence_periods
from ..operators.periods import overlap_join, period_chain, previous_period
from ..session import new_folder
from ..sources import star
from ..sources import files
from ..sources.files import read_table
from . import sql_parts as sql
from .registry import query


# Scans and projections -----------------------------------------------------------


@query(
    "tie:l number:l day:s label:s",
    """
    SELECT o_orderkey AS tie, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN NULL ELSE o_custkey END AS number,
           CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(o_orderdate AS date) END AS day,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_clerk END AS label
    FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)
    """,
)
def csv_rules(spark, folder):
    """The rules of the file reader on lines of text: NA and blanks are null, dates are dd/MM/yyyy, bad values null."""
    return files.parse_csv(_order_lines(spark, folder), "line", _ORDER_LINE)


_ORDER_LINE = "tie bigint, number bigint, day date, label string"


def _order_lines(spark, folder):
    orders = read_table(spark, folder, "orders")
    status, low = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
    number = F.when(status == "F", "NA").when(status == "P", "twelve").otherwise(F.col("o_custkey").cast("string"))
    day = F.when(status == "F", "").when(low, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    label = F.when(status == "P", "NA").otherwise(F.col("o_orderpriority"))
    return orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), number, day, label).alias("line"))


@query(
    "kind:s columns:s line:s n:l",
    """
    WITH raw AS (
      SELECT o_orderkey, o_orderstatus AS s, o_orderpriority = '5-LOW' AS low, o_orderdate AS d, o_orderpriority AS p FROM orders),
    lines AS (
      SELECT concat_ws(',', cast(o_orderkey AS varchar), CASE s WHEN 'F' THEN 'NA' WHEN 'P' THEN 'twelve' ELSE cast(o_custkey AS varchar) END,
                       CASE WHEN s = 'F' THEN '' WHEN low THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%d/%m/%Y') END,
                       CASE WHEN s = 'P' THEN 'NA' ELSE p END) || CASE WHEN o_orderkey % 7 = 0 THEN ',more' ELSE '' END AS line,
             o_orderkey % 7 = 0 AS longer, s, low
      FROM raw JOIN (SELECT o_orderkey, o_custkey FROM orders) USING (o_orderkey)),
    marked AS (
      SELECT line, concat_ws(',', CASE WHEN s = 'P' THEN 'number' END, CASE WHEN s <> 'F' AND low THEN 'day' END) AS bad, longer FROM lines),
    named AS (SELECT line, CASE WHEN bad = '' AND longer THEN '(fields)' ELSE bad END AS columns FROM marked)
    SELECT 'rejected' AS kind, columns, line, 1 AS n FROM named WHERE columns <> ''
    UNION ALL SELECT 'kept', NULL, NULL, count(*) FROM named WHERE columns = ''
    UNION ALL SELECT 'read', NULL, NULL, count(*) FROM named
    """,
)
def csv_rejects(spark, folder):
    """Lines that do not fit their schema, with the columns at fault; good and rejected lines add up to those read."""
    lines = _order_lines(spark, folder)
    longer = F.substring_index("line", ",", 1).cast("bigint") % 7 == 0
    lines = lines.select(F.concat("line", F.when(longer, ",more").otherwise("")).alias("line"))
    good, rejects = files.parse_csv_with_rejects(lines, "line", _ORDER_LINE)
    listed = rejects.select(F.lit("rejected").alias("kind"), F.array_join("columns", ",").alias("columns"), "line", F.lit(1).alias("n"))
    none = F.lit(None).cast("string")
    counted = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), none.alias("columns"), none.alias("line"), "n")
    return listed.unionByName(counted(good, "kept")).unionByName(counted(lines, "read"))


@query(
    "layout:s tie:l entity:l location:s status:s period:l period_start:s",
    f"""
    WITH {sql.RES},
    rows AS (SELECT tie, entity, CASE WHEN location = '5-LOW' THEN 'LOW, "5"' ELSE location END AS location, nullif(status, 'P') AS status,
                    period, CASE WHEN status <> 'F' THEN period_start END AS period_start FROM res)
    SELECT 'plain' AS layout, * FROM rows UNION ALL SELECT 'numbered' AS layout, * FROM rows
    """,
)
def csv_files(spark, folder):
    """The history written to CSV files and read again: once as written, once with row numbers in front and d/m/y dates."""
    names = ["tie", "entity", "location", "status", "period", "period_start"]
    low = F.col("location") == "5-LOW"
    rows = star.residency(spark, folder).select(*names).withColumns({
        "location": F.when(low, 'LOW, "5"').otherwise(F.col("location")),
        "period_start": F.when(F.col("status") != "F", F.col("period_start")), "status": F.nullif(F.col("status"), F.lit("P")),
    })
    kinds = "tie bigint, entity bigint, location string, status string, period int, period_start date"
    plain, numbered = new_folder(spark), new_folder(spark)
    files.write_csv(rows, plain)
    day = F.date_format("period_start", "dd/MM/yyyy").alias("period_start")
    files.write_csv(rows.select(F.col("tie").alias("row_index"), *names[:-1], day), numbered)
    read = [
        files.read_csv(spark, plain, kinds, date_format="yyyy-MM-dd").withColumn("layout", F.lit("plain")),
        files.read_csv(spark, numbered, kinds, leading_index=True).withColumn("layout", F.lit("numbered")),
    ]
    return read[0].unionByName(read[1])


@query(
    "entity:l segment:s code:l bad_code:l balance:d copy:d source:s nothing:l",
    """
    SELECT c_custkey AS entity, nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, '') AS segment,
           try_cast(substr(c_name, 10) AS bigint) AS code, try_cast(c_name AS bigint) AS bad_code,
           c_acctbal AS balance, c_acctbal AS copy, 'field' AS source, cast(NULL AS bigint) AS nothing
    FROM customer
    """,
)
def typed_scan(spark, folder):
    customer = read_table(spark, folder, "customer").drop("c_nationkey")
    named = customer.withColumnsRenamed({"c_custkey": "entity", "c_acctbal": "balance"}).select(
        "entity",
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.substring("c_name", 10, 20).alias("code"),
        F.col("c_name").alias("bad_code"),
        "balance",
    )
    typed = cast_columns(blank_to_null(named), {"code": "bigint", "bad_code": "bigint"})
    return typed.withColumns({
        "copy": F.col("balance"), "source": F.lit("field"), "nothing": F.lit(None).cast("bigint"),
    })


@query(
    "entity:l location:s status:s period:l period_start:s period_end:s",
    f"""
    WITH {sql.RES}, parentage AS (
      SELECT r.*, o_totalprice / 500000.0 AS p FROM res r JOIN orders ON o_orderkey = r.tie)
    SELECT entity, location, status, period, period_start, period_end FROM res WHERE status IN ('F', 'O')
    UNION SELECT entity, location, 'CH', period, period_start, period_end FROM parentage
      WHERE p >= 0.8 AND location <= '3-MEDIUM'
    UNION SELECT entity, location, 'CH', period, period_start, period_end FROM parentage
      WHERE p >= 0.8 AND location >= '3-MEDIUM'
    """,
)
def threshold_union_distinct(spark, folder):
    orders = read_table(spark, folder, "orders")
    parentage = orders.select(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("location"),
        star.month_id("o_orderdate").alias("period"),
        star.month_start("o_orderdate").alias("period_start"),
        F.last_day("o_orderdate").alias("period_end"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("p"),
    )
    first = parentage.where(F.col("location") <= "3-MEDIUM")
    second = parentage.where(F.col("location") >= "3-MEDIUM")
    seen = star.residency(spark, folder).where(F.col("status").isin("F", "O"))
    return res_ops.collate_residency([first, second], seen)


@query(
    "tie:l entity:l location:s status:s",
    f"""
    WITH {sql.RES}, holes AS (
      SELECT tie, entity, period_start, period_end, nullif(location, '5-LOW') AS location,
             nullif(status, 'P') AS status, nullif(location, '2-HIGH') AS other FROM res)
    SELECT tie, entity, location, status FROM holes
    WHERE status IN ('F', 'O') AND NOT coalesce(contains(location, 'MEDIUM'), false)
      AND location IS NOT NULL AND period_end >= period_start
      AND (other IS NULL OR other = location) AND location <> '1-URGENT'
    """,
)
def status_filters(spark, folder):
    holes = star.residency(spark, folder).select(
        "tie", "entity", "period_start", "period_end",
        F.nullif(F.col("location"), F.lit("5-LOW")).alias("location"),
        F.nullif(F.col("status"), F.lit("P")).alias("status"),
        F.nullif(F.col("location"), F.lit("2-HIGH")).alias("other"),
    )
    known = holes.where(F.col("status").isin("F", "O") & ~contains_any("location", ["MEDIUM"]))
    complete = known.dropna(how="any", subset=["location"])
    compared = complete.where(F.col("period_end") >= F.col("period_start"))
    return compared.where(
        (F.col("other").isNull() | (F.col("other") == F.col("location")))
        & (F.col("location") != "1-URGENT")
    )


@query(
    "tie:l code:l high:l",
    f"""
    WITH {sql.RES}
    SELECT tie,
           CASE WHEN s IS NULL THEN NULL WHEN s = 'O' THEN 1 WHEN s = 'F' THEN 2 ELSE 9 END AS code,
           CASE WHEN s IS NULL THEN NULL WHEN s = 'O' THEN 1 ELSE 0 END AS high
    FROM (SELECT tie, nullif(status, 'P') AS s FROM res)
    """,
)
def null_guarded_recode(spark, folder):
    rows = star.residency(spark, folder).withColumn("s", F.nullif(F.col("status"), F.lit("P")))
    return rows.withColumns({
        "code": recode("s", {"O": 1, "F": 2}, 9), "high": ifelse(F.col("s") == "O", 1, 0),
    })


# Group rules -------------------------------------------------------------------------


@query(
    "event_id:l user_id:l day:s n:l",
    """
    SELECT event_id, user_id, cast(ts AS date) AS day,
           count(*) OVER (PARTITION BY user_id, cast(ts AS date)) AS n
    FROM events QUALIFY n > 1
    """,
)
def group_size_filter(spark, folder):
    events = read_table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day")
    )
    shared = joins.keep_groups(events, ["user_id", "day"], lambda n: n > 1)
    return joins.with_group_count(shared, ["user_id", "day"], "n")


@query(
    "tie:l entity:l period:l",
    f"""
    WITH {sql.RES}
    SELECT tie, entity, period FROM res
    QUALIFY period_end = max(period_end) OVER (PARTITION BY entity)
    """,
)
def latest_with_ties(spark, folder):
    return joins.keep_group_max(star.residency(spark, folder), ["entity"], "period_end")


@query(
    "entity:l date_last_seen:s",
    f"""
    WITH {sql.RES}
    SELECT entity, max(period_end) AS date_last_seen FROM res WHERE status <> 'P' GROUP BY entity
    """,
)
def last_seen(spark, folder):
    return last_seen_of(star.residency(spark, folder), ["P"])


# Residency ---------------------------------------------------------------------------


@query(
    "tie:l entity:l location:s status:s",
    f"""
    WITH {sql.RES}
    SELECT tie, entity, location, CASE status WHEN 'P' THEN 'O' ELSE status END AS status FROM res
    WHERE NOT (status = 'O' AND entity IN (SELECT entity FROM res WHERE status = 'P'))
    """,
)
def fostered(spark, folder):
    return res_ops.resolve_fostered(star.residency(spark, folder), "P", "O")


@query(
    "tie:l entity:l location:s",
    f"""
    WITH {sql.RES}
    SELECT tie, entity, location FROM res JOIN customer ON c_custkey = entity
    WHERE NOT (c_mktsegment = 'BUILDING' AND status = 'F')
      AND NOT (c_mktsegment = 'MACHINERY' AND location = '1-URGENT')
      AND NOT (c_mktsegment = 'HOUSEHOLD')
    """,
)
def exclusions(spark, folder):
    customer = read_table(spark, folder, "customer")
    of = lambda segment, status, location: customer.where(F.col("c_mktsegment") == segment).select(
        F.col("c_custkey").alias("entity"),
        F.lit(status).cast("string").alias("status"), F.lit(location).cast("string").alias("location"),
    )
    patterns = of("BUILDING", "F", None).unionByName(of("MACHINERY", None, "1-URGENT")).unionByName(
        of("HOUSEHOLD", None, None)
    )
    return res_ops.apply_exclusions(star.residency(spark, folder), patterns)


@query(
    "tie:l entity:l location:s",
    f"""
    WITH {sql.RES}, one AS (
      SELECT r.*, c_mktsegment AS segment,
             CASE WHEN c_mktsegment = 'BUILDING' AND status = 'F' THEN 'MOVED' ELSE location END AS loc1
      FROM res r JOIN customer ON c_custkey = entity),
    two AS (
      SELECT *, CASE WHEN segment = 'BUILDING' AND loc1 = '1-URGENT' THEN 'MERGED' ELSE loc1 END AS loc2 FROM one)
    SELECT tie, entity,
           CASE WHEN segment = 'BUILDING' AND loc2 = 'MOVED' AND period = 199703 THEN 'LATE' ELSE loc2 END AS location
    FROM two
    """,
)
def corrections(spark, folder):
    building = read_table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING")
    schema = "rule int, status string, period int, location string, new_location string"
    steps = [(1, "F", None, None, "MOVED"), (2, None, None, "1-URGENT", "MERGED"), (3, None, 199703, "MOVED", "LATE")]
    listed = F.array(*[
        F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(step, schema.split(", "))])
        for step in steps
    ])
    rules = building.select(F.col("c_custkey").alias("entity"), F.inline(listed))
    return res_ops.apply_corrections(star.residency(spark, folder), rules)


@query(
    "entity:l locations:l",
    f"""
    WITH {sql.RES}
    SELECT entity, count(DISTINCT location) AS locations FROM res WHERE status IN ('O', 'P')
    GROUP BY entity HAVING count(DISTINCT location) > 1
    """,
)
def location_conflicts(spark, folder):
    return res_ops.location_conflicts(star.residency(spark, folder), ["O", "P"])


@query(
    "entity:l location:s status:s period:l tie:l",
    f"WITH {sql.RES}, {sql.FIRSTS} SELECT * FROM firsts",
)
def first_dup_kept(spark, folder):
    return res_ops.distinct_locations(star.residency(spark, folder))


@query(
    "entity:l location:s tie:l",
    f"WITH {sql.HOME}, {sql.FIRSTS} SELECT * FROM firsts WHERE places > 1",
)
def movers(spark, folder):
    return res_ops.movers(star.home_residency(spark, folder))


@query(
    "entity:l location:s tie:l",
    f"WITH {sql.HOME}, {sql.FIRSTS} SELECT * FROM firsts WHERE places = 1",
)
def non_movers(spark, folder):
    return res_ops.non_movers(star.home_residency(spark, folder))


@query(
    "entity:l location:s status:s period:l tie:l",
    f"WITH {sql.RES}, {sql.FIRSTS} SELECT * FROM firsts WHERE place = 2",
)
def second_location(spark, folder):
    return res_ops.second_location(star.residency(spark, folder))


@query(
    "entity:l location:s status:s",
    f"WITH {sql.RES}, {sql.FIRSTS} SELECT * FROM firsts WHERE place = 2 AND status IN ('O', 'P')",
)
def juvenile_destinations(spark, folder):
    return res_ops.juvenile_destinations(star.residency(spark, folder), ["O", "P"])


@query(
    "entity:l location:s status:s period:l period_start:s tie:l",
    f"""
    WITH {sql.RES}
    SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start, tie) = 1
    """,
)
def origin_location(spark, folder):
    return res_ops.origin_location(star.residency(spark, folder))


@query(
    "entity:l location:s period:l period_end:s tie:l",
    f"""
    WITH {sql.RES}
    SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC, tie) = 1
    """,
)
def last_location(spark, folder):
    return res_ops.last_location(star.residency(spark, folder))


# Joins -------------------------------------------------------------------------------


@query(
    "o_orderkey:l nation:s segment:s",
    """
    SELECT o_orderkey, n_name AS nation, c_mktsegment AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """,
)
def join_inner(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    named = joins.lookup(
        orders, customer, {"o_custkey": "c_custkey"},
        {"c_nationkey": "_nation", "c_mktsegment": "segment"}, how="inner",
    )
    return joins.lookup(named, nation, {"_nation": "n_nationkey"}, {"n_name": "nation"}, how="inner")


@query(
    "entity:l period:l orders:l shipped:l",
    f"""
    WITH {sql.RES}, {sql.ships()},
    a AS (SELECT entity, period, count(*) AS orders FROM res GROUP BY ALL),
    b AS (SELECT entity, period, count(*) AS shipped FROM ships GROUP BY ALL)
    SELECT * FROM a JOIN b USING (entity, period)
    """,
)
def join_multi_key(spark, folder):
    count = lambda df, name: df.groupBy("entity", "period").agg(F.count(F.lit(1)).alias(name))
    return joins.merge(
        count(star.residency(spark, folder), "orders"), count(star.sightings(spark, folder), "shipped"),
        ["entity", "period"], null_safe=False,
    )


@query(
    "n_nationkey:l n_name:s suppliers:l",
    """
    SELECT n_nationkey, n_name, suppliers FROM nation
    LEFT JOIN (SELECT nullif(s_nationkey, 3) AS s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
    ON s_nationkey = n_nationkey
    """,
)
def join_left(spark, folder):
    nations = F.col("s_nationkey")
    placed = read_table(spark, folder, "supplier").select(F.when(nations != 3, nations).alias("s_nationkey"))
    counts = placed.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    nation = read_table(spark, folder, "nation")
    return joins.lookup(nation, counts, {"n_nationkey": "s_nationkey"}, {"suppliers": "suppliers"})


@query(
    "entity:l segment:s spent:d",
    """
    SELECT c_custkey AS entity, c_mktsegment AS segment, spent
    FROM (SELECT o_custkey, max(o_totalprice) AS spent FROM orders GROUP BY 1)
    RIGHT JOIN customer ON o_custkey = c_custkey
    """,
)
def join_right(spark, folder):
    orders = read_table(spark, folder, "orders")
    spent = orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("spent"))
    customer = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")
    )
    return joins.merge(spent, customer, ["entity"], "right", null_safe=False)


_STATUS_YEAR_SQL = f"""
    WITH {sql.RES},
    a AS (SELECT nullif(status, 'P') AS status, nullif(location, '5-LOW') AS location, count(*) AS early
          FROM res WHERE period < 199901 GROUP BY ALL),
    b AS (SELECT nullif(status, 'P') AS status, nullif(location, '5-LOW') AS location, count(*) AS late
          FROM res WHERE period >= 199901 AND status <> 'O' GROUP BY ALL)
"""


def _by_status(spark, folder):
    rows = star.residency(spark, folder).select(
        F.nullif(F.col("status"), F.lit("P")).alias("status"),
        F.nullif(F.col("location"), F.lit("5-LOW")).alias("location"),
        "period",
        F.col("status").alias("raw"),
    )
    count = lambda df, name: df.groupBy("status", "location").agg(F.count(F.lit(1)).alias(name))
    early = count(rows.where(F.col("period") < 199901), "early")
    late = count(rows.where((F.col("period") >= 199901) & (F.col("raw") != "O")), "late")
    return early, late


_FULL_SQL = _STATUS_YEAR_SQL + """
    SELECT coalesce(a.status, b.status) AS status, coalesce(a.location, b.location) AS location, early, late
    FROM a FULL JOIN b ON a.status IS NOT DISTINCT FROM b.status AND a.location IS NOT DISTINCT FROM b.location
"""


@query("status:s location:s early:l late:l", _FULL_SQL)
def join_full_null_safe(spark, folder):
    early, late = _by_status(spark, folder)
    return joins.merge(early, late, ["status", "location"], "full")


@query("status:s location:s early:l late:l", _FULL_SQL)
def natural_full(spark, folder):
    early, late = _by_status(spark, folder)
    return joins.merge(early, late, how="full")


@query(
    "status:s location:s early:l late:l",
    _STATUS_YEAR_SQL + """
    SELECT a.status, a.location, early, late FROM a JOIN b
    ON a.status IS NOT DISTINCT FROM b.status AND a.location IS NOT DISTINCT FROM b.location
    """,
)
def natural_join(spark, folder):
    early, late = _by_status(spark, folder)
    return joins.merge(early, late)


@query(
    "status:s location:s",
    f"""
    WITH {sql.RES},
    a AS (SELECT nullif(status, 'P') AS status, nullif(location, '5-LOW') AS location FROM res WHERE period < 199901),
    b AS (SELECT nullif(status, 'P') AS status, nullif(location, '5-LOW') AS location FROM res
          WHERE period >= 199901 AND status <> 'O')
    SELECT status, location FROM a
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.status IS NOT DISTINCT FROM b.status
                      AND a.location IS NOT DISTINCT FROM b.location)
    """,
)
def natural_anti(spark, folder):
    rows = star.residency(spark, folder)
    holes = lambda df: df.select(
        F.nullif(F.col("status"), F.lit("P")).alias("status"),
        F.nullif(F.col("location"), F.lit("5-LOW")).alias("location"),
    )
    early = holes(rows.where(F.col("period") < 199901))
    late = holes(rows.where((F.col("period") >= 199901) & (F.col("status") != "O"))).distinct()
    return joins.anti(early, late)


@query(
    "entity:l",
    f"""
    WITH {sql.RES}
    SELECT c_custkey AS entity FROM customer
    WHERE c_custkey NOT IN (SELECT entity FROM res WHERE status = 'F' AND location = '1-URGENT')
    """,
)
def anti_report(spark, folder):
    customers = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"))
    done = star.residency(spark, folder).where((F.col("status") == "F") & (F.col("location") == "1-URGENT"))
    return res_ops.lost_entities(customers, done)


@query(
    "tie:l entity:l",
    f"""
    WITH {sql.RES}
    SELECT tie, entity FROM res WHERE entity IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    """,
)
def semi_ids(spark, folder):
    ids = read_table(spark, folder, "customer").where(F.col("c_acctbal") < 0)
    return joins.semi(star.residency(spark, folder), ids.select(F.col("c_custkey").alias("entity")), ["entity"])


@query(
    "unmatched_rows:l equal:l",
    f"""
    WITH {sql.RES},
    a AS (SELECT entity, location FROM res),
    b AS (SELECT entity, CASE WHEN location = '5-LOW' THEN '5-low' ELSE location END FROM res),
    d AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
          UNION ALL SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT sum(n) AS unmatched_rows, cast(sum(n) = 0 AS integer) AS equal FROM d
    """,
)
def equal_tables(spark, folder):
    rows = star.residency(spark, folder).select("entity", "location")
    place = F.when(F.col("location") == "5-LOW", "5-low").otherwise(F.col("location"))
    report = joins.equal_tables(rows, rows.withColumn("location", place))
    return report.withColumn("equal", F.col("equal").cast("int"))


# Periods -----------------------------------------------------------------------------


@query(
    "period:l ordinal:l prev_period:l prev_start:s prev2_period:l prev2_end:s",
    f"WITH {sql.MONTHS} SELECT * FROM months",
)
def period_order(spark, folder):
    return period_chain(star.months(spark, folder))


@query(
    "tie:l period:l before_period:l before_start:s before_end:s",
    f"""
    WITH {sql.RES}, {sql.MONTHS}
    SELECT r.tie, r.period, m.prev_period AS before_period, m.prev_start AS before_start, m.prev_end AS before_end
    FROM res r JOIN months m ON r.period = m.period AND m.prev_period IS NOT NULL
    """,
)
def previous_period_of_rows(spark, folder):
    chain = period_chain(star.months(spark, folder))
    return previous_period(star.residency(spark, folder), chain, "period", "before")


_LIVED_SQL = f"""
    WITH {sql.TRIPS}, {sql.MONTHS}, {sql.BIRTHS},
    spans AS (SELECT t.entity, cast(b.birth_date + INTERVAL 5 MONTH AS date) AS eligible, t.dest_start AS last_start
              FROM trips t JOIN births b USING (entity)),
    lived AS (SELECT s.entity, m.period FROM spans s JOIN months m
              ON m.period_end >= s.eligible AND s.last_start >= m.period_start)
"""


@query("entity:l periods:l first_period:l", _LIVED_SQL + """
    SELECT entity, count(*) AS periods, min(period) AS first_period FROM lived GROUP BY entity
""")
def range_join_exposure(spark, folder):
    trips = star.trips(spark, folder).withColumn("last_start", F.col("dest_start"))
    lived = residence_periods(trips, star.births(spark, folder), star.months(spark, folder), 5)
    return lived.groupBy("entity").agg(
        F.count(F.lit(1)).alias("periods"), F.min("period").alias("first_period")
    )


@query("entity:l periods:l first_period:l", _LIVED_SQL + """
    SELECT entity, count(*) AS periods, min(period) AS first_period FROM lived GROUP BY entity
""")
def range_join_bucketed(spark, folder):
    trips = star.trips(spark, folder).withColumn("last_start", F.col("dest_start"))
    spans = joins.lookup(
        trips.select("entity", "last_start"), star.births(spark, folder), {"entity": "entity"},
        {"birth_date": "birth"}, "inner",
    ).withColumn("eligible", F.add_months("birth", 5))
    lived = overlap_join(
        spans, star.months(spark, folder), ("eligible", "last_start"), ("period_start", "period_end"))
    return lived.groupBy("entity").agg(
        F.count(F.lit(1)).alias("periods"), F.min("period").alias("first_period")
    )


@query(
    "entity:l",
    _LIVED_SQL + "SELECT entity FROM trips WHERE entity NOT IN (SELECT entity FROM lived)",
)
def outside_every_period(spark, folder):
    trips = star.trips(spark, folder).withColumn("last_start", F.col("dest_start"))
    lived = residence_periods(trips, star.births(spark, folder), star.months(spark, folder), 5)
    return res_ops.lost_entities(trips, lived)


@query(
    "tie:l entity:l n:l",
    f"""
    WITH {sql.RES}
    SELECT tie, entity, row_number() OVER (PARTITION BY entity ORDER BY period_start, tie) AS n FROM res
    """,
)
def row_in_group(spark, folder):
    return ordered.numbered(star.residency(spark, folder), ["entity"], "period_start", "tie", "n")


@query(
    "tie:l entity:l n:l",
    f"""
    WITH {sql.RES}
    SELECT tie, entity, row_number() OVER (PARTITION BY entity ORDER BY period_start, tie) AS n FROM res
    """,
)
def row_in_hot_group(spark, folder):
    """The same numbering with every group treated as hot: rows are split into blocks."""
    history = star.residency(spark, folder)
    return ordered.numbered(history, ["entity"], "period_start", "tie", "n", parts=64)


_NULL_ORDER_SQL = f"""
    WITH {sql.RES}, known AS (
      SELECT tie, entity, nullif(location, '5-LOW') AS location, CASE WHEN status <> 'P' THEN period_start END AS since FROM res)
"""


def _unsure_history(spark, folder):
    """The history with some start dates and locations unknown."""
    return star.residency(spark, folder).select(
        "tie", "entity", F.nullif(F.col("location"), F.lit("5-LOW")).alias("location"),
        F.when(F.col("status") != "P", F.col("period_start")).alias("since"),
    )


_NULL_ROWS_SQL = _NULL_ORDER_SQL + """
    SELECT tie, entity, row_number() OVER o AS n,
           last_value(location IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
           first_value(location IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM known WINDOW o AS (PARTITION BY entity ORDER BY since NULLS LAST, tie)
"""


def _numbered_and_filled(spark, folder, parts=None):
    history = _unsure_history(spark, folder)
    placed = ordered.numbered(history, ["entity"], "since", "tie", "n", parts=parts)
    return ordered.nearest_known(
        placed, ["entity"], "since", "tie", "location", before="before", after="after", parts=parts)


@query("tie:l entity:l n:l before:s after:s", _NULL_ROWS_SQL)
def unknown_order_last(spark, folder):
    """Numbering and filling where some rows have no date: those come last."""
    return _numbered_and_filled(spark, folder)


@query("tie:l entity:l n:l before:s after:s", _NULL_ROWS_SQL)
def unknown_order_in_blocks(spark, folder):
    """The same with every entity split into blocks."""
    return _numbered_and_filled(spark, folder, 64)


@query(
    "tie:l entity:l date:s place:s seen_before:l",
    f"""
    WITH {sql.RES},
    seen AS (SELECT o_custkey AS entity, cast(l_shipdate AS date) AS date, o_orderpriority AS place,
                    row_number() OVER (PARTITION BY o_custkey ORDER BY cast(l_shipdate AS date), l_orderkey * 10 + l_linenumber) AS n
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT tie, res.entity, date, place, coalesce(n, 0) AS seen_before
    FROM res LEFT JOIN seen ON seen.entity = res.entity AND seen.date <= res.period_start
    QUALIFY row_number() OVER (PARTITION BY tie ORDER BY n DESC NULLS LAST) = 1
    """,
)
def last_sighting_as_of(spark, folder):
    """For each residency row where the entity was seen last before the period, and how often it had been seen."""
    seen = star.shipments(spark, folder).select(
        "entity", F.col("l_shipdate").cast("date").alias("date"), F.col("location").alias("place"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    return ordered.as_of(
        star.residency(spark, folder).select("tie", "entity", "period_start"), seen, ["entity"], ("period_start", "date"),
        tie="item", take={"date": "date", "place": "place"}, count="seen_before")


@query(
    "entity:l period:l rows_left:l rows_right:l columns:s",
    f"""
    WITH {sql.RES},
    a AS (SELECT entity, period, location, status FROM res),
    b AS (SELECT entity, period, CASE WHEN period % 7 = 0 AND location = '5-LOW' THEN '5-low' ELSE location END AS location,
                 CASE WHEN entity % 50 = 3 THEN nullif(status, 'O') ELSE status END AS status
          FROM res WHERE tie % 101 <> 0),
    ga AS (SELECT entity, period, count(*) AS n, list(location ORDER BY location) AS l, list(status ORDER BY status) AS s FROM a GROUP BY ALL),
    gb AS (SELECT entity, period, count(*) AS n, list(location ORDER BY location) AS l, list(status ORDER BY status) AS s FROM b GROUP BY ALL),
    both_sides AS (
      SELECT entity, period, coalesce(ga.n, 0) AS rows_left, coalesce(gb.n, 0) AS rows_right,
             concat_ws(',', CASE WHEN ga.l IS DISTINCT FROM gb.l THEN 'location' END, CASE WHEN ga.s IS DISTINCT FROM gb.s THEN 'status' END) AS names
      FROM ga FULL JOIN gb USING (entity, period))
    SELECT entity, period, rows_left, rows_right, CASE WHEN rows_left > 0 AND rows_right > 0 THEN names ELSE '' END AS columns
    FROM both_sides WHERE rows_left <> rows_right OR names <> ''
    """,
)
def differing_keys(spark, folder):
    """Where a changed copy of the history differs: in which months of which customers, and in which columns."""
    history = star.residency(spark, folder)
    low = (F.col("period") % 7 == 0) & (F.col("location") == "5-LOW")
    changed = history.where(F.col("tie") % 101 != 0).withColumns({
        "location": F.when(low, "5-low").otherwise(F.col("location")),
        "status": F.when(F.col("entity") % 50 == 3, F.nullif(F.col("status"), F.lit("O"))).otherwise(F.col("status")),
    })
    columns = ["entity", "period", "location", "status"]
    found = joins.differences(history.select(*columns), changed.select(*columns), ["entity", "period"])
    return found.withColumn("columns", F.array_join("columns", ","))
