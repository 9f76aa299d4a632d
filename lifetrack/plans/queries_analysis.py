"""Queries for distribution summaries, model tables and posterior summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import mean_strict, sum_strict
from ..operators import design, posterior, stats
from ..operators.joins import lookup
from ..session import settle
from ..sources import star
from ..sources.files import read_table
from . import sql_parts as sql
from .queries_covariates import _WIDE_SQL, wide_table
from .registry import query


def _events(spark, folder):
    return read_table(spark, folder, "events")


# Summaries -----------------------------------------------------------------------------------


_Z = "1.959963984540054e0"
#: Half-widths over standard errors: exact for two degrees of freedom, the expansion for many.
_T95 = f"""CASE WHEN n = 3 THEN 0.95 * sqrt(2 / (1 - 0.95 * 0.95)) WHEN n > 100 THEN
      {_Z} + {_Z} * ({_Z}*{_Z} + 1) / (4.0 * (n - 1)) + {_Z} * ((5 * {_Z}*{_Z} + 16) * {_Z}*{_Z} + 3) / (96.0 * (n - 1) * (n - 1))
      + {_Z} * (((3 * {_Z}*{_Z} + 19) * {_Z}*{_Z} + 17) * {_Z}*{_Z} - 15) / (384.0 * (n - 1) * (n - 1) * (n - 1)) END"""
#: The three first events are a group of their own; views below 5 and clicks below 1 are unknown.
_GROUPED = """(SELECT CASE WHEN event_id < (SELECT min(event_id) FROM events) + 3 THEN 'first' ELSE event_type END AS kind,
      CASE WHEN event_type = 'view' AND value < 5 AND event_id >= (SELECT min(event_id) FROM events) + 3 THEN NULL ELSE value END AS value
    FROM events)"""


def _grouped_events(spark, folder):
    events = _events(spark, folder)
    early = F.col("event_id") < events.agg(F.min("event_id")).scalar() + 3
    unknown = (F.col("event_type") == "view") & (F.col("value") < 5) & ~early
    return events.select(
        F.when(early, "first").otherwise(F.col("event_type")).alias("kind"),
        F.when(~unknown, F.col("value")).alias("value"),
    )


@query(
    "kind:s n:l mean:d sd:d se:d ci:d",
    f"""
    SELECT *, se * {_T95} AS ci FROM (
      SELECT kind, count(*) AS n, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean,
             CASE WHEN count(value) = count(*) THEN stddev_samp(value) END AS sd, sd / sqrt(n) AS se
      FROM {_GROUPED} GROUP BY kind)
    """,
)
def summary_se(spark, folder):
    return stats.summary_se(_grouped_events(spark, folder), "value", ["kind"])


@query(
    "kind:s n:l mean:d sd:d se:d ci:d",
    f"""
    SELECT *, se * {_T95} AS ci FROM (
      SELECT kind, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, sd / sqrt(n) AS se
      FROM {_GROUPED} GROUP BY kind)
    """,
)
def summary_se_known(spark, folder):
    """The same over the known values alone."""
    return stats.summary_se(_grouped_events(spark, folder), "value", ["kind"], skip_nulls=True)


@query(
    "entity:l total:d mean:d",
    """
    SELECT o_custkey AS entity, CASE WHEN count(v) = count(*) THEN sum(v) END AS total,
           CASE WHEN count(v) = count(*) THEN avg(v) END AS mean
    FROM (SELECT o_custkey, CASE WHEN o_totalprice < 400000 THEN floor(o_totalprice) END AS v FROM orders)
    GROUP BY o_custkey
    """,
)
def strict_sums(spark, folder):
    orders = read_table(spark, folder, "orders")
    v = F.when(F.col("o_totalprice") < 400000, F.floor("o_totalprice").cast("double"))
    return orders.select(F.col("o_custkey").alias("entity"), v.alias("v")).groupBy("entity").agg(
        sum_strict("v").alias("total"), mean_strict("v").alias("mean")
    )


@query(
    "bin:l low:d high:d n:l",
    """
    SELECT cast(floor(value / 50.0) AS bigint) AS bin, floor(value / 50.0) * 50.0 AS low,
           (floor(value / 50.0) + 1) * 50.0 AS high, count(*) AS n
    FROM events GROUP BY ALL
    """,
)
def histogram(spark, folder):
    return stats.histogram(_events(spark, folder), "value", 50)


@query(
    "bin:l low:d high:d n:l",
    """
    SELECT cast(ceil(l_quantity / 5.0) - 1 AS bigint) AS bin, (ceil(l_quantity / 5.0) - 1) * 5.0 AS low,
           ceil(l_quantity / 5.0) * 5.0 AS high, count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def histogram_right_closed(spark, folder):
    return stats.histogram(read_table(spark, folder, "lineitem"), "l_quantity", 5, closed="right")


@query(
    "bin:l low:d high:d n:l",
    """
    SELECT cast(b - 1 AS bigint) AS bin, 10.0 * b AS low, 10.0 * (b + 1) AS high, count(*) AS n
    FROM (SELECT CASE WHEN l_quantity = 10 THEN 1 ELSE ceil(l_quantity / 10.0) - 1 END AS b FROM lineitem
          WHERE l_quantity BETWEEN 10 AND 40) GROUP BY b
    """,
)
def histogram_at_breaks(spark, folder):
    return stats.histogram_breaks(read_table(spark, folder, "lineitem"), "l_quantity", range(10, 50, 10), outside="drop")


_SKEW = """
    (SELECT (avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5)) AS skewness, count(value) AS n
     FROM events, (SELECT avg(value) AS m FROM events))"""


@query("skewness:d n:l", f"SELECT skewness, n FROM {_SKEW}")
def skewness(spark, folder):
    return stats.skewness(_events(spark, folder), "value")


@query(
    "bin:l n:l skewness:d",
    f"""
    SELECT b.bin, b.n, s.skewness
    FROM (SELECT cast(floor(value / 25.0) AS bigint) AS bin, count(*) AS n FROM events GROUP BY ALL) b, {_SKEW} s
    """,
)
def shape_diagnostics(spark, folder):
    return stats.shape(_events(spark, folder), "value", 25)


MEASURES = ["l_quantity", "l_extendedprice", "l_tax"]
_CORR = """
    r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_tax) AS ac,
                 corr(l_extendedprice, l_tax) AS bc FROM items)"""
_ITEMS = "items AS (SELECT l_quantity, l_extendedprice, l_tax FROM lineitem WHERE l_discount <> 0.05)"


def _complete_items(spark, folder):
    """Line items whose tax is unknown where the discount is 5 %."""
    items = read_table(spark, folder, "lineitem")
    return items.withColumn("l_tax", F.when(F.col("l_discount") != 0.05, F.col("l_tax")))


@query(
    "a:s b:s r:d",
    f"""
    WITH {_ITEMS}, {_CORR}
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, ab AS r FROM r
    UNION ALL SELECT 'l_quantity', 'l_tax', ac FROM r
    UNION ALL SELECT 'l_extendedprice', 'l_tax', bc FROM r
    """,
)
def correlation(spark, folder):
    return stats.correlation(_complete_items(spark, folder), MEASURES)


@query(
    "variable:s vif:d",
    f"""
    WITH {_ITEMS}, {_CORR}
    SELECT 'l_quantity' AS variable, 1 / (1 - (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc)) AS vif FROM r
    UNION ALL SELECT 'l_extendedprice', 1 / (1 - (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac)) FROM r
    UNION ALL SELECT 'l_tax', 1 / (1 - (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab)) FROM r
    """,
)
def vif(spark, folder):
    return stats.vif(_complete_items(spark, folder), MEASURES)


# Transformations -----------------------------------------------------------------------------


@query(
    "event_id:l value:d value_scaled:d user_scaled:d",
    """
    SELECT event_id, value, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS value_scaled,
           (user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_samp(user_id) FROM events) AS user_scaled
    FROM events
    """,
)
def standardise(spark, folder):
    events = _events(spark, folder).withColumn("user", F.col("user_id").cast("double"))
    return stats.standardise(events, ["value", "user"])


_USERS = """
    SELECT user_id AS entity, max(value) AS top, count(*) AS busy FROM events GROUP BY user_id"""


def _users(spark, folder):
    return _events(spark, folder).groupBy(F.col("user_id").alias("entity")).agg(
        F.max("value").alias("top"), F.count(F.lit(1)).alias("busy")
    )


@query(
    "event_id:l entity:l top_scaled:d busy_scaled:d",
    f"""
    WITH u AS ({_USERS}),
    m AS (SELECT avg(top) AS mt, stddev_samp(top) AS st, avg(busy) AS mb, stddev_samp(busy) AS sb FROM u)
    SELECT event_id, entity, (top - mt) / st AS top_scaled, (busy - mb) / sb AS busy_scaled
    FROM events JOIN u ON user_id = entity, m
    """,
)
def standardise_entities(spark, folder):
    repeated = lookup(
        _events(spark, folder).select("event_id", F.col("user_id").alias("entity")),
        settle(_users(spark, folder)), {"entity": "entity"}, {"top": "top", "busy": "busy"}, how="inner",
    )
    return stats.standardise_entities(repeated, ["top", "busy"])


_ORQ_SQL = f"""
    WITH v AS (SELECT o_orderkey AS entity,
                      CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 100) END AS value FROM orders),
    ranked AS (SELECT entity, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r,
                      count(*) OVER () AS n FROM v WHERE value IS NOT NULL)
    SELECT v.entity, value, {sql.norm_quantile("((r - 0.5) / n)")} AS score FROM v LEFT JOIN ranked USING (entity)
"""


def _orq_values(spark, folder):
    orders = read_table(spark, folder, "orders")
    value = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 100).cast("double"))
    return orders.select(F.col("o_orderkey").alias("entity"), value.alias("value"))


@query("entity:l value:d score:d", _ORQ_SQL)
def orq(spark, folder):
    return stats.orq_normalise(_orq_values(spark, folder), "value", "score")


@query("entity:l value:d score:d", _ORQ_SQL)
def orq_in_blocks(spark, folder):
    """The same scores with the ranking split into blocks, as for very many distinct values."""
    return stats.orq_normalise(_orq_values(spark, folder), "value", "score", parts=64)


@query(
    "event_id:l power:d score:d others:l",
    """
    WITH x AS (SELECT event_id, value AS v, ln(value) AS lv FROM events WHERE value > 0),
    g1 AS (SELECT round(cast(i AS double) / 10, 1) AS p FROM range(-10, 21) t(i)),
    b1 AS (SELECT p FROM (SELECT p, -count(*) / 2.0 * ln(var_pop(CASE WHEN p = 0 THEN lv ELSE (power(v, p) - 1) / p END))
             + (p - 1) * sum(lv) AS fit FROM x, g1 GROUP BY p) ORDER BY fit DESC, p LIMIT 1),
    g2 AS (SELECT round(p + cast(i AS double) / 100, 3) AS p FROM b1, range(-10, 11) t(i) WHERE p + cast(i AS double) / 100 BETWEEN -1 AND 2),
    b2 AS (SELECT p FROM (SELECT p, -count(*) / 2.0 * ln(var_pop(CASE WHEN p = 0 THEN lv ELSE (power(v, p) - 1) / p END))
             + (p - 1) * sum(lv) AS fit FROM x, g2 GROUP BY p) ORDER BY fit DESC, p LIMIT 1),
    g3 AS (SELECT round(p + cast(i AS double) / 1000, 3) AS p FROM b2, range(-10, 11) t(i) WHERE p + cast(i AS double) / 1000 BETWEEN -1 AND 2),
    b3 AS (SELECT p FROM (SELECT p, -count(*) / 2.0 * ln(var_pop(CASE WHEN p = 0 THEN lv ELSE (power(v, p) - 1) / p END))
             + (p - 1) * sum(lv) AS fit FROM x, g3 GROUP BY p) ORDER BY fit DESC, p LIMIT 1),
    y AS (SELECT event_id, p, CASE WHEN p = 0 THEN lv ELSE (power(v, p) - 1) / p END AS t FROM x, b3)
    SELECT event_id, (SELECT p FROM b3) AS power, (t - (SELECT avg(t) FROM y)) / (SELECT stddev_samp(t) FROM y) AS score,
           (SELECT count(*) FROM events WHERE value <= 0) AS others
    FROM events LEFT JOIN y USING (event_id)
    """,
)
def boxcox(spark, folder):
    """Scores of the positive values; ``others`` counts the values that have none."""
    events = _events(spark, folder)
    out = stats.boxcox_normalise(events, "value", "score", not_positive="null")
    return out.withColumnRenamed("score_power", "power").withColumn("others", events.agg(F.count_if(F.col("value") <= 0)).scalar())


# Model tables --------------------------------------------------------------------------------


_FRAME_TYPES = {
    "entity": "int", "moved": "string", "event_season": "string", "event_date": "date", "birth_date_1": "date", "birth_date_2": "date",
    "age": "int", "age_2": "int", "reached_min_age": "string", "distance": "double", "origin_size": "double", "dest_size": "double",
    "food_abundance": "double", "food_density": "double", "population_all": "int", "group_all": "int", "exposures": "int",
    "exposed": "string", "near_event": "string", "sex": "int", "origin_dominance": "string", "dest_dominance": "string",
    "last_period": "string", "dest_period": "string",
}


@query(
    "entity:l sex:s age:l age_2:l exposed:s near_event:s event_season:s distance:d origin_size:d food_abundance:d food_density:d "
    "population_all:l group_all:l exposures:l",
    _WIDE_SQL + """
    SELECT * REPLACE (CASE WHEN sex = 1 THEN 'M' ELSE 'F' END AS sex) FROM wide WHERE moved = '1'
    """,
)
def model_frame(spark, folder):
    return design.movers_only(design.typed_model_frame(wide_table(spark, folder), _FRAME_TYPES))


@query(
    "entity:l age:l food_density:d",
    _WIDE_SQL + " SELECT entity, age, food_density FROM wide WHERE food_density IS NOT NULL AND age IS NOT NULL",
)
def complete_rows(spark, folder):
    return design.complete_for(wide_table(spark, folder), ["food_density", "age"])


@query(
    "entity:l assay_number:l response:d event_id:l score:d",
    """
    WITH resp AS (
      SELECT entity, response, row_number() OVER (PARTITION BY entity ORDER BY response) AS n FROM (
        SELECT DISTINCT user_id AS entity, floor(value / 20) AS response FROM events WHERE event_type = 'purchase')),
    assay AS (
      SELECT user_id AS entity, event_id, value AS score,
             row_number() OVER (PARTITION BY user_id ORDER BY cast(ts AS date), event_id) AS n
      FROM events WHERE event_type = 'signup')
    SELECT coalesce(r.entity, a.entity) AS entity, coalesce(r.n, a.n) AS assay_number, response, event_id, score
    FROM resp r FULL JOIN assay a ON r.entity = a.entity AND r.n = a.n
    """,
)
def align_repeats(spark, folder):
    events = _events(spark, folder).withColumnRenamed("user_id", "entity")
    responses = events.where(F.col("event_type") == "purchase").select(
        "entity", F.floor(F.col("value") / 20).cast("double").alias("response")
    )
    assays = events.where(F.col("event_type") == "signup").select(
        "entity", "event_id", F.col("value").alias("score"), F.col("ts").cast("date").alias("day")
    )
    return design.align_repeats(responses, assays, "day", "event_id", "response", "response")


@query(
    "event_id:l entity:l top_scaled:d",
    f"""
    WITH u AS ({_USERS}), m AS (SELECT avg(top) AS mt, stddev_samp(top) AS st FROM u)
    SELECT event_id, user_id AS entity, (top - mt) / st AS top_scaled
    FROM events LEFT JOIN (SELECT CASE WHEN entity % 5 > 0 THEN entity END AS entity, top, mt, st FROM u, m) ON user_id = entity
    """,
)
def attach_transformed(spark, folder):
    scaled = stats.standardise(_users(spark, folder), ["top"])
    scaled = scaled.withColumn("entity", F.when(F.col("entity") % 5 > 0, F.col("entity")))
    rows = _events(spark, folder).select("event_id", F.col("user_id").alias("entity"))
    return design.attach_transformed(rows, scaled.select("entity", "top_scaled"))


@query(
    "entity:l trait:s y:d trait_score:d trait_move:d score_sex_M:d move_sex_M:d score_day:d "
    "score_kind_signup:d score_kind_view:d move_busy:d",
    f"""
    WITH u AS ({_USERS}),
    base AS (SELECT event_id AS entity, value AS score, CASE WHEN value > 10 THEN top END AS move,
                    CASE WHEN user_id % 2 = 1 THEN 'M' ELSE 'F' END AS sex, day(ts) AS day, event_type AS kind, busy
             FROM events JOIN u ON u.entity = user_id),
    long AS (SELECT *, 'score' AS trait, score AS y FROM base UNION ALL SELECT *, 'move', move FROM base)
    SELECT entity, trait, y, trait = 'score' AS trait_score, trait = 'move' AS trait_move,
           trait = 'score' AND sex = 'M' AS "score_sex_M", trait = 'move' AND sex = 'M' AS "move_sex_M",
           CASE trait WHEN 'score' THEN day ELSE 0 END AS score_day,
           trait = 'score' AND kind = 'signup' AS score_kind_signup, trait = 'score' AND kind = 'view' AS score_kind_view,
           CASE trait WHEN 'move' THEN busy ELSE 0 END AS move_busy
    FROM long WHERE y IS NOT NULL
    """,
)
def design_table(spark, folder):
    base = lookup(
        _events(spark, folder), settle(_users(spark, folder)), {"user_id": "entity"},
        {"top": "top", "busy": "busy"}, how="inner",
    ).select(
        F.col("event_id").alias("entity"), F.col("value").alias("score"),
        F.when(F.col("value") > 10, F.col("top")).alias("move"),
        F.when(F.col("user_id") % 2 == 1, "M").otherwise("F").alias("sex"),
        F.dayofmonth("ts").alias("day"), F.col("event_type").alias("kind"), "busy",
    )
    return design.bivariate_design(
        base,
        {"score": "score", "move": "move"},
        shared={"sex": ["F", "M"]},
        numeric={"score": ["day"], "move": ["busy"]},
        categorical={"score": {"kind": ["click", "signup", "view"]}},
    )


# Posterior draws -----------------------------------------------------------------------------

_DRAWS = """
    WITH draws AS (SELECT 'm' || (user_id % 2) AS model, user_id % 3 + 1 AS chain, user_id * 100 + day(ts) AS iteration,
                          event_type AS parameter, max(value + 1000 * (user_id % 2)) AS value
                   FROM events GROUP BY ALL)"""


@query(
    "model:s chain:l iteration:l value:d",
    _DRAWS + """
    SELECT model, chain, iteration, max(value) FILTER (parameter = 'click')
           / (max(value) FILTER (parameter = 'click') + max(value) FILTER (parameter = 'view')) AS value
    FROM draws WHERE parameter IN ('click', 'view') GROUP BY model, chain, iteration
    """,
)
def posterior_ratio(spark, folder):
    return posterior.posterior_ratio(star.draws(spark, folder), "click", "view")


_CORR_DRAWS = _DRAWS + """, c AS (
    SELECT model, chain, iteration, max(value) FILTER (parameter = 'error')
           / (sqrt(max(value) FILTER (parameter = 'click')) * sqrt(max(value) FILTER (parameter = 'view'))) AS value
    FROM draws WHERE parameter IN ('click', 'view', 'error') GROUP BY model, chain, iteration)"""


@query("model:s chain:l iteration:l value:d", _CORR_DRAWS + " SELECT * FROM c")
def posterior_corr(spark, folder):
    return posterior.posterior_correlation(star.draws(spark, folder), "error", "click", "view")


@query("model:s mean:d", _CORR_DRAWS + " SELECT model, avg(value) AS mean FROM c GROUP BY model")
def posterior_mean(spark, folder):
    return posterior.posterior_mean(
        posterior.posterior_correlation(star.draws(spark, folder), "error", "click", "view")
    )


_HPD_SQL = _DRAWS + """,
    sorted AS (SELECT model, parameter, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY model, parameter) AS n
               FROM draws WINDOW w AS (PARTITION BY model, parameter ORDER BY value)),
    spans AS (SELECT *, greatest(1, least(n - 1, cast(round_even(n * 0.95, 0) AS bigint))) AS span FROM sorted),
    pairs AS (SELECT a.model, a.parameter, a.n, a.r, a.value AS lower, b.value AS upper, b.value - a.value AS width
              FROM spans a JOIN spans b ON b.model = a.model AND b.parameter = a.parameter AND b.r = a.r + a.span)
    SELECT model, parameter, n, lower, upper, width FROM pairs
    QUALIFY row_number() OVER (PARTITION BY model, parameter ORDER BY width, r) = 1
"""


@query("model:s parameter:s n:l lower:d upper:d width:d", _HPD_SQL)
def hpd(spark, folder):
    return posterior.hpd_interval(star.draws(spark, folder))


@query("model:s parameter:s n:l lower:d upper:d width:d", _HPD_SQL)
def hpd_in_blocks(spark, folder):
    """The same intervals with every parameter's draws split into blocks."""
    return posterior.hpd_interval(star.draws(spark, folder), parts=64)
