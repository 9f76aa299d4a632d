"""Common table expressions shared by the check SQL."""

from __future__ import annotations

from ..functions.normal import CENTRE_BOTTOM, CENTRE_TOP, TAIL, TAIL_BOTTOM, TAIL_TOP


def residency(name: str, location: str = "o_orderpriority") -> str:
    return f"""{name} AS (
  SELECT o_custkey AS entity, {location} AS location, o_orderstatus AS status,
         year(o_orderdate) * 100 + month(o_orderdate) AS period,
         cast(date_trunc('month', o_orderdate) AS date) AS period_start,
         last_day(o_orderdate) AS period_end, o_orderkey AS tie
  FROM orders)"""


TWO_WAY = "CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'OTHER' END"
RES = residency("res")
HOME = residency("res", TWO_WAY)

FIRSTS = """firsts AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_start, tie) AS place,
         count(*) OVER (PARTITION BY entity) AS places
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, location ORDER BY period_start, tie) AS rn FROM res)
  WHERE rn = 1)"""

MOVES = """moves AS (
  SELECT o.entity, o.location AS origin, o.period AS origin_period, o.period_start AS origin_start,
         o.period_end AS origin_end, o.status AS first_status,
         d.location AS dest_location, d.status AS dest_status, d.period AS dest_period,
         d.period_start AS dest_start, d.period_end AS dest_end
  FROM firsts o JOIN firsts d ON o.entity = d.entity AND o.place = 1 AND d.place = 2)"""

MONTHS = """months AS (
  SELECT period, period_start, period_end,
         lag(period, 1) OVER o AS prev_period, lag(period_start, 1) OVER o AS prev_start,
         lag(period_end, 1) OVER o AS prev_end, lag(period, 2) OVER o AS prev2_period,
         lag(period_start, 2) OVER o AS prev2_start, lag(period_end, 2) OVER o AS prev2_end,
         row_number() OVER o AS ordinal
  FROM (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS period,
               cast(date_trunc('month', o_orderdate) AS date) AS period_start,
               last_day(o_orderdate) AS period_end FROM orders)
  WINDOW o AS (ORDER BY period_start))"""

BIRTHS = """births AS (
  SELECT o_custkey AS entity, cast(min(o_orderdate) AS date) AS birth_date,
         year(min(o_orderdate)) * 100 + month(min(o_orderdate)) AS birth_period
  FROM orders GROUP BY o_custkey)"""


def ships(location: str = "o_orderpriority") -> str:
    return f"""ships AS (
  SELECT o_custkey AS entity, year(l_shipdate) * 100 + month(l_shipdate) AS period,
         cast(l_shipdate AS date) AS date, {location} AS location
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


TRIPS = f"""{RES}, {FIRSTS}, {MOVES}, trips AS (
  SELECT entity, origin, origin_period AS last_period, origin_start AS last_start, origin_end AS last_end,
         first_status AS origin_status, dest_location, dest_status, dest_period, dest_start, dest_end,
         origin_end + cast(floor((dest_start - origin_end) / 2.0) AS integer) AS event_date
  FROM moves)"""

TWO_DAY = """res AS (
  SELECT user_id AS entity, event_type AS location, 'SEEN' AS status,
         cast(floor((cast(ts AS date) - DATE '1970-01-01') / 2.0) AS integer) AS period,
         DATE '1970-01-01' + 2 * cast(floor((cast(ts AS date) - DATE '1970-01-01') / 2.0) AS integer) AS period_start,
         DATE '1970-01-01' + 2 * cast(floor((cast(ts AS date) - DATE '1970-01-01') / 2.0) AS integer) + 1 AS period_end,
         event_id AS tie
  FROM events),
ships AS (
  SELECT user_id AS entity, cast(floor((cast(ts AS date) - DATE '1970-01-01') / 2.0) AS integer) AS period,
         cast(ts AS date) AS date, event_type AS location
  FROM events)"""

# Method P: seen at the origin during the destination period.
PRECISE = """at_origin AS (
  SELECT m.entity, max(s.date) AS last_at_origin FROM moves m
  JOIN ships s ON s.entity = m.entity AND s.period = m.dest_period AND s.location = m.origin
  GROUP BY m.entity),
at_dest AS (
  SELECT m.entity, min(s.date) AS first_at_dest FROM moves m
  JOIN ships s ON s.entity = m.entity AND s.period = m.dest_period AND s.location = m.dest_location
  GROUP BY m.entity),
p_events AS (
  SELECT m.entity, m.origin, m.dest_location, m.dest_status, m.dest_period, m.dest_start, m.dest_end,
         m.dest_period AS last_period, m.dest_start AS last_start, m.dest_end AS last_end,
         cast(NULL AS varchar) AS origin_status,
         last_at_origin + cast(floor((first_at_dest - last_at_origin) / 2.0) AS integer) AS event_date,
         'P' AS method
  FROM moves m JOIN at_origin USING (entity) LEFT JOIN at_dest USING (entity)
  WHERE m.dest_status <> 'P')"""

# Method E: last origin period before the destination period.
BETWEEN = """e_events AS (
  SELECT m.entity, m.origin, m.dest_location, m.dest_status, m.dest_period, m.dest_start, m.dest_end,
         r.period AS last_period, r.period_start AS last_start, r.period_end AS last_end,
         r.status AS origin_status,
         r.period_end + cast(floor((m.dest_start - r.period_end) / 2.0) AS integer) AS event_date,
         'E' AS method
  FROM moves m JOIN res r ON r.entity = m.entity
  WHERE m.entity NOT IN (SELECT entity FROM p_events) AND m.dest_status <> 'P'
    AND NOT (r.location = m.dest_location AND r.period = m.dest_period)
    AND NOT (r.period_start > m.dest_end) AND r.location = m.origin
  QUALIFY row_number() OVER (PARTITION BY m.entity ORDER BY r.period_end DESC, r.tie) = 1)"""

# Method EF: last floating period to the next settled one.
FLOATS = """f_last AS (
  SELECT m.entity, m.origin, r.period AS last_period, r.period_start AS last_start,
         r.period_end AS last_end, r.status AS origin_status
  FROM moves m JOIN res r ON r.entity = m.entity AND r.location = m.origin
  WHERE m.dest_status = 'P' AND NOT (m.dest_end < r.period_end)
  QUALIFY row_number() OVER (PARTITION BY m.entity ORDER BY r.period_end DESC, r.tie) = 1),
f_end AS (
  SELECT l.entity, max(r.period_end) AS float_end FROM f_last l
  JOIN res r ON r.entity = l.entity AND r.status = 'P' GROUP BY l.entity),
f_settled AS (
  SELECT r.*, f.float_end FROM f_end f JOIN res r ON r.entity = f.entity AND r.period_end > f.float_end
  QUALIFY row_number() OVER (PARTITION BY r.entity ORDER BY r.period_end, r.tie) = 1),
f_events AS (
  SELECT l.entity, l.origin, s.location AS dest_location, s.status AS dest_status, s.period AS dest_period,
         s.period_start AS dest_start, s.period_end AS dest_end, l.last_period, l.last_start, l.last_end,
         l.origin_status,
         s.float_end + cast(floor((s.period_start - s.float_end) / 2.0) AS integer) AS event_date,
         'EF' AS method
  FROM f_last l JOIN f_settled s USING (entity))"""

EVENTS = """dated AS (
  SELECT *, strftime(event_date, '%b') AS event_month,
         CASE WHEN event_date IS NULL THEN NULL
              WHEN month(event_date) IN (1, 2, 3, 4, 10, 11, 12) THEN 'W' ELSE 'S' END AS event_season
  FROM (SELECT * FROM p_events UNION ALL SELECT * FROM e_events UNION ALL SELECT * FROM f_events))"""

STATUS_FILL = """graded AS (
  SELECT *, CASE status WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS grade FROM res),
at_home AS (
  SELECT entity, location, status FROM graded
  QUALIFY row_number() OVER (PARTITION BY entity, location ORDER BY period_end DESC, grade DESC, tie) = 1),
filled AS (
  SELECT d.* REPLACE (coalesce(d.origin_status, h.status) AS origin_status),
         m.prev_period AS second_last_period, m.prev_start AS second_last_start, m.prev_end AS second_last_end
  FROM dated d
  JOIN months m ON m.period = d.last_period AND m.prev_period IS NOT NULL
  JOIN at_home h ON h.entity = d.entity AND h.location = d.origin)"""

DOMINANCE = """ranked_moves AS (
  SELECT * FROM (
    SELECT *, CASE WHEN origin_status = 'F' THEN 1 WHEN origin_status IS NOT NULL THEN 2 END AS origin_dominance,
           CASE WHEN dest_status = 'O' THEN 2 WHEN dest_status IS NOT NULL THEN 1 END AS dest_dominance
    FROM filled)
  WHERE origin_dominance = 2)"""

NON_MOVERS = """stayers AS (SELECT entity FROM firsts WHERE places = 1 AND status <> 'F'),
first_dominant AS (
  SELECT r.entity, r.location AS origin, r.period FROM res r JOIN stayers USING (entity)
  WHERE r.status = 'F'
  QUALIFY row_number() OVER (PARTITION BY r.entity ORDER BY r.period_start, r.tie) = 1),
promoted AS (
  SELECT d.entity, d.origin, m.prev_period AS last_period, m.prev_start AS last_start, m.prev_end AS last_end,
         m.prev2_period AS second_last_period, m.prev2_start AS second_last_start, m.prev2_end AS second_last_end
  FROM first_dominant d JOIN months m ON m.period = d.period AND m.prev2_period IS NOT NULL),
heirs AS (
  SELECT p.*, 1 AS inherit FROM promoted p JOIN births b USING (entity) WHERE p.last_end > b.birth_date),
subs AS (
  SELECT l.entity, l.location AS origin, l.period AS last_period, l.period_start AS last_start,
         l.period_end AS last_end, m.prev_period AS second_last_period, m.prev_start AS second_last_start,
         m.prev_end AS second_last_end, 0 AS inherit
  FROM (SELECT r.* FROM res r JOIN stayers USING (entity)
        WHERE r.entity NOT IN (SELECT entity FROM promoted)
        QUALIFY row_number() OVER (PARTITION BY r.entity ORDER BY r.period_start DESC, r.tie) = 1) l
  JOIN months m ON m.period = l.period AND m.prev_period IS NOT NULL)"""

MOVEMENT = f"""{HOME}, {FIRSTS}, {MOVES}, {MONTHS}, {BIRTHS}, {ships(TWO_WAY)},
{PRECISE}, {BETWEEN}, {FLOATS}, {EVENTS}, {STATUS_FILL}, {DOMINANCE}, {NON_MOVERS},
movement AS (
  SELECT entity, origin, last_period, last_start, last_end, second_last_period, second_last_start,
         second_last_end, cast(NULL AS integer) AS inherit, '1' AS moved, 'UNK' AS tested_before, method,
         event_date, event_month, event_season, dest_status, dest_dominance, dest_start, dest_end,
         dest_location, dest_period, origin_status, origin_dominance
  FROM ranked_moves
  UNION ALL
  SELECT entity, origin, last_period, last_start, last_end, second_last_period, second_last_start,
         second_last_end, inherit, '0', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL
  FROM (SELECT * FROM heirs UNION ALL SELECT * FROM subs))"""


def _poly(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"(({text}) * ({x}) + ({c!r}))"
    return text


def norm_quantile(p: str) -> str:
    """The normal quantile of an expression, for 0 < p < 1."""
    p = f"cast({p} AS double)"
    square = f"power({p} - 0.5, 2)"
    depth = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * {_poly(square, CENTRE_TOP)} / {_poly(square, CENTRE_BOTTOM)}"
    tail = f"{_poly(depth, TAIL_TOP)} / {_poly(depth, TAIL_BOTTOM)}"
    return (
        f"CASE WHEN least({p}, 1 - {p}) >= {TAIL} THEN {centre} "
        f"WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END"
    )
