"""Registry of named queries and the SQL each is checked against.

A query states its result columns once, as ``name:type`` with type ``l``
(whole number), ``d`` (number, rounded to 6 places) or ``s`` (text, dates
included). The same casts are applied to the Spark result and to the SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK = {
    "l": lambda c: F.col(c).cast("bigint"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "s": lambda c: F.col(c).cast("string"),
}
_SQL = {
    "l": 'cast("{0}" as bigint) as "{0}"',
    "d": 'round(cast("{0}" as double), 6) + 0.0 as "{0}"',
    "s": 'cast("{0}" as varchar) as "{0}"',
}


def query(columns: str, sql: str | None = None):
    """Register a function under its name, with result columns and check SQL."""
    spec = [part.split(":") for part in columns.split()]

    def register(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(prepare(spark), folder)
            return result.select(*[_SPARK[kind](name).alias(name) for name, kind in spec])

        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            picks = ", ".join(_SQL[kind].format(n) for n, kind in spec)
            ORACLES[name] = f"SELECT {picks} FROM (\n{body}\n) AS result"
        return run

    return register
