"""Conditionals and null rules that differ from plain SQL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ifelse(cond: Column, yes, no) -> Column:
    """Two-way choice where an unknown condition gives null, not ``no``."""
    return F.when(cond, as_lit(yes)).when(~cond, as_lit(no))


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Replace listed codes; others become ``default``; null stays null."""
    c = as_col(c)
    chain = F.when(c.isNull(), F.lit(None))
    for code, value in mapping.items():
        chain = chain.when(c == F.lit(code), as_lit(value))
    return chain.otherwise(as_lit(default))


def two_codes(c: Column | str, listed: Iterable, inside, outside) -> Column:
    """``inside`` for listed codes, ``outside`` for others, null for null."""
    return ifelse(as_col(c).isin(list(listed)), inside, outside)


def contains_any(c: Column | str, parts: Iterable[str]) -> Column:
    """True where the text holds any of the parts; a null text holds none."""
    tests = [F.coalesce(as_col(c).contains(p), F.lit(False)) for p in parts]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def sum_strict(c: Column | str) -> Column:
    """Sum that is null as soon as one value of the group is null."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def mean_strict(c: Column | str) -> Column:
    """Mean that is null as soon as one value of the group is null."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Turn empty text into null in every string column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def null_cells(df: DataFrame) -> DataFrame:
    """One row: the number of null cells over all columns."""
    per_row = reduce(
        lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns]
    )
    return df.agg(F.sum(per_row).alias("null_cells"))
