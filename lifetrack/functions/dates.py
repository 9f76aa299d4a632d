"""Date parsing, differences, midpoints and seasons."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .columns import as_col, ifelse

# Months counted as winter under the two season rules.
WIDE_WINTER = (1, 2, 3, 4, 10, 11, 12)
NARROW_WINTER = (1, 2, 11, 12)


def parse_dmy(c: Column | str) -> Column:
    """``dd/MM/yyyy`` text to date; anything else is null."""
    return F.try_to_date(as_col(c), "dd/MM/yyyy")


def parse_iso(c: Column | str) -> Column:
    return F.try_to_date(as_col(c), "yyyy-MM-dd")


def days_between(earlier: Column | str, later: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(as_col(later), as_col(earlier))


def days_between_local(earlier, later, zone: str = "Europe/London") -> Column:
    """Days from UTC midnight of ``earlier`` to local midnight of ``later``.

    Fractional while the zone is off UTC on the later date.
    """
    until = F.to_utc_timestamp(as_col(later).cast("timestamp"), zone)
    since = as_col(earlier).cast("timestamp")
    return (F.unix_timestamp(until) - F.unix_timestamp(since)) / F.lit(86400.0)


def midpoint_date(first: Column | str, second: Column | str) -> Column:
    """Midpoint of two dates, rounded toward the past."""
    half = F.floor(days_between(first, second) / F.lit(2.0)).cast("int")
    return F.date_add(as_col(first), half)


def midpoint_days(first: Column | str, second: Column | str) -> Column:
    """Exact midpoint as (possibly half) days since 1970-01-01."""
    return F.unix_date(as_col(first)) + days_between(first, second) / F.lit(2.0)


def month_abbr(c: Column | str) -> Column:
    return F.date_format(as_col(c), "MMM")


def season(c: Column | str, winter: Iterable[int] = WIDE_WINTER) -> Column:
    """``W`` in the winter months, else ``S``; null for a null date."""
    return ifelse(F.month(as_col(c)).isin(list(winter)), "W", "S")


def season_from_index(c: Column | str, threshold: float = 0.5) -> Column:
    """``Summer`` from the threshold on, else ``Winter``."""
    return ifelse(as_col(c) >= F.lit(threshold), "Summer", "Winter")
