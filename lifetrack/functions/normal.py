"""Standard normal quantile as a native column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .columns import as_col

# Coefficients of P. J. Acklam's rational approximation
# (relative error below 1.15e-9), highest power first.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
               3.754408661907416e00, 1.0)
TAIL = 0.02425


def _poly(x: Column, coefficients) -> Column:
    first, *rest = [F.lit(c) for c in coefficients]
    return reduce(lambda acc, c: acc * x + c, rest, first)


def norm_quantile(p: Column | str) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1, else null."""
    p = as_col(p)
    centred = p - F.lit(0.5)
    square = centred * centred
    centre = centred * _poly(square, CENTRE_TOP) / _poly(square, CENTRE_BOTTOM)
    nearest = F.least(p, F.lit(1.0) - p)
    depth = F.sqrt(F.lit(-2.0) * F.log(nearest))
    tail = _poly(depth, TAIL_TOP) / _poly(depth, TAIL_BOTTOM)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(nearest >= F.lit(TAIL), centre)
        .when(p < F.lit(0.5), tail)
        .otherwise(-tail)
    )
