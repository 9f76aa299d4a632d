"""Distribution summaries and transformations over whole columns."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normal import norm_quantile
from ..session import settle
from .joins import merge
from .ordered import Scan

#: Search range of the Box-Cox power, unless given.
POWER_RANGE = (-1.0, 2.0)
#: Degrees of freedom up to which t quantiles are solved for; the series beyond is exact to eight digits.
EXACT_FREEDOM = 100


def summary_se(
    df: DataFrame, value: str, keys: Iterable[str], confidence: float = 0.95, *, skip_nulls: bool = False
) -> DataFrame:
    """Count, mean, sd, standard error and t confidence half-width per group.

    A group with a null has a null mean, sd, error and half-width, and its count
    includes the null. With ``skip_nulls`` nulls are left out of all of them.
    """
    keys = list(keys)
    known = F.count(value)
    whole = F.lit(True) if skip_nulls else known == F.count(F.lit(1))
    base = df.groupBy(*keys).agg(
        (known if skip_nulls else F.count(F.lit(1))).alias("n"),
        F.when(whole, F.avg(value)).alias("mean"), F.when(whole, F.stddev_samp(value)).alias("sd"),
    )
    se = base.withColumn("se", F.col("sd") / F.sqrt("n"))
    return se.withColumn("ci", F.col("se") * t_quantile(0.5 + confidence / 2, F.col("n") - 1))


def t_probability(t: float, freedom: int) -> float:
    """Student's t distribution function for whole degrees of freedom, by its finite sum."""
    angle = math.atan(t / math.sqrt(freedom))
    sine, cosine2 = math.sin(angle), math.cos(angle) ** 2
    if freedom % 2:
        term, total = math.cos(angle), 0.0
        for k in range(3, freedom + 1, 2):
            total += term
            term *= cosine2 * (k - 1) / k
        area = 2 / math.pi * (angle + sine * total)
    else:
        term, total = 1.0, 0.0
        for k in range(2, freedom + 1, 2):
            total += term
            term *= cosine2 * (k - 1) / k
        area = sine * total
    return 0.5 + area / 2


def t_value(p: float, freedom: int) -> float:
    """Student's t quantile, by halving the interval that holds it."""
    if p < 0.5:
        return -t_value(1 - p, freedom)
    low, high = 0.0, 1.0
    while t_probability(high, freedom) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_probability(mid, freedom) < p else (low, mid)
    return high


def t_quantile(p: float, freedom: Column) -> Column:
    """Student's t quantile: solved for small degrees of freedom, by the Cornish-Fisher series for others."""
    z, v = NormalDist().inv_cdf(p), freedom.cast("double")
    z2 = z * z
    series = (
        F.lit(z)
        + z * (z2 + 1) / (v * 4)
        + z * ((z2 * 5 + 16) * z2 + 3) / (v * v * 96)
        + z * (((z2 * 3 + 19) * z2 + 17) * z2 - 15) / (v * v * v * 384)
        + z * ((((z2 * 79 + 776) * z2 + 1482) * z2 - 1920) * z2 - 945) / (v * v * v * v * 92160)
    )
    solved = F.array(*[F.lit(t_value(p, k)) for k in range(1, EXACT_FREEDOM + 1)])
    small = F.get(solved, freedom.cast("int") - 1)
    return F.when(freedom.between(1, EXACT_FREEDOM), small).when(freedom > EXACT_FREEDOM, series)


def overview(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sd, smallest and largest value."""
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )


def histogram(
    df: DataFrame, column: str, width: float, *, boundary: float = 0.0, closed: str = "left"
) -> DataFrame:
    """Rows per bin of fixed width; bins are closed on the given side."""
    place = (F.col(column) - F.lit(float(boundary))) / F.lit(float(width))
    number = F.floor(place) if closed == "left" else F.ceil(place) - 1
    bins = df.where(F.col(column).isNotNull()).groupBy(number.cast("long").alias("bin"))
    edge = lambda k: (F.col("bin") + k) * F.lit(float(width)) + F.lit(float(boundary))
    return bins.agg(F.count(F.lit(1)).alias("n")).select(
        "bin", edge(0).alias("low"), edge(1).alias("high"), "n"
    )


def histogram_breaks(
    df: DataFrame, column: str, breaks: Iterable[float], *, closed: str = "right", outside: str = "error"
) -> DataFrame:
    """Rows per interval between given breaks, the outer ends included.

    Values outside are an error when the result is computed, or left out if ``outside`` is "drop".
    """
    edges = sorted(float(b) for b in breaks)
    value = F.col(column)
    number = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        low, high = edges[i], edges[i + 1]
        if closed == "right":
            inside = ((value > low) | ((value == low) if i == 0 else F.lit(False))) & (value <= high)
        else:
            inside = (value >= low) & ((value < high) | ((value == high) if i == last else F.lit(False)))
        number = F.when(inside, F.lit(i)).otherwise(number)
    if outside != "drop":
        beyond = value.isNotNull() & ((value < edges[0]) | (value > edges[-1]))
        number = F.when(beyond, F.raise_error(F.lit(f"{column} has values outside the breaks"))).otherwise(number)
    counted = df.withColumn("bin", number).where(F.col("bin").isNotNull()).groupBy("bin")
    low = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    high = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 2)
    return counted.agg(F.count(F.lit(1)).alias("n")).select("bin", low.alias("low"), high.alias("high"), "n")


def skewness(df: DataFrame, column: str) -> DataFrame:
    """One row: population skewness, nulls ignored."""
    return df.agg(F.skewness(column).alias("skewness"), F.count(column).alias("n"))


def correlation(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pairwise correlations over rows complete in all columns, in one pass: (a, b, r)."""
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    row = df.dropna(how="any", subset=columns).agg(
        F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs
        ]).alias("_pairs")
    )
    return row.select(F.inline("_pairs"))


#: Pivots below this are taken as zero: the column is a sum of multiples of those before it.
NO_PIVOT = 1e-12


def _inverse_diagonal(matrix: Column, k: int) -> Column:
    """The diagonal of the inverse of a symmetric k x k matrix (array of arrays) by sweeping one column after another."""

    def sweep(m: Column, p: Column) -> Column:
        pivot_row = m[p]
        pivot = F.when(F.abs(pivot_row[p]) > NO_PIVOT, pivot_row[p])
        return F.transform(m, lambda row, i: F.transform(row, lambda v, j: (
            F.when((i == p) & (j == p), 1 / pivot).when(i == p, v / pivot).when(j == p, -v / pivot)
            .otherwise(v - row[p] * pivot_row[j] / pivot))))

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix, sweep)
    return F.transform(swept, lambda row, i: row[i])


def vif(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix.

    One distributed pass gives the k x k correlations as a single row, which is
    swept in column expressions. Where one column is made up of others the matrix
    has no inverse and all factors are infinite.
    """
    columns = list(columns)
    matrix = F.array(*[F.array(*[F.lit(1.0) if a == b else F.corr(a, b) for b in columns]) for a in columns])
    row = df.dropna(how="any", subset=columns).agg(matrix.alias("_m"))
    factors = F.arrays_zip(F.array(*map(F.lit, columns)).alias("variable"), _inverse_diagonal(F.col("_m"), len(columns)).alias("vif"))
    return row.select(F.inline(factors)).select("variable", F.coalesce("vif", F.lit(math.inf)).alias("vif"))


def standardise(
    df: DataFrame, columns: Iterable[str], suffix: str = "_scaled", over: DataFrame | None = None
) -> DataFrame:
    """Add z-scores: centred on the mean, divided by the sample sd, nulls ignored.

    Mean and sd come from ``over``, by default the rows themselves.
    """
    columns = list(columns)
    moments = (df if over is None else over).agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns
    ])).scalar()
    z = lambda c: (F.col(c) - moments[c]["mean"]) / moments[c]["sd"]
    return df.withColumns({c + suffix: z(c) for c in columns})


def standardise_entities(df: DataFrame, columns: Iterable[str], suffix: str = "_scaled") -> DataFrame:
    """Z-scores of repeated rows, with mean and sd over the distinct rows per entity."""
    columns = list(columns)
    return standardise(df, columns, suffix, over=df.select("entity", *columns).distinct())


def orq_normalise(df: DataFrame, value: str, name: str, *, parts: int | None = None) -> DataFrame:
    """Rank-based normal score: quantile of (average rank - 0.5) / n over the known values.

    Null and NaN are unknown: they have no rank and no score.

    Equal values are counted together first, so ties never meet in one task. The
    distinct values are sorted once, by ranges; a rank is the running count inside
    a range and the counts of the ranges before it.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    scan = Scan(counts, [], "_v", "_n", parts=parts)
    brought = scan.brought({"_sum": F.sum("_n")}, lambda earlier, later: {
        "_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), "_total": F.sum("_sum").over(Window.partitionBy())})
    ranked = scan.add(scan.rows.withColumn("_upto", F.sum("_n").over(scan.upto())), brought)
    average = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    placed = ranked.select("_v", ((average - 0.5) / F.col("_total")).alias("_p"))
    scores = placed.select(F.col("_v").alias(value), norm_quantile("_p").alias(name))
    return merge(df, scores, [value], "left", null_safe=False)


def box_cox(x: Column, log_x: Column, power: Column) -> Column:
    """(x^power - 1) / power, and log x at power 0."""
    return F.when(power == 0, log_x).otherwise((F.pow(x, power) - 1) / power)


def _best_power(known: DataFrame, centre: float, powers: list[float]) -> float:
    """The candidate with the largest profile likelihood; equal ones go to the smaller power.

    One aggregate over the rows holds two averages for each candidate, so no row
    is copied and one row per task is exchanged. Spreads are taken around the
    transformed ``centre``, which keeps plain sums accurate.
    """
    moved_centre = lambda p: math.log(centre) if p == 0 else (centre**p - 1) / p
    averages = []
    for p in powers:
        off = box_cox(F.col("_x"), F.col("_log"), F.lit(p)) - F.lit(moved_centre(p))
        averages.append(F.array(F.avg(off), F.avg(off * off)))
    row = known.agg(F.count("_x").alias("n"), F.sum("_log").alias("logs"), F.array(*averages).alias("fits")).first()

    def likelihood(p, fit):
        spread = fit[1] - fit[0] * fit[0]
        return -row["n"] / 2 * (math.log(spread) if spread > 0 else -math.inf) + (p - 1) * row["logs"]

    return max(zip(powers, row["fits"]), key=lambda f: (likelihood(*f), -f[0]))[0]


def box_cox_power(
    df: DataFrame, value: str, power_range: tuple[float, float] = POWER_RANGE, *, not_positive: str = "error"
) -> float:
    """Maximum-likelihood power to three decimals: a coarse grid, then two finer ones around the best.

    Runs four small jobs; each returns one row of numbers. Values of zero or less
    have no transform: an error, unless ``not_positive`` is "null".
    """
    known = df.select(F.col(value).alias("_x"), F.log(F.when(F.col(value) > 0, F.col(value))).alias("_log"))
    positive = F.col("_x") > 0
    centre, others = known.agg(F.avg(F.when(positive, F.col("_x"))), F.count_if(~positive)).first()
    if centre is None:
        raise ValueError(f"no positive value in {value}")
    if others and not_positive != "null":
        raise ValueError(f"{others} values of {value} are not positive")
    known = known.where(positive)
    low, high = power_range
    tenths = [round(low + i / 10, 1) for i in range(round((high - low) * 10) + 1)]
    power = _best_power(known, centre, tenths)
    for step in (100, 1000):
        around = [round(power + k / step, 3) for k in range(-10, 11)]
        power = _best_power(known, centre, [p for p in around if low <= p <= high])
    return power


def boxcox_normalise(
    df: DataFrame, value: str, name: str, power_range: tuple[float, float] = POWER_RANGE, *, not_positive: str = "error"
) -> DataFrame:
    """Box-Cox transform at the best power, then z-scores.

    ``{name}_power`` is the power, ``{name}_at_edge`` whether it is an end of ``power_range``, so that a better one
    may lie outside. Values of zero or less are an error, or give null if ``not_positive`` is "null".
    """
    power = box_cox_power(df, value, power_range, not_positive=not_positive)
    positive = F.when(F.col(value) > 0, F.col(value))
    moved = df.withColumns({
        name + "_power": F.lit(power), name + "_at_edge": F.lit(power in power_range),
        "_raw": box_cox(positive, F.log(positive), F.lit(power)),
    })
    return standardise(moved, ["_raw"], "_z").withColumnRenamed("_raw_z", name).drop("_raw")


def shape(df: DataFrame, column: str, width: float) -> DataFrame:
    """Histogram rows with the skewness of the column beside them."""
    skew = df.agg(F.skewness(column)).scalar()
    return histogram(df, column, width).withColumn("skewness", skew)
