import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifetrack.operators import design, posterior, stats


def test_summary_with_t_limits(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0)], "k string, v double")
    got = {r.k: r for r in stats.summary_se(df, "v", ["k"]).collect()}
    assert got["a"].n == 3 and abs(got["a"].se - np.std([1, 2, 4], ddof=1) / math.sqrt(3)) < 1e-12
    assert abs(got["a"].ci - 4.302652729911275 * got["a"].se) < 1e-6
    assert got["b"].sd is None and got["b"].ci is None


T_VALUES = {  # published tables: 95 % and 99 % two-sided
    1: (12.7062, 63.6567), 2: (4.30265, 9.92484), 3: (3.18245, 5.84091), 4: (2.77645, 4.60409), 5: (2.57058, 4.03214),
    6: (2.44691, 3.70743), 7: (2.36462, 3.49948), 8: (2.30600, 3.35539), 9: (2.26216, 3.24984), 10: (2.22814, 3.16927),
    30: (2.04227, 2.75000), 1000: (1.96234, 2.58075),
}


@pytest.mark.parametrize("p, place", [(0.975, 0), (0.995, 1)])
def test_t_quantile(spark, p, place):
    df = spark.createDataFrame([(v,) for v in T_VALUES], "v long")
    got = {r.v: r.t for r in df.select("v", stats.t_quantile(p, F.col("v")).alias("t")).collect()}
    for v, want in T_VALUES.items():
        assert got[v] == pytest.approx(want[place], rel=3e-6), v
    assert stats.t_value(p, 200) == pytest.approx(
        spark.range(1).select(stats.t_quantile(p, F.lit(200))).first()[0], rel=1e-9)


def test_summary_is_strict_about_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None)], "k string, v double")
    strict, known = stats.summary_se(df, "v", ["k"]).first(), stats.summary_se(df, "v", ["k"], skip_nulls=True).first()
    assert (strict.n, strict["mean"], strict.sd, strict.ci) == (3, None, None, None)
    assert (known.n, known["mean"]) == (2, 2.0) and abs(known.se - 1.0) < 1e-12 and abs(known.ci - 12.7062047) < 1e-5


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (49.9,), (50.0,), (100.0,), (None,)], "v double")
    left = {r.low: r.n for r in stats.histogram(df, "v", 50).collect()}
    assert left == {0.0: 2, 50.0: 1, 100.0: 1}
    right = {r.low: r.n for r in stats.histogram(df, "v", 50, closed="right").collect()}
    assert right == {-50.0: 1, 0.0: 2, 50.0: 1}
    with pytest.raises(Exception, match="outside the breaks"):
        stats.histogram_breaks(df, "v", [0, 50]).collect()
    breaks = {r.low: r.n for r in stats.histogram_breaks(df, "v", [0, 50, 100]).collect()}
    assert breaks == {0.0: 3, 50.0: 1}
    left_breaks = {r.low: r.n for r in stats.histogram_breaks(df, "v", [0, 50, 100], closed="left").collect()}
    assert left_breaks == {0.0: 2, 50.0: 2}


def test_vif_matches_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    data = np.column_stack([x[:, 0], x[:, 0] + 0.5 * x[:, 1], x[:, 2], x[:, 1] - x[:, 2] + rng.normal(size=400)])
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(data.tolist() + [[None, 1.0, 1.0, 1.0]], ", ".join(f"{c} double" for c in columns))
    got = {r.variable: r.vif for r in stats.vif(df, columns).collect()}
    for i, c in enumerate(columns):
        others = np.column_stack([np.ones(400), np.delete(data, i, axis=1)])
        fit = others @ np.linalg.lstsq(others, data[:, i], rcond=None)[0]
        r2 = 1 - ((data[:, i] - fit) ** 2).sum() / ((data[:, i] - data[:, i].mean()) ** 2).sum()
        assert abs(got[c] - 1 / (1 - r2)) < 1e-8
    assert stats.correlation(df, columns).count() == 6


@pytest.mark.parametrize("limits", [{}, {"parts": 8}])
def test_normal_scores_average_ties(spark, limits):
    data = [5.0, 1.0, 5.0, None, 9.0, 5.0, 2.0, math.nan]
    df = spark.createDataFrame(list(enumerate(data)), "entity int, v double")
    got = {r.entity: r.z for r in stats.orq_normalise(df, "v", "z", **limits).collect()}
    ranks = {1: 1, 6: 2, 0: 4, 2: 4, 5: 4, 4: 6}
    assert got[3] is None and got[7] is None
    for e, rank in ranks.items():
        assert abs(got[e] - NormalDist().inv_cdf((rank - 0.5) / 6)) < 1e-7


@pytest.mark.parametrize("power_of_normal, edge", [(1 / 3, False), (-3.0, True)])
def test_box_cox_finds_the_likelihood_maximum(spark, power_of_normal, edge):
    rng = np.random.default_rng(5)
    x = rng.normal(10.0, 1.0, 500) ** (1 / power_of_normal)
    df = spark.createDataFrame([(float(v),) for v in x] + [(-1.0,), (None,)], "v double")
    with pytest.raises(ValueError, match="not positive"):
        stats.box_cox_power(df, "v")
    power = stats.box_cox_power(df, "v", not_positive="null")

    def fit(p):
        y = np.log(x) if p == 0 else (x**p - 1) / p
        return -len(x) / 2 * math.log(y.var()) + (p - 1) * np.log(x).sum()

    grid = np.round(np.arange(-1, 2.0005, 0.001), 3)
    assert power == pytest.approx(max(grid, key=fit), abs=1e-9)
    assert (power == -1.0) == edge
    made = stats.boxcox_normalise(df, "v", "z", not_positive="null")
    out = made.agg(F.avg("z"), F.stddev_samp("z"), F.count("z"), F.max("z_at_edge")).first()
    assert abs(out[0]) < 1e-9 and abs(out[1] - 1) < 1e-9 and out[2] == 500 and out[3] == edge
    if edge:
        assert stats.box_cox_power(df, "v", (-5.0, 2.0), not_positive="null") < -1


def test_scaling_ignores_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 3.0), (3, None)], "entity int, v double")
    got = sorted((r.entity, r.v_scaled) for r in stats.standardise_entities(df, ["v"]).collect() if r.v is not None)
    assert [e for e, _ in got] == [1, 1, 2] and abs(got[2][1] - 1 / math.sqrt(2)) < 1e-12
    assert stats.standardise_entities(df, ["v"]).count() == 4


def brute_hpd(values, prob=0.95):
    v = sorted(values)
    n = len(v)
    span = max(1, min(n - 1, round(n * prob)))
    i = min(range(n - span), key=lambda k: (v[k + span] - v[k], k))
    return n, v[i], v[i + span]


@pytest.mark.parametrize("limits", [{}, {"parts": 8}, {"parts": 40}])
def test_shortest_interval(spark, limits):
    rng = random.Random(2)
    draws = {
        "smooth": [rng.gauss(0, 1) for _ in range(400)],
        "tied": [float(rng.randrange(6)) for _ in range(90)],  # 0.95 * 90 rounds half to even
        "spike": [0.0] * 150 + [rng.random() for _ in range(50)],
        "short": [3.0, 1.0],
        "ten": [float(i) for i in range(10)],
    }
    rows = [(p, float(x)) for p, xs in draws.items() for x in xs] + [("smooth", None)]
    rng.shuffle(rows)
    rows = [("m", *r) for r in rows] + [("other", "ten", float(i + 1000)) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, parameter string, value double")
    got = {(r.model, r.parameter): (r.n, r.lower, r.upper) for r in posterior.hpd_interval(df, **limits).collect()}
    want = {("m", p): brute_hpd(xs) for p, xs in draws.items()}
    assert got == {**want, ("other", "ten"): brute_hpd([i + 1000.0 for i in range(10)])}


def test_draw_ratios_and_correlations(spark):
    draws = spark.createDataFrame(
        [("m", 1, i, p, v) for i in (1, 2) for p, v in (("id", 1.0 * i), ("units", 3.0), ("cov", 0.5), ("v2", 4.0))]
        + [("m", 2, 1, "id", 1.0), ("m", 2, 1, "units", 1.0)],
        "model string, chain int, iteration int, parameter string, value double",
    )
    ratio = {(r.chain, r.iteration): r.value for r in posterior.posterior_ratio(draws, "id", "units").collect()}
    assert ratio == {(1, 1): 0.25, (1, 2): 0.4, (2, 1): 0.5}
    draws = draws.where("chain = 1")
    r = {x.iteration: x.value for x in posterior.posterior_correlation(draws, "cov", "id", "v2").collect()}
    assert r[1] == 0.25 and abs(r[2] - 0.5 / (math.sqrt(2) * 2)) < 1e-12
    assert posterior.posterior_mean(posterior.posterior_ratio(draws, "id", "units")).first().mean == 0.325


def _draws_over_zero(spark):
    """Variances of zero: an infinite, a negative infinite and an undefined correlation, and one that stays unknown."""
    draws = [("a", 1, 2.0, 0.0, 4.0), ("a", 2, 1.0, 1.0, 4.0), ("b", 1, -2.0, 0.0, 4.0), ("c", 1, 0.0, 4.0, 0.0),
             ("d", 1, None, 0.0, 4.0), ("d", 2, 1.0, 4.0, 4.0)]
    return spark.createDataFrame(
        [(m, 1, i, p, v) for m, i, *vs in draws for p, v in zip(("cov", "v1", "v2"), vs)],
        "model string, chain int, iteration int, parameter string, value double",
    )


def test_correlation_over_a_variance_of_zero(spark):
    """Was an error of division by zero."""
    rows = posterior.posterior_correlation(_draws_over_zero(spark), "cov", "v1", "v2").collect()
    got = {(r.model, r.iteration): r.value for r in rows}
    assert math.isnan(got.pop(("c", 1)))
    assert got == {("a", 1): math.inf, ("a", 2): 0.5, ("b", 1): -math.inf, ("d", 1): None, ("d", 2): 0.25}


def test_mean_with_a_variance_of_zero(spark):
    """Was an error of division by zero."""
    derived = posterior.posterior_correlation(_draws_over_zero(spark), "cov", "v1", "v2")
    got = {r.model: r.mean for r in posterior.posterior_mean(derived).collect()}
    assert math.isnan(got.pop("c")) and got == {"a": math.inf, "b": -math.inf, "d": 0.25}


def test_align_repeats(spark):
    responses = spark.createDataFrame([(1, 7.0), (1, 7.0), (2, 3.0)], "entity int, response double")
    assays = spark.createDataFrame([(1, 2, 0.2), (1, 1, 0.1), (3, 1, 0.3)], "entity int, test int, score double")
    got = sorted(tuple(r) for r in design.align_repeats(responses, assays, "test", "test", "response", "response").select(
        "entity", "assay_number", "response", "score").collect())
    assert got == [(1, 1, 7.0, 0.1), (1, 2, None, 0.2), (2, 1, 3.0, None), (3, 1, None, 0.3)]


def test_design_table(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5, "M", 10.0), (2, 3.0, None, "F", 20.0)], "entity int, score double, move double, sex string, age double")
    table = design.bivariate_design(
        df, {"score": "score", "move": "move"}, shared={"sex": ["F", "M"]}, numeric={"score": ["age"]}
    )
    rows = {(r.entity, r.trait): r for r in table.collect()}
    assert set(rows) == {(1, "score"), (1, "move"), (2, "score")}
    a = rows[(1, "move")]
    assert (a.y, a.trait_move, a.trait_score, a.move_sex_M, a.score_sex_M, a.score_age) == (0.5, 1.0, 0.0, 1.0, 0.0, 0.0)
    assert rows[(2, "score")].score_age == 20.0


def test_model_frame(spark):
    df = spark.createDataFrame([(1, "1", "12", 1), (2, "0", "x", 0), (3, "1", None, None)], "entity int, moved string, mass string, sex int")
    typed = design.typed_model_frame(df, {"mass": "double"})
    assert [(r.mass, r.sex) for r in typed.orderBy("entity").collect()] == [(12.0, "M"), (None, "F"), (None, None)]
    assert [r.entity for r in design.movers_only(typed).orderBy("entity").collect()] == [1, 3]
    assert design.complete_for(typed, ["mass"]).count() == 1
