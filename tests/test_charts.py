"""Known answers, invariants and argument checks of the charts."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import quantiles
from plumbline.functions.constants import C4, C5, D2, D3, constant
from plumbline.operators import (
    attributes,
    multivariate,
    rare_events,
    short_run,
    time_weighted,
    variables,
)
from plumbline.operators.capability import capability
from plumbline.operators.chart import zones
from plumbline.operators.series import Roles
from plumbline.plans.recipe import KINDS, Recipe, analyze, draw

ONE = Roles("x", "t")
GROUPED = Roles("x", "t", subgroup="g")

INDIVIDUAL = [10.0, 10.2, 10.1, 10.3, 10.0, 10.2, 10.4, 10.1, 10.3, 10.2,
              10.5, 10.3, 10.4, 10.2, 10.6, 10.3, 10.5, 10.4, 10.7, 10.5]


def rows(spark, values, groups=None, phases=None):
    data = [
        (t, float(v) if v is not None else None, groups[t] if groups else None,
         phases[t] if phases else None)
        for t, v in enumerate(values)
    ]
    return spark.createDataFrame(data, "t int, x double, g string, p string")


def points(chart):
    return chart.points.orderBy("idx").toPandas()


def grouped(spark, groups):
    flat = [v for g in groups for v in g]
    names = [f"g{i}" for i, g in enumerate(groups) for _ in g]
    return rows(spark, flat, names)


def test_individuals_sigma_is_one(spark):
    chart = variables.imr(rows(spark, [0, 1.128, 0, 1.128, 0]), ONE)
    assert chart.params.first()["sigma_hat"] == pytest.approx(1)
    p = points(chart)
    assert p["ucl"][0] - p["cl"][0] == pytest.approx(3)
    assert chart.secondary_points.count() == 4


def test_median_moving_range_sigma_is_one(spark):
    chart = variables.imr(rows(spark, [0, 0.954, 0, 0.954, 0]), ONE, sigma_method="median_moving_range")
    assert chart.params.first()["sigma_hat"] == pytest.approx(1)


def test_one_subgroup(spark):
    df = grouped(spark, [[5, 7, 6, 8, 9]])
    chart = variables.xbar_r(df, GROUPED)
    assert points(chart)["value"][0] == 7
    assert chart.secondary_points.first()["value"] == 4
    assert chart.params.first()["sigma_hat"] == pytest.approx(4 / 2.326)


def test_subgroups_of_one_do_not_break_sigma(spark):
    chart = variables.xbar_s(grouped(spark, [[5, 7, 6], [8], [4, 6, 8]]), GROUPED)
    p = points(chart)
    assert p["n"].tolist() == [3, 1, 3]
    want = np.mean([np.std([5, 7, 6], ddof=1), np.std([4, 6, 8], ddof=1)]) / 0.8862
    assert chart.params.first()["sigma_hat"] == pytest.approx(want)


def test_proportions(spark):
    df = grouped(spark, [[1] * 10 + [0] * 90] * 5)
    p = points(attributes.attribute("p", df, GROUPED))
    assert p["cl"].tolist() == pytest.approx([0.1] * 5)
    unequal = grouped(spark, [[1] * 5 + [0] * 45, [1] * 10 + [0] * 90, [1] * 20 + [0] * 180])
    assert points(attributes.attribute("p", unequal, GROUPED))["ucl"].nunique() == 3
    laney = attributes.attribute(
        "laney_p", grouped(spark, [[1] * 5 + [0] * 45, [1] * 10 + [0] * 90, [1] * 15 + [0] * 135]),
        GROUPED)
    assert laney.params.first()["rate"] == pytest.approx(0.1)


def test_counts_with_fixed_trials(spark):
    df = grouped(spark, [[1, 0, 0, 1, 0], [0, 0, 0, 0, 1], [1, 1, 0, 0, 0], [0, 0, 1, 0, 0]])
    p = points(attributes.attribute("np", df, GROUPED, n_trials=100))
    assert p["value"].tolist() == [2, 1, 2, 1]
    assert p["cl"].tolist() == pytest.approx([1.5] * 4)


def chi2_cdf(x, v):
    grid = np.linspace(0, math.sqrt(x), 200_001)
    # substitution t = u^2 removes the pole at 0
    f = 2 * grid ** (v - 1) * np.exp(-grid**2 / 2) / (2 ** (v / 2) * math.gamma(v / 2))
    return np.trapezoid(f, grid)


@pytest.mark.parametrize("v", [1.0, 1.37, 2.0, 3.0, 7.5])
@pytest.mark.parametrize("p", [0.00135, 0.5, 0.99865])
def test_chi_square_quantile(v, p):
    x = quantiles.chi2_quantile(p, v)
    assert chi2_cdf(x, v) == pytest.approx(p, abs=1e-6)
    if v == 2:
        assert x == pytest.approx(-2 * math.log1p(-p), rel=1e-12)


@pytest.mark.parametrize("p", [0.1, 0.5, 0.9973])
def test_f_quantile(p):
    # F(2, n): closed form
    for n in (5.0, 40.0):
        want = n / 2 * ((1 - p) ** (-2 / n) - 1)
        assert quantiles.f_quantile(p, 2.0, n) == pytest.approx(want, rel=1e-9)
    for n in (1e3, 1e9, 1e12):
        want = n / 2 * math.expm1(-2 / n * math.log1p(-p))
        assert quantiles.f_quantile(p, 2.0, n) == pytest.approx(want, rel=1e-12)
    assert quantiles.f_quantile(p, 3.0, 1e7) == pytest.approx(quantiles.chi2_quantile(p, 3) / 3, rel=1e-4)


def test_quantiles_of_a_batch_are_those_of_each_row():
    df = np.array([0.3, 1.0, 2.0, 64.0, 5e4])
    got = quantiles.chi2_quantiles(0.99, df)
    assert got.tolist() == pytest.approx([quantiles.chi2_quantile(0.99, v) for v in df], rel=1e-12)
    d2 = np.array([2.0, 9.0, 1e6])
    got = quantiles.f_quantiles(0.01, np.full(3, 7.0), d2)
    assert got.tolist() == pytest.approx([1 / quantiles.f_quantile(0.99, v, 7.0) for v in d2], rel=1e-10)
    assert quantiles.chi2_quantiles(0.5, np.array([])).tolist() == []


def test_weibull_converges_for_every_key_and_says_so(spark):
    rng = np.random.default_rng(5)
    values = {"wide": 10 ** rng.uniform(-6, 6, 300), "narrow": 50 + rng.normal(0, 1e-3, 200), "two": np.array([1.0, 7.0]),
              "same": np.full(9, 4.0), "one": np.array([3.0]), "ties": rng.integers(1, 4, 500).astype(float)}
    df = spark.createDataFrame([(s, t, float(v)) for s, x in values.items() for t, v in enumerate(x)], "s string, t int, v double")
    for mode in ({}, {"block_rows": 40}):
        got = {r.s: r for r in rare_events.t(df, Roles("v", "t", "s"), **mode).params.collect()}
        assert set(got) == set(values)
        for s, x in values.items():
            if s in ("same", "one"):
                assert got[s]["shape"] is None and not got[s]["converged"]
                continue
            k, y = got[s]["shape"], x / x.max()
            assert got[s]["converged"] and got[s]["scale"] == pytest.approx(x.max() * (y**k).mean() ** (1 / k), rel=1e-9)
            assert 1 / k + np.log(y).mean() - (y**k * np.log(y)).sum() / (y**k).sum() == pytest.approx(0, abs=1e-9 / k)


def test_long_vectors_against_numpy(spark):
    rng = np.random.default_rng(9)
    vectors = {s: rng.normal(size=(n, 12)) @ rng.normal(size=(12, 12)) + 5 for s, n in (("a", 70), ("b", 40), ("few", 9))}
    df = spark.createDataFrame([(s, t, [float(v) for v in x]) for s, xs in vectors.items() for t, x in enumerate(xs)], "s string, t int, x array<double>")
    df = df.unionByName(spark.createDataFrame([("a", 500, None), ("a", 501, [1.0])], df.schema))
    for mode in ({}, {"block_rows": 16}):
        t2 = multivariate.hotelling_t2(df, Roles("x", "t", "s"), "x", size=12, **mode)
        smooth = multivariate.mewma(df, Roles("x", "t", "s"), "x", size=12, lam=0.3, **mode)
        got, waves = ({s: [r for r in sorted(c.points.collect(), key=lambda r: (r.s, r.idx)) if r.s == s] for s in vectors} for c in (t2, smooth))
        for s, x in vectors.items():
            if s == "few":
                assert all(r.value is None for r in got[s])
                continue
            d, inverse = x - x.mean(0), np.linalg.inv(np.cov(x.T))
            np.testing.assert_allclose([r.value for r in got[s]], np.einsum("ij,jk,ik->i", d, inverse, d), rtol=1e-8)
            np.testing.assert_allclose([r.contributions for r in got[s]], d * (d @ inverse), rtol=1e-6, atol=1e-8)
            level, want = np.zeros(12), []
            for k, row in enumerate(d):
                level = 0.3 * row + 0.7 * level
                want.append(level @ inverse @ level / (0.3 / 1.7 * (1 - 0.7 ** (2 * (k + 1)))))
            np.testing.assert_allclose([r.value for r in waves[s]], want, rtol=1e-8)


def test_g_chart_against_numpy(spark):
    v = np.array([1, 10, 2, 15, 3, 12, 4, 20.0])
    chart = rare_events.g(rows(spark, v), ONE)
    k = v.var(ddof=1) / v.mean() - 1
    p = points(chart).iloc[0]
    for line, share in (("ucl", 0.9986501019683699), ("lcl", 1 - 0.9986501019683699)):
        want = (quantiles.chi2_quantile(share, 2 / (1 + k)) * (1 + k) - 1) / 2
        assert p[line] == pytest.approx(max(want, 0))
    assert k > 0 and p["cl"] == pytest.approx(v.mean())


def test_t_chart(spark):
    positive = [3.0, 8.0, 1.5, 12.0, 7.0, 2.0]
    mixed = [0.0, *positive, 0.0]
    fits = []
    for values in (positive, mixed):
        chart = rare_events.t(rows(spark, values), ONE)
        fits.append(chart.params.select("shape", "scale").first())
        assert chart.points.count() == len(values)
    assert fits[0]["shape"] == pytest.approx(fits[1]["shape"])
    k, beta = fits[0]
    x = np.array(positive)
    # likelihood equations hold
    assert 1 / k + np.log(x).mean() == pytest.approx((x**k * np.log(x)).sum() / (x**k).sum())
    assert beta == pytest.approx((x**k).mean() ** (1 / k))
    big = rare_events.t(rows(spark, mixed), ONE, blocked=True, block_rows=3).params.first()
    assert (big["shape"], big["scale"]) == pytest.approx((k, beta))
    none = rare_events.t(rows(spark, [0.0, 4.0, 0.0]), ONE).params.first()
    assert none["shape"] is None


def test_three_way_without_between_variation(spark):
    df = grouped(spark, [[9, 10, 11], [9.5, 10, 10.5]] * 4)
    chart = variables.three_way(df, GROUPED)
    assert chart.params.first()["sigma_between"] == 0
    assert chart.params.first()["harmonic_n"] == pytest.approx(3)


def test_short_run(spark):
    df = rows(spark, [10, 11, 10.5, 20, 21, 20.5], list("AAABBB"))
    chart = short_run.short_run(df, GROUPED)
    assert points(chart)["value"].tolist() == [-0.5, 0.5, 0, -0.5, 0.5, 0]
    known = spark.createDataFrame([("A", 10.0, 2.0)], "product string, target double, sigma double")
    p = points(short_run.short_run(df, GROUPED, scaling="standardized", known=known))
    assert p["value"].tolist()[:3] == [0, 0.5, 0.25]


def test_vmask(spark):
    chart = time_weighted.cusum_vmask(rows(spark, [1, 3, 2, 5, 4]), ONE, target=2, sigma=1)
    assert points(chart)["value"].tolist() == [-1, 0, 0, 3, 5]
    assert chart.params.first()["lead_distance"] == 5


def test_cusum_lower_limit_is_negative(spark):
    p = points(time_weighted.cusum(rows(spark, INDIVIDUAL), ONE))
    assert (p["lcl"] == -5).all() and (p["ucl"] == 5).all()


def test_ewma_of_means(spark):
    groups = [[9.9, 10, 10.1], [10.4, 10.5, 10.6], [10.9, 11, 11.1], [10.1, 10.2, 10.3]]
    p = points(time_weighted.ewma(grouped(spark, groups), GROUPED, lam=1.0))
    assert p["value"].tolist() == pytest.approx([10.0, 10.5, 11.0, 10.2])


def test_hotelling_and_mewma_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(40, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.5], [0, 0, 1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, a double, b double, c double")
    roles = Roles("a", "t")
    d, s_inv = x - x.mean(axis=0), np.linalg.inv(np.cov(x, rowvar=False))
    want = np.einsum("ij,jk,ik->i", d, s_inv, d)
    p = points(multivariate.hotelling_t2(df, roles, ["a", "b", "c"]))
    np.testing.assert_allclose(p["value"], want)
    np.testing.assert_allclose([sum(c) for c in p["contributions"]], want)
    n, k = x.shape
    limit = k * (n - 1) * (n + 1) / (n * (n - k)) * quantiles.f_quantile(0.9973, k, n - k)
    assert p["ucl"][0] == pytest.approx(limit)
    z, zs = np.zeros(3), []
    for r in d:
        z = 0.3 * r + 0.7 * z
        zs.append(z)
    for exact in (True, False):
        scale = [0.3 / 1.7 * (1 - 0.7 ** (2 * (i + 1)) if exact else 1) for i in range(n)]
        want = [v @ s_inv @ v / s for v, s in zip(zs, scale)]
        p = points(multivariate.mewma(df, roles, ["a", "b", "c"], lam=0.3, exact_covariance=exact))
        np.testing.assert_allclose(p["value"], want)
    few = points(multivariate.hotelling_t2(df.limit(3), roles, ["a", "b", "c"]))
    assert few["value"].isna().all()
    given = multivariate.hotelling_t2(df, roles, ["a", "b", "c"], stage=2, known_mean=[0, 0, 0],
                                      known_cov=np.eye(3).tolist())
    np.testing.assert_allclose(points(given)["value"], (x**2).sum(axis=1))


def test_many_variables_use_the_same_formula(spark):
    x = np.random.default_rng(2).normal(size=(60, 12))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t int, v array<double>")
    p = points(multivariate.hotelling_t2(df, Roles("v", "t"), "v", size=12))
    d = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x, rowvar=False)), d)
    np.testing.assert_allclose(p["value"], want)


def test_presummarized(spark):
    df = grouped(spark, [[1, 2, 9], [4, 4, 4]])
    args = {"target": 4.0, "sigma": 1.0}
    assert points(variables.presummarize(df, GROUPED, **args))["value"].tolist() == [4, 4]
    median = variables.presummarize(df, GROUPED, summary_stat="median", **args)
    assert points(median)["value"].tolist() == [2, 4]
    single = points(variables.presummarize(df, GROUPED, summary_stat="individual", **args))
    assert len(single) == 6 and single["ucl"].tolist() == [7] * 6


def test_run_chart_p_value(spark):
    p = variables.run_chart(rows(spark, [1, 1, 1, 9, 9, 9, 1, 1, 9, 9]), ONE).params.first()
    assert (p["n_above"], p["n_below"], p["n_runs"]) == (5, 5, 4)
    z = (4 - 6) / math.sqrt(50 * 40 / (100 * 9))
    assert p["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    flat = variables.run_chart(rows(spark, [2, 2, 2]), ONE).params.first()
    assert (flat["n_runs"], flat["expected_runs"], flat["p_value"]) == (0, 0, 1)


def test_capability_known_answer(spark):
    df = rows(spark, [47.5, 48, 49, 50, 51, 52, 52.5])
    chart = variables.presummarize(df, ONE, target=50, sigma=2, summary_stat="individual")
    got = capability(df, ONE, chart, usl=58, lsl=42).first()
    assert (got["cp"], got["cpk"]) == (1.3333, 1.3333)
    assert capability(df, ONE, chart, usl=1, lsl=2).first()["cp"] is None


def test_phases_have_their_own_limits(spark):
    a = [10.0, 10.1, 10.2, 9.9, 10.0, 10.1, 9.8, 10.3, 10.0, 10.1]
    b = [15.0, 15.2, 14.8, 15.1, 15.3, 14.9, 15.0, 15.2, 14.7, 15.1]
    df = rows(spark, a + b, phases=["B"] * 10 + ["A"] * 10)
    done = analyze(df, Recipe("imr", Roles("x", "t", phase="p"), usl=20.0, lsl=5.0))
    centers = {r["phase"]: r["center"] for r in done.params.collect()}
    assert centers == pytest.approx({"B": np.mean(a), "A": np.mean(b)})
    ranges = {r["phase"]: (r["start_index"], r["end_index"]) for r in done.phases.collect()}
    assert ranges == {"B": (0, 10), "A": (10, 20)}
    assert sorted(r["global_idx"] for r in done.points.collect()) == list(range(20))
    shift = done.findings().where("generator = 'phase_shift'").first()
    assert shift["phase"] == "A" and shift["severity"] == "danger"
    assert {r["label"] for r in done.health().collect()} <= {"Healthy", "Normal", "Attention", "Critical"}


def test_interleaved_phases_are_joined(spark):
    df = rows(spark, [1, 2, 3, 4, 5], phases=list("AABBA"))
    sizes = variables.imr(df, Roles("x", "t", phase="p")).params
    assert {r["phase"]: r["n"] for r in sizes.collect()} == {"A": 3, "B": 2}


def test_missing_values(spark):
    df = rows(spark, [1, None, 3])
    assert points(variables.imr(df, ONE))["value"].tolist() == [1, 3]
    assert points(variables.imr(df, ONE, missing="zero"))["value"].tolist() == [1, 0, 3]


def test_null_series_keep_their_rows(spark):
    df = rows(spark, INDIVIDUAL, groups=[None, "a"] * 10)
    for mode in ({}, {"blocked": True, "block_rows": 4}):
        p = variables.imr(df, Roles("x", "t", "g"), **mode).points
        assert p.count() == 20 and p.where("ucl is null").count() == 0


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_every_chart_can_be_drawn(spark, kind):
    df = rows(spark, INDIVIDUAL, groups=[str(i // 5) for i in range(20)])
    if kind in ("hotelling_t2", "mewma"):
        df = df.withColumn("y", F.col("x") * F.col("x") + F.col("t") % 3)
        chart = draw(kind, df, ONE, columns=["x", "y"])
    else:
        extra = {"presummarize": {"target": 10.3, "sigma": 0.2}}.get(kind, {})
        chart = draw(kind, df, GROUPED, **extra)
    p = chart.points.toPandas()
    assert len(p) > 0 and {"sigma_hat", "method"} <= set(chart.params.columns)
    lines = p[["ucl", "cl", "lcl"]].astype(float)
    # sums above the number of trials, and fractions for a chart of counts, leave the domain
    if kind not in ("p", "laney_p", "np", "g"):
        assert np.isfinite(lines.to_numpy()).all()
        assert (lines["ucl"] >= lines["cl"] - 1e-12).all() and (lines["cl"] >= lines["lcl"] - 1e-12).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 100).map(lambda v: round(v, 1)), min_size=3, max_size=50))
def test_limits_are_ordered_and_widen(spark, values):
    df = rows(spark, values)
    narrow, wide = (points(variables.imr(df, ONE, k_sigma=k)) for k in (2.0, 3.0))
    assert (narrow["ucl"] >= narrow["cl"]).all() and (narrow["cl"] >= narrow["lcl"]).all()
    assert (wide["ucl"] >= narrow["ucl"]).all() and (wide["lcl"] <= narrow["lcl"]).all()
    z = zones(variables.imr(df, ONE).points).first()
    assert z["zone_a_upper"] >= z["zone_b_upper"] >= z["zone_b_lower"] >= z["zone_a_lower"]


def test_constants():
    assert (len(D2), len(D3), len(C4), len(C5)) == (49, 49, 49, 49)
    assert constant("d2", 2) == 1.128 and constant("d2", 50) == constant("d2", 500) == 4.498
    assert constant("c4", 10) == 0.9727
    with pytest.raises(ValueError):
        constant("d2", 1)


@pytest.mark.parametrize(
    ("kind", "options"),
    [
        ("imr", {"k_sigma": 0}), ("imr", {"sigma_method": "other"}), ("mr", {"span": 1}),
        ("mr", {"span": 3, "sigma_method": "median_moving_range"}), ("run", {"center_method": "mode"}),
        ("ewma", {"lam": 0}), ("ewma", {"lam": 1.5}), ("cusum", {"h": -1}), ("cusum", {"k": 0}),
        ("cusum", {"head_start": -1}), ("cusum_vmask", {"d_units": 0}), ("p", {"n_trials": 0}),
        ("presummarize", {"target": 1, "sigma": 0}), ("short_run", {"scaling": "log"}),
        ("three_way", {"within_method": "mad"}), ("hotelling_t2", {"columns": ["x", "t"], "alpha": 2}),
        ("hotelling_t2", {"columns": ["x", "t"], "stage": 3}), ("hotelling_t2", {"columns": ["x"]}),
        ("mewma", {"columns": ["x", "t"], "lam": 0}), ("unknown", {}), ("imr", {"missing": "keep"}),
    ],
)
def test_bad_arguments(spark, kind, options):
    with pytest.raises(ValueError):
        draw(kind, rows(spark, [1, 2, 3]), ONE, **options)


def test_many_rows_in_few_subgroups_stay_in_one_piece(spark):
    df = grouped(spark, [[float(i % 7 + g) for i in range(40)] for g in range(5)])
    few = variables.xbar_r(df, GROUPED, block_rows=50)
    many = variables.xbar_r(df, Roles("x", "t"), block_rows=50)
    assert not few.sequence.blocked and many.sequence.blocked
    whole = variables.xbar_r(df, GROUPED)
    assert sorted(map(tuple, few.points.collect())) == sorted(map(tuple, whole.points.collect()))
    assert many.points.count() == 200
