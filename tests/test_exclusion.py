"""Excluded rows: every chart is estimated as if they were not there, and still charts them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import Recipe, Roles, analyze
from plumbline.operators import compare
from plumbline.operators.chart import estimating_range, individuals
from plumbline.plans.recipe import KINDS, draw

SINGLE = Roles("v", "t", "s")
GROUPED = Roles("v", "t", "s", subgroup="g")
SUBGROUPED = ("xbar_r", "xbar_s", "r", "s", "three_way", "presummarize", "p", "np", "c", "u", "laney_p", "laney_u")
VECTORS = ("hotelling_t2", "mewma")
OPTIONS = {"presummarize": {"target": 3.0, "sigma": 1.0}, "mr": {"span": 3}, **{k: {"columns": ["v", "w", "x"]} for k in VECTORS}}
MODES = [{}, {"block_rows": 7}]
IGNORED = ("n_points", "covariance", "inverse", "mean_vector", "_last", "z", "p_value", "expected_runs")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for s, n in (("a", 60), ("b", 45), ("c", 12)):
        for t in range(n):
            whole = t // 5 == 3  # a subgroup that is excluded altogether
            out.append((s, t, f"g{t // 5:02d}", *(float(x) for x in rng.integers(1, 9, 3)), bool(whole or rng.random() < 0.2) if t else None))
    return spark.createDataFrame(out, "s string, t int, g string, v double, w double, x double, out boolean").repartition(3).cache()


def roles_of(kind):
    return GROUPED if kind in SUBGROUPED or kind == "short_run" else SINGLE


def values_of(kind, df):
    """Attribute charts need counts below the number of rows."""
    return df.withColumn("v", (F.col("v") > 6).cast("double")) if kind in ("p", "np", "laney_p") else df


def numbers(table, keys):
    columns = [c for c, k in table.dtypes if c not in keys and c not in IGNORED and k in ("double", "bigint", "int")]
    return {tuple(r[k] for k in keys): {c: r[c] for c in columns} for r in table.collect()}


@pytest.mark.parametrize("kind, mode", [
    *((k, {}) for k in KINDS),
    *((k, {"block_rows": 7}) for k in ("imr", "mr", "r", "three_way", "laney_p", "short_run", "run", "t", "ewma", "cusum_vmask", "mewma")),
], ids=lambda v: v if isinstance(v, str) else "blocked" if v else "plain")
def test_parameters_are_those_of_the_other_rows(rows, kind, mode):
    df, options = values_of(kind, rows), {**OPTIONS.get(kind, {}), **mode}
    done = analyze(df, Recipe(kind, roles_of(kind), options, exclude="out"))
    kept = draw(kind, df.where("not coalesce(out, false)"), roles_of(kind), **options)
    got, want = numbers(done.params, done.chart.keys), numbers(kept.params, kept.keys)
    assert set(got) == set(want)
    for key, line in want.items():
        for name, value in line.items():
            assert got[key][name] == pytest.approx(value, rel=1e-9, abs=1e-12, nan_ok=True), (key, name)
    points, every = done.points, draw(kind, df, roles_of(kind), **options).points
    assert points.count() == every.count()
    mine = {(r.s, r.idx): r.value for r in points.collect()}
    if kind not in ("ewma", "cusum", "cusum_vmask", "short_run", *VECTORS):  # these are charted against estimates
        assert mine == {(r.s, r.idx): r.value for r in every.collect()}
    assert {r.excluded for r in points.select("excluded").distinct().collect()} == {True, False}


def test_a_subgroup_is_excluded_if_all_its_rows_are(rows):
    done = analyze(rows, Recipe("xbar_r", GROUPED, exclude="out")).points.where("excluded").collect()
    marked = rows.groupBy("s", "g").agg(F.min(F.coalesce("out", F.lit(False))).alias("whole")).where("whole").collect()
    assert {(r.s, r.subgroup) for r in done} == {(r.s, r.g) for r in marked} != set()


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
@pytest.mark.parametrize("span", [2, 4])
def test_ranges_reach_over_gaps(rows, mode, span):
    roles = Roles("v", "t", "s", excluded="out")
    seq, name = estimating_range(individuals(rows, roles, **mode), roles, span)
    got = {(r.s, r.idx): (r[name], r.excluded) for r in seq.df.collect()}
    for s, group in rows.toPandas().sort_values("t").groupby("s"):
        values = [(k, v) for k, (v, out) in enumerate(zip(group["v"], group["out"])) if out is not True]
        for place, (k, _) in enumerate(values):
            window = [v for _, v in values[place - span + 1 : place + 1]] if place >= span - 1 else None
            assert got[s, k] == ((max(window) - min(window)) if window else None, False)
    assert all(r is None for r, out in got.values() if out)


def test_labels_name_the_row_where_points_are_rows(rows):
    plain = analyze(rows, Recipe("imr", Roles("v", "t", "s"))).points.collect()
    assert {r.label for r in plain if r.s == "c"} == {str(t) for t in range(12)}
    ranges = analyze(rows.where("t > 4"), Recipe("mr", Roles("v", "t", "s"))).points.collect()
    assert {r.label for r in ranges if r.s == "c"} == {str(k) for k in range(1, 7)}


def test_excluded_points_are_to_be_reviewed(rows):
    points = analyze(rows, Recipe("imr", SINGLE, exclude="out")).points
    reviews = compare.exclusion_reviews(points).collect()
    assert len(reviews) == points.where("excluded").count() > 0
    assert all(r.label in r.check for r in reviews)
