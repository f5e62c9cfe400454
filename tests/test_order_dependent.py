"""Windows and blocks against plain loops, on random series with many ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import rules, series as series_module, time_weighted, variables
from plumbline.operators.chart import Chart, individuals, moving_range
from plumbline.operators.series import IDX, Roles, medians_of, order_statistics, sequence
from tests import loops

ROLES = Roles("x", "t", "s")
MODES = [{}, {"blocked": True, "block_rows": 16}]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    out = {}
    for i, n in enumerate([1, 2, 15, 40, 97, 160]):
        noise = rng.normal(10, 2, n)
        drift = np.where(np.arange(n) > n // 2, 1.5, 0.0) if i % 2 else 0.0
        out[f"s{i}"] = np.round(noise + drift, 0 if i % 3 else 1)
    alternating = np.where(np.arange(60) % 2, 11.0, 9.0)
    alternating[30] = 11.0
    out["alt"] = alternating
    out["trend"] = np.r_[np.arange(8), np.arange(8, 0, -1), 3, 3, np.arange(3, 12)].astype(float)
    return out


@pytest.fixture(scope="module")
def table(spark, series):
    rows = [(s, t, float(v)) for s, vs in series.items() for t, v in enumerate(vs)]
    pdf = pd.DataFrame(rows, columns=["s", "t", "x"]).sample(frac=1, random_state=3)
    return spark.createDataFrame(pdf).repartition(5).cache()


def by_series(df, *columns):
    pdf = df.toPandas().sort_values(["s", IDX])
    return {s: g[list(columns)] for s, g in pdf.groupby("s")}


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_index_and_moving_ranges(table, series, mode):
    seq = moving_range(individuals(table, ROLES, **mode), 3)
    got = by_series(seq.df, IDX, "value", "mr")
    assert seq.blocked == bool(mode)
    for s, v in series.items():
        assert got[s][IDX].tolist() == list(range(len(v)))
        assert got[s]["value"].tolist() == v.tolist()
        want = [np.nan] * min(2, len(v)) + [np.ptp(v[i - 2: i + 1]) for i in range(2, len(v))]
        np.testing.assert_allclose(got[s]["mr"].astype(float), want)


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_every_rule(table, series, mode):
    chart = variables.imr(table, ROLES, **mode)
    every = tuple(range(1, 9))
    flagged = rules.with_rules(chart, every, rules.WESTGARD)
    names = [*map(str, every), *rules.WESTGARD]
    columns = ["value", "ucl", "lcl", "zone_cl", "zone_sigma", *[f"rule_{r}" for r in names]]
    got = by_series(flagged.df, *columns)
    fired = set()
    for s, v in series.items():
        if len(v) < 2:
            continue
        first = got[s].iloc[0]
        cl, sigma = first["zone_cl"], first["zone_sigma"]
        for r in names:
            want = (
                loops.westgard(v, cl, sigma, r) if r in rules.WESTGARD
                else loops.nelson(v, cl, sigma, first["ucl"], first["lcl"], int(r))
            )
            assert got[s][f"rule_{r}"].tolist() == want, (s, r)
            fired |= {r} if any(want) else set()
    assert {"2", "3", "4", "5", "6"} <= fired


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_custom_rule_sizes(table, series, mode):
    chart = variables.imr(table, ROLES, **mode)
    custom = {2: {"n": 4}, 3: {"n": 3}, 4: {"n": 5}, 5: {"n": 3, "window": 6}, 7: {"n": 5}}
    flagged = rules.with_rules(chart, tuple(custom), custom=custom)
    got = by_series(flagged.df, "zone_cl", "zone_sigma", *[f"rule_{r}" for r in custom])
    for s, v in series.items():
        first = got[s].iloc[0]
        for r, own in custom.items():
            if len(v) < 2:
                continue
            want = loops.nelson(v, first["zone_cl"], first["zone_sigma"], 0, 0, r, **own)
            assert got[s][f"rule_{r}"].tolist() == want, (s, r)


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
@pytest.mark.parametrize("lam", [1e-17, 1e-6, 0.05, 0.2, 0.9, 0.999999, 1.0])
def test_ewma(table, series, mode, lam):
    chart = time_weighted.ewma(table, ROLES, lam=lam, target=9.5, **mode)
    got = by_series(chart.points, "value", "residual")
    for s, v in series.items():
        want = loops.ewma(v, 9.5, lam)
        np.testing.assert_allclose(got[s]["value"], want, rtol=1e-12)
        before = np.r_[9.5, want[:-1]]
        np.testing.assert_allclose(got[s]["residual"], v - before, atol=1e-9)
    ends = {r["s"]: r["forecast"] for r in chart.note("forecast").collect()}
    assert ends["s5"] == pytest.approx(loops.ewma(series["s5"], 9.5, lam)[-1])


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
@pytest.mark.parametrize("head", [0.0, 2.5])
def test_cusum_and_shift_starts(table, series, mode, head):
    chart = time_weighted.cusum(
        table, ROLES, target=10.0, sigma=1.0, h=4.0, k=0.5, head_start=head, **mode
    )
    got = by_series(chart.points, "value", "c_minus", "signal_upper", "signal_lower")
    starts = chart.note("shifts").toPandas()
    for s, v in series.items():
        up, down = loops.cusum(v, 10.0, 1.0, 0.5, head)
        np.testing.assert_allclose(got[s]["value"], up, atol=1e-9)
        np.testing.assert_allclose(got[s]["c_minus"], down, atol=1e-9)
        for side, stat, signal in (
            ("upper", up, [u > 4.0 for u in up]), ("lower", down, [d < -4.0 for d in down])
        ):
            mine = starts[(starts["s"] == s) & (starts["side"] == side)].sort_values("signal_idx")
            pairs = list(zip(mine["signal_idx"], mine["shift_start"]))
            assert pairs == loops.shift_starts(np.round(stat, 9), signal), (s, side)


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_running_sum_and_vmask(table, series, mode):
    chart = time_weighted.cusum_vmask(table, ROLES, target=10.0, sigma=2.0, **mode)
    got = by_series(chart.points, "value", "vertex_x", "signal")
    for s, v in series.items():
        np.testing.assert_allclose(got[s]["value"], np.cumsum((v - 10.0) / 2.0), atol=1e-9)
        np.testing.assert_allclose(got[s]["vertex_x"], np.arange(len(v)) + 5.0)
        up, down = loops.cusum(v, 10.0, 2.0, 0.5)
        assert got[s]["signal"].tolist() == [a > 5 or b < -5 for a, b in zip(up, down)]


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_known_values(spark, mode):
    rng = np.random.default_rng(1)
    rows = [(s, t, None if rng.random() < 0.8 else float(t)) for s in "ab" for t in range(90)]
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(3)
    from pyspark.sql import functions as F

    seq = sequence(df, "s", "t", **mode).last_known(down=F.col("v"))
    seq = seq.next_known(up=F.col("v"))
    got = seq.df.toPandas().sort_values(["s", "t"])
    want = pd.DataFrame(rows, columns=["s", "t", "v"])
    down, up = want.groupby("s")["v"].ffill(), want.groupby("s")["v"].bfill()
    np.testing.assert_array_equal(got["down"], down)
    np.testing.assert_array_equal(got["up"], up)


@pytest.mark.parametrize("mode", MODES, ids=["plain", "blocked"])
def test_runs(table, series, mode):
    chart = variables.run_chart(table, ROLES, **mode)
    got = {r["s"]: r for r in chart.params.collect()}
    for s, v in series.items():
        assert got[s]["center"] == np.median(v)
        assert got[s]["n_runs"] == loops.count_runs(v, np.median(v)), s
        assert 0 <= got[s]["p_value"] <= 1


@pytest.mark.parametrize("blocked", [False, True])
def test_order_statistics(table, series, blocked):
    from pyspark.sql import functions as F

    got = order_statistics(
        table, ["s"], "x", {"q1": lambda n: F.floor(n * 0.25), "top": lambda n: n - 1},
        blocked=blocked, block_rows=8,
    )
    middle = {r["s"]: r["m"] for r in medians_of(table, ["s"], "x", "m", blocked=blocked).collect()}
    for r in got.collect():
        v = np.sort(series[r["s"]])
        assert (r["q1"], r["top"]) == (v[int(len(v) * 0.25)], v[-1])
        assert middle[r["s"]] == np.median(v)


def test_partitions_and_input_order_do_not_matter(spark, table):
    def points():
        chart: Chart = time_weighted.ewma(table, ROLES)
        return sorted(map(tuple, chart.points.collect()))

    before = points()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        after = points()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r[:3] for r in before] == [r[:3] for r in after]
    np.testing.assert_allclose(
        [r[3:8] for r in before if r[4] is not None and not np.isnan(r[4])],
        [r[3:8] for r in after if r[4] is not None and not np.isnan(r[4])], rtol=1e-12)


def test_size_check_picks_blocks(spark, table):
    assert not individuals(table, ROLES).blocked
    assert individuals(table, ROLES, block_rows=50).blocked
    spark.conf.set("spark.plumbline.blockRows", "50")
    try:
        assert individuals(table, ROLES).blocked
    finally:
        spark.conf.unset("spark.plumbline.blockRows")


def test_giant_keys_are_never_ordered_in_one_task(table):
    """Every window over charted values is partitioned by key and block."""
    chart = variables.imr(table, ROLES, block_rows=50)
    plan = rules.with_rules(chart).df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "value#" in line]
    assert windows and all("_block#" in line.rsplit("], [", 2)[-2] for line in windows)


def test_short_blocks_do_not_multiply_partitions(spark, monkeypatch):
    written, durable = [], series_module.durable
    monkeypatch.setattr(series_module, "durable", lambda df: written.append(durable(df)) or written[-1])
    df = spark.range(3000).selectExpr("id % 2 AS k", "(id * 7919) % 3000 AS t")
    got = sequence(df, "k", "t", block_rows=10).df.toPandas()
    assert [d.rdd.getNumPartitions() for d in written] == [4]
    for _, one in got.groupby("k"):
        assert one.sort_values("t")[IDX].tolist() == list(range(1500))


def test_parameters_reach_a_giant_key_block_by_block(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    df = spark.range(2000).selectExpr("if(id < 1900, 'a', if(id < 1990, 'b', null)) AS k", "id AS t")
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        seq = sequence(df, "k", "t", block_rows=50)
        params = df.where("k IS NULL OR k = 'a'").groupBy("k").agg(F.min("t").alias("least"))
        got = seq.beside(params).df.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 2000 and not {"_block", "_last"} & set(got)
    assert got[got.k == "a"].task.nunique() > 1
    assert set(got[got.k == "a"].least) == {0} and set(got[got.k.isna()].least) == {1990}
    assert got[got.k == "b"].least.isna().all()
