"""Preparation, profiles, sources, findings, comparison and forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.expressions import spark_expression
from plumbline.operators import compare, findings, forecast, prep, profile, rules, variables
from plumbline.operators.series import Roles
from plumbline.plans.steps import replay
from plumbline.sources import tables


def one(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_trim_and_title(spark):
    df = one(spark, ["  Alice  ", "\tBoston ", None, "o'neil mc-DONALD été 3rd"])
    assert column(prep.clean_text(df, "v"))[:3] == ["Alice", "Boston", None]
    assert column(prep.clean_text(df, "v", "title"))[3] == "O'Neil Mc-Donald éTé 3rd"
    with pytest.raises(ValueError):
        prep.clean_text(df, "v", "reverse")


def test_rename_and_split(spark):
    df = prep.split_column(prep.rename_column(one(spark, ["A-B", "C", None]), "v", "source"), "source", "-")
    assert [(r["source_1"], r["source_2"]) for r in df.orderBy("i").collect()] == [
        ("A", "B"), ("C", None), (None, None)]
    dots = prep.split_column(one(spark, ["a.b.c"]), "v", ".", 2).first()
    assert (dots["v_1"], dots["v_2"]) == ("a", "b")


def test_replace(spark):
    df = one(spark, ["a.a.a", None, "bbb"])
    assert column(prep.find_replace(df, "v", ".", "-")) == ["a-a.a", None, "bbb"]
    assert column(prep.find_replace(df, "v", "(a)", "<$1$&>", regex=True))[0] == "<aa>.<aa>.<aa>"


def test_filters_with_nulls(spark):
    df = one(spark, ["x", "", None, "axb"])
    assert column(prep.filter_rows(df, "v", "neq", "x")) == ["", None, "axb"]
    assert column(prep.filter_rows(df, "v", "not_contains", "x")) == ["", None]
    assert column(prep.filter_rows(df, "v", "is_null")) == ["", None]
    assert column(prep.filter_rows(df, "v", "is_not_null")) == ["x", "axb"]
    numbers = one(spark, [1.0, None, 3.0], "double")
    assert column(prep.filter_rows(numbers, "v", "lte", "3")) == [1.0, 3.0]
    assert column(prep.filter_rows(numbers, "v", "eq", "3")) == [3.0]
    with pytest.raises(ValueError):
        prep.filter_rows(df, "v", "like", "x")
    with pytest.raises(ValueError):
        prep.filter_rows(df, "w", "eq", "x")


def test_filters_by_column_type(spark):
    rows = [("2023-01-01", "2023-01-01 10:00:00", True), ("2023-06-01", "2023-06-01 00:00:00", False), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, t string, b boolean").select(
        F.col("d").cast("date"), F.col("t").cast("timestamp"), "b")

    def count(column, operator, value):
        return prep.filter_rows(df, column, operator, value).count()

    assert count("d", "eq", "2023-01-01") == 1 and count("d", "neq", "2023-01-01") == 2
    assert count("t", "gt", "2023-01-01") == 2 and count("t", "lte", "2023-01-01 10:00:00") == 1
    assert count("d", "between", ("2023-01-02", "2023-12-31")) == 1
    assert count("b", "eq", True) == 1 and count("b", "neq", True) == 2


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, None, 3), (4, None, 4)], "i int, k string, w int")
    kept = prep.remove_duplicates(df.repartition(4), ["k"], "i")
    assert sorted((r["i"], r["w"]) for r in kept.collect()) == [(1, 2), (2, 3)]
    assert kept.columns == df.columns


def test_pages_agree(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") * 7 % 100).alias("v"))
    short = prep.page(df, "v", 90, 20).collect()
    monkeypatch.setattr(prep, "TOP_ROWS", 10)
    assert sorted(prep.page(df, "v", 90, 20).collect()) == sorted(short) and len(short) == 10


def test_fills(spark):
    df = one(spark, [None, "1", "", "3", None])
    assert column(prep.handle_missing(df, "v", "fill_down", order="i")) == [None, "1", "1", "3", "3"]
    assert column(prep.handle_missing(df, "v", "fill_up", order="i")) == ["1", "1", "3", "3", None]
    numbers = one(spark, [1.0, None, 2.0, 6.0], "double")
    assert column(prep.handle_missing(numbers, "v", "fill_mean")) == [1, 3, 2, 6]
    assert column(prep.handle_missing(numbers, "v", "fill_median")) == [1, 2, 2, 6]
    with pytest.raises(ValueError):
        prep.handle_missing(df, "v", "fill_down")


@pytest.mark.parametrize(
    ("text", "want"),
    [("[v] / 2 * 3", 9.0), ("[v] / ([v] - 6)", None), ("round([v] / 4)", 2.0), ("round(-[v] / 4)", -1.0),
     ("-[v] + pow(2, 3)", 2.0), ("max([v], 7) - min([v], 2)", 5.0), ("[v] / sqrt(4) / 3", 1.0),
     ("log(exp([v]))", 6.0), ("abs([v] - 9) + floor(2.7) + ceil(2.1)", 8.0), ("[v] / -[v]", -1.0)],
)
def test_calculated_columns(spark, text, want):
    got = prep.calculated_column(one(spark, [6.0], "double"), "r", text).first()["r"]
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(
    "text", ["", "1 + 2", "[w] + 1", "[v]; 1", "import([v])", "eval([v])", "[v] + `v`", "([v]", "[v])", "[v] /"]
)
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        spark_expression(text, ["v"])


def test_recode_bins_and_types(spark):
    df = one(spark, ["a", "b", None])
    assert column(prep.recode(df, "v", {"a": "x"})) == ["x", "b", None]
    big = {f"k{i}": "z" for i in range(500)} | {"b": "y"}
    assert column(prep.recode(df, "v", big)) == ["a", "y", None]
    numbers = one(spark, [0.0, 1.0, 5.0, 10.0, None], "double")
    assert column(prep.bin_column(numbers, "v", 2, "b"), "b") == ["bin_1", "bin_1", "bin_1", "bin_2", None]
    text = one(spark, ["1.5", "x", "", None, "NaN"])
    assert column(prep.change_type(text, "v", "numeric")) == [1.5, None, None, None, None]
    assert tuple(prep.preview_conversion(text, "v", "numeric").first()) == (1, 4)


def test_validation(spark):
    df = one(spark, ["5", "x", None, "50"])
    assert column(prep.validate_column(df, "v", {"type": "range", "min": 1, "max": 9})) == ["x", "50"]
    assert column(prep.validate_column(df, "v", {"type": "regex", "pattern": "("})) == ["5", "x", "50"]
    assert column(prep.validate_column(df, "v", {"type": "allowed", "values": [5, 50]})) == ["x"]


def test_failing_steps(spark):
    df = one(spark, ["a"])
    steps = [{"type": "rename", "params": {"old": "v", "new": "w"}},
             {"type": "trim", "params": {"columns": ["v"]}}, {"type": "unknown"}]
    with pytest.raises(ValueError):
        replay(df, steps, order="i")
    assert replay(df, steps, order="i", skip_errors=True).columns == ["i", "w"]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿Thickness,Hour,Note\n1,a,\"x, \"\"y\"\"\"\n\n2,b,\n".encode())
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["Thickness", "Hour", "Note"]
    assert [tuple(r) for r in df.collect()] == [("1", "a", 'x, "y"'), ("2", "b", None)]
    roles = {r["name"]: (r["dtype"], r["role"]) for r in tables.schema_profile(df).collect()}
    assert roles == {"Thickness": ("numeric", "value"), "Hour": ("text", "subgroup"), "Note": ("text", None)}
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    path.write_text('a,b\n"x\ny",2\n')
    assert tables.read_csv(spark, str(path), multi_line=True).first()["a"] == "x\ny"
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "empty.csv"))


def test_documents_with_different_keys(spark):
    docs = ['{"b":"1"}', '{"a":"2","b":null}', '{"c":"3"}']
    df = spark.createDataFrame(list(enumerate(docs)), "n int, raw string")
    assert tables.document_columns(df, "raw", "n") == ["b", "a", "c"]
    flat = tables.document_table(df, "raw", "n").orderBy("n").collect()
    assert [tuple(r)[1:] for r in flat] == [("1", None, None), (None, "2", None), (None, None, "3")]


def test_profile_of_a_constant_and_of_nothing(spark):
    same = one(spark, [4.0, 4.0], "double")
    m = profile.numeric_moments(same, "v").first()
    assert (m["std"], m["skewness"], m["kurtosis"]) == (0, 0, 0)
    bars = profile.histogram(same, "v").orderBy("bin").collect()
    assert [b["count"] for b in bars] == [2] + [0] * 11
    none = profile.profile_base(one(spark, [None, ""]), ["v"]).first()
    assert (none["missing"], none["missing_pct"], none["distinct"]) == (2, 100.0, 0)


def test_comparison_of_charts(spark):
    rng = np.random.default_rng(0)
    values = np.r_[rng.normal(0, 1, 60), rng.normal(4, 1, 20)]
    df = one(spark, [float(v) for v in values], "double")
    roles = Roles("v", "i")
    charts = {"imr": variables.imr(df, roles), "lj": variables.levey_jennings(df, roles)}
    fired = {n: rules.violations(c, (1,)) for n, c in charts.items()}
    flagged = {n: {r["idx"] for r in v.collect()} for n, v in fired.items()}
    rows = compare.disagreements(fired, ["phase"]).collect()
    assert {r["idx"] for r in rows} == flagged["imr"] ^ flagged["lj"] != set()
    total = compare.disagreement_summary(fired, ["phase"], charts["imr"].points).first()
    assert total["unanimous"] == len(flagged["imr"] & flagged["lj"])
    assert total["only_imr"] == len(flagged["imr"] - flagged["lj"])
    with pytest.raises(ValueError):
        compare.disagreements({"imr": fired["imr"]}, ["phase"])


@pytest.mark.parametrize("mode", [{}, {"blocked": True, "block_rows": 20}])
def test_findings_do_not_depend_on_blocks(spark, mode):
    values = np.r_[np.random.default_rng(3).normal(10, 1, 80), np.arange(10, 18)]
    df = one(spark, [float(v) for v in values], "double")
    chart = variables.imr(df, Roles("v", "i"), **mode)
    known = findings.facts(chart, nelson=range(1, 9), westgard=("1_2s",))
    got = {(r["generator"], r["title"]): r["metric_value"] for r in findings.findings(known).collect()}
    assert got["statistics", "Summary Statistics"] == 88
    assert got["trend", "Trend Detected"] == got["rule", "Rule 3"] > 0
    side = values > values.mean()
    runs = next(v for (g, _), v in got.items() if g == "runs")
    assert runs == 1 + (side[1:] != side[:-1]).sum()
    with pytest.raises(ValueError):
        findings.findings(known, ["capability"])


def test_forecast_of_known_shapes(spark):
    t = np.arange(60)
    shapes = {"line": 5 + 2.0 * t, "season": 50 + 10 * np.sin(t * 2 * np.pi / 12), "short": t[:6] * 1.0}
    data = [(k, int(i), float(v)) for k, vs in shapes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    summary, future = forecast.forecast(df, Roles("v", "i", "k"), horizon=24, ucl=140.0, lcl=0.0)
    best = {r["k"]: r for r in summary.collect()}
    assert {k: r["status"] for k, r in best.items()} == {"line": "forecast", "season": "forecast", "short": "too short"}
    assert best["line"]["model"] in ("linear", "drift") and best["line"]["drift_label"] == "Approaching drift"
    assert (best["season"]["model"], best["season"]["period"]) == ("seasonal", 12)
    ahead = {k: g.sort_values("h") for k, g in future.toPandas().groupby("k")}
    # anchored: the first projected value is the last one seen
    np.testing.assert_allclose(ahead["line"]["y"], shapes["line"][-1] + 2.0 * np.arange(24), rtol=1e-6)
    assert best["line"]["steps_to_breach"] == 10 and best["season"]["steps_to_breach"] is None
    assert (ahead["season"]["upper"] >= ahead["season"]["lower"]).all()
    wave = 50 + 10 * np.sin((t[-1] + 1 + np.arange(24)) * 2 * np.pi / 12)
    np.testing.assert_allclose(ahead["season"]["y"] - wave, (shapes["season"][-1] - wave[0]) * np.ones(24), atol=1e-6)


def test_recode_has_one_path_for_nulls_and_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    rest = {f"k{i}": "y" for i in range(300)}
    for mapping in ({"a": None}, {"a": None, **rest}):
        assert sorted(str(r.v) for r in prep.recode(df, "v", mapping).collect()) == ["None", "None", "b"]
    table = spark.createDataFrame([("a", "z"), ("a", "x")], "`from` string, `to` string")
    assert sorted(str(r.v) for r in prep.recode(df, "v", table).collect()) == ["None", "b", "x"]


def test_bins_of_large_values(spark):
    df = spark.createDataFrame([(float(k) * 1e13,) for k in range(11)], "v double")
    assert {r.bin for r in prep.bin_column(df, "v").collect()} == {f"bin_{k}" for k in range(1, 6)}


def test_reserved_series_names_are_an_error():
    with pytest.raises(ValueError, match="rename them"):
        Roles("v", "t", ("value", "s"))


def test_shared_profile_of_empty_and_null_columns(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, None)], "i int, t string")
    got = {r["column"]: r for r in profile.shared_profile(rows, ["i", "t"]).collect()}
    assert (got["i"]["median"], got["i"]["distinct"], got["t"]["missing"], got["t"]["distinct"]) == (2.0, 3, 3, 0)
    assert got["t"]["top_values"] is None and [t.value for t in got["i"]["top_values"]] == ["1", "2", "3"]
    none = {r["column"]: r for r in profile.shared_profile(rows.where("i > 9"), ["i", "t"]).collect()}
    assert none["i"]["count"] == none["t"]["count"] == 0 and none["i"]["q1"] is None


def test_rounding_keeps_large_infinite_and_missing_values(spark):
    rows = spark.createDataFrame([(1e300,), (-2.5,), (float("inf"),), (None,), (float("nan"),)], "x double")
    got = [r.y for r in prep.calculated_column(rows, "y", "round([x])").collect()]
    assert got[:4] == [1e300, -2.0, float("inf"), None] and got[4] != got[4]
    nested = prep.calculated_column(rows.limit(2), "y", "floor(ceil([x] / 2) * 3)").collect()
    assert [r.y for r in nested] == [1.5e300, -3.0]


def test_first_rows_keep_their_order_key_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3, {"k": 1}), ("a", 1, None), (None, 2, {}), (None, 5, {"z": 2})], "g string, t int, m map<string,int>")
    got = sorted((r.g or "", r.t) for r in prep.remove_duplicates(rows, ["g"], "t").collect())
    assert got == [("", 2), ("a", 1)]
    assert prep.remove_duplicates(rows, ["g", "t"], "t").count() == 4
