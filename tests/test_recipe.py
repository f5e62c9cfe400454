"""Recipes with phases, exclusion and options; forecasts of short series; types of whole columns."""

from pyspark.sql import functions as F

from plumbline import Recipe, Roles, analyze
from plumbline.operators import compare, rules, variables
from plumbline.operators.forecast import forecast
from plumbline.operators.subgroups import phase_table
from plumbline.sources import tables


def two_phases(spark):
    """Two phases of 20 rows in 4 subgroups of 5."""
    rows = [(i, "A" if i < 20 else "B", f"g{i // 5}", float(i % 7 + i // 20)) for i in range(40)]
    return spark.createDataFrame(rows, "n_row int, phase_id string, grp string, v double")


GROUPED = Roles("v", "n_row", phase="phase_id", subgroup="grp")
PLAIN = Roles("v", "n_row", phase="phase_id")


def test_positions_count_the_points_of_the_chart(spark):
    rows = two_phases(spark)
    for recipe, per_phase in ((Recipe("xbar_r", GROUPED), 4), (Recipe("mr", PLAIN), 19), (Recipe("imr", PLAIN), 20)):
        done = analyze(rows, recipe)
        assert sorted(r.global_idx for r in done.points.collect()) == list(range(2 * per_phase)), recipe.kind
        assert sorted((r.start_index, r.end_index) for r in done.phases.collect()) == [(0, per_phase), (per_phase, 2 * per_phase)]
    chart = variables.xbar_r(rows, GROUPED)
    got = compare.phase_summary(chart, rules.violations(chart), phase_table(rows, GROUPED)).collect()
    assert sorted((r.start_index, r.end_index, r.total) for r in got) == [(0, 4, 4), (4, 8, 4)]


def test_exclusion_charts_the_points_of_the_recipe(spark):
    rows = two_phases(spark).withColumn("out", F.col("n_row") % 20 == 3)
    kept = rows.where("not out")
    for kind, options, n in (("imr", {"sigma_method": "range"}, 8), ("imr", {"sigma_method": "stddev"}, 8), ("imr", {}, 40), ("mr", {}, 38)):
        done = analyze(rows, Recipe(kind, GROUPED, options, exclude="out"))
        limits = {(r.phase, r.ucl) for r in done.points.collect()}
        assert done.points.count() == n
        assert limits == {(r.phase, r.ucl) for r in analyze(kept, Recipe(kind, GROUPED, options)).points.collect()}


def test_missing_as_zero_counts_everywhere(spark):
    rows = two_phases(spark).withColumn("v", F.when(F.col("n_row") != 7, F.col("v"))).withColumn("out", F.col("n_row") == 5)
    recipe = Recipe("imr", PLAIN, {"missing": "zero"}, usl=9.0, lsl=-1.0, exclude="out")
    done = analyze(rows, recipe)
    assert done.points.count() == 40 and max(r.end_index for r in done.phases.collect()) == 40
    whole = analyze(rows.na.fill(0.0, ["v"]), Recipe("imr", PLAIN, usl=9.0, lsl=-1.0, exclude="out"))
    key = lambda a: sorted(map(str, a.capability.collect()))
    assert key(done) == key(whole)


def test_short_series_have_a_status_and_limits_are_their_own(spark):
    rows = [(s, i, float(i)) for s, n in (("long", 24), ("short", 4)) for i in range(n)]
    rows = spark.createDataFrame(rows, "s string, i int, v double")
    limits = spark.createDataFrame([("long", "all", 26.5, -5.0)], "s string, phase string, ucl double, lcl double")
    summary, projection = forecast(rows, Roles("v", "i", "s"), horizon=6, limits=limits)
    got = {r.s: r for r in summary.collect()}
    assert got["short"].status == "too short" and got["short"].model is None and got["short"].n == 4
    # the projection begins at the last value, 23
    assert got["long"].status == "forecast" and got["long"].steps_to_breach == 5
    assert {r.s for r in projection.collect()} == {"long"}


def test_types_look_at_every_row(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 60, "1").otherwise("x").alias("late"))
    found = lambda **o: {r.name: r.dtype for r in tables.column_types(rows, "id", **o).collect()}
    assert found() == {"id": "numeric", "late": "text"} and found(sample=50)["late"] == "numeric"
