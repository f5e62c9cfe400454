"""Comparing charts of the same rows, and summaries of selected points."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.capability import grade
from plumbline.operators.chart import Chart
from plumbline.operators.series import IDX, PHASE, join_keys


def _stacked(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [t.withColumn("chart", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def method_summary(
    charts: Mapping[str, Chart],
    violations: Mapping[str, DataFrame],
    capability: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per chart and key: first limits, sigma, k, capability, flags, rules, and phases of the series."""
    rows = {}
    for name, chart in charts.items():
        keys = chart.keys
        first = chart.sequence.df.where(F.col(IDX) == 0).select(*keys, "ucl", "cl", "lcl")
        table = join_keys(first, chart.params.select(*keys, "sigma_hat", "method"), keys)
        totals = violations[name].groupBy(*keys).agg(
            F.count(F.lit(1)).alias("flags"), F.count_distinct("test_id").alias("rules")
        )
        table = join_keys(table, totals, keys).na.fill(0, ["flags", "rules"])
        known = (capability or {}).get(name)
        if known is not None:
            table = join_keys(table, known.select(*keys, "cp", "cpk", "ppk"), keys)
        else:
            table = table.withColumns(
                {c: F.lit(None).cast("double") for c in ("cp", "cpk", "ppk")}
            )
        series = Window.partitionBy(*[k for k in keys if k != PHASE])
        rows[name] = table.withColumns({
            "grade": grade(F.col("cpk")), "k_sigma": F.lit(float(chart.k_sigma)), "n_phases": F.count(F.lit(1)).over(series),
        })
    return _stacked(rows)


def method_rule_counts(violations: Mapping[str, DataFrame], keys: list[str]) -> DataFrame:
    """Flagged points per chart, series and rule, phases taken together; rank 1 is the rule that flags most."""
    series = [k for k in keys if k != PHASE]
    counts = _stacked({n: v.select(*keys, "test_id") for n, v in violations.items()})
    counts = counts.groupBy("chart", *series, "test_id").agg(F.count(F.lit(1)).alias("n_points"))
    most = Window.partitionBy("chart", *series).orderBy(F.desc("n_points"), "test_id")
    return counts.withColumn("rank", F.row_number().over(most))


def rule_totals(violations: DataFrame, keys: list[str]) -> DataFrame:
    """Rules by flagged points, phases taken together."""
    series = [k for k in keys if k != PHASE]
    return violations.groupBy(*series, "test_id").agg(F.count(F.lit(1)).alias("n_points"))


def flagged_by(violations: Mapping[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per point some chart flags: which charts flag it, by which rules, which do not.

    Charts and rules are few, so the collected sets are small; the points stay spread
    over (key, idx).
    """
    rows = _stacked({n: v.select(*keys, IDX, "test_id") for n, v in violations.items()})
    names = F.array(*[F.lit(n) for n in sorted(violations)])
    points = rows.groupBy(*keys, IDX).agg(
        F.sort_array(F.collect_set("chart")).alias("flagged_by"),
        F.sort_array(
            F.collect_set(F.concat(F.col("chart"), F.lit(":"), F.col("test_id")))
        ).alias("rules"),
    )
    return points.withColumn("cleared_by", F.array_except(names, F.col("flagged_by")))


def disagreements(violations: Mapping[str, DataFrame], keys: list[str], points: DataFrame | None = None) -> DataFrame:
    """Points that some charts flag and others clear; with ``points`` of an analysis also their value and label."""
    if len(violations) < 2:
        raise ValueError("a comparison needs at least two charts")
    found = flagged_by(violations, keys).where(F.size("cleared_by") > 0)
    if points is None:
        return found
    return join_keys(found, points.select(*keys, IDX, "value", "label"), [*keys, IDX])


def disagreement_summary(
    violations: Mapping[str, DataFrame], keys: list[str], points: DataFrame
) -> DataFrame:
    """Per key: disagreements, their share of all points, unanimous and unique flags."""
    table = flagged_by(violations, keys)
    alone = {
        f"only_{name}": F.count_if(
            (F.size("flagged_by") == 1) & (F.get("flagged_by", 0) == name)
        )
        for name in violations
    }
    counts = table.groupBy(*keys).agg(
        F.count_if(F.size("cleared_by") > 0).alias("disagreements"),
        F.count_if(F.size("cleared_by") == 0).alias("unanimous"),
        *[c.alias(n) for n, c in alone.items()],
    )
    totals = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_points"))
    out = join_keys(totals, counts, keys).na.fill(
        0, ["disagreements", "unanimous", *alone]
    )
    return out.withColumn("percent", F.col("disagreements") / F.col("total_points") * 100.0)


def selection_summary(chart: Chart, selected: Column, excluded: Column | None = None) -> DataFrame:
    """count, min, max, mean, sample std and range of the chosen points, per key."""
    rows = chart.sequence.df.where(selected)
    gone = F.count_if(excluded) if excluded is not None else F.lit(0).cast("long")
    return rows.groupBy(*chart.keys).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        (F.max("value") - F.min("value")).alias("range"),
        gone.alias("excluded"),
    )


def violation_breakdown(
    chart: Chart, violations: DataFrame, selected: Column
) -> tuple[DataFrame, DataFrame]:
    """(totals, per rule) for the chosen points; out of control means flagged by rule 1."""
    keys = chart.keys
    chosen = chart.sequence.df.where(selected).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total")
    )
    hits = violations.where(selected)
    outside = hits.where(F.col("test_id") == "1").groupBy(*keys).agg(
        F.count_distinct(IDX).alias("ooc_count")
    )
    totals = join_keys(chosen, outside, keys).na.fill(0, ["ooc_count"])
    totals = totals.withColumn("in_control", F.col("total") - F.col("ooc_count"))
    per_rule = hits.groupBy(*keys, "test_id").agg(F.count_distinct(IDX).alias("n_points"))
    return totals, per_rule


def phase_summary(chart: Chart, violations: DataFrame, phases: DataFrame) -> DataFrame:
    """Per phase: limits of its first point, points, flags of rule 1, index range.

    ``phases`` says in which order the phases come; the index range counts the chart's points.
    """
    keys = chart.keys
    totals, _ = violation_breakdown(chart, violations, F.lit(True))
    first = chart.sequence.df.where(F.col(IDX) == 0).select(*keys, "ucl", "cl", "lcl")
    table = join_keys(totals, first, keys)
    table = join_keys(table, phases.drop("start_index", "end_index"), keys)
    w = Window.partitionBy(*[k for k in keys if k != PHASE]).orderBy("phase_rank")
    upto = F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumns({"start_index": upto - F.col("total"), "end_index": upto})


# Fixed texts of the recommendations, by the rules that call for them.
RECOMMENDATIONS = (
    (("1",), "Investigate points beyond control limits - check for assignable causes."),
    (("2",), "9+ consecutive points on same side of CL - possible process shift."),
    (("3", "5"), "Trending pattern detected - check for gradual process drift."),
)
IN_CONTROL = "Process appears in statistical control. Continue monitoring."


def recommendations(params: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """What to check, per key; keys without violations are told to go on."""
    fired = violations.groupBy(*keys).agg(
        *[
            F.max(F.col("test_id").isin(list(tests))).alias(f"_r{i}")
            for i, (tests, _) in enumerate(RECOMMENDATIONS)
        ],
        F.lit(True).alias("_any"),
    )
    table = join_keys(params.select(*keys), fired, keys)
    texts = [
        F.when(F.coalesce(F.col(f"_r{i}"), F.lit(False)), F.lit(text))
        for i, (_, text) in enumerate(RECOMMENDATIONS)
    ]
    texts.append(F.when(F.col("_any").isNull(), F.lit(IN_CONTROL)))
    return table.select(*keys, F.explode(F.array_compact(F.array(*texts))).alias("check"))


def exclusion_reviews(points: DataFrame) -> DataFrame:
    """One row per excluded point of an analysis, asking whether its exclusion still holds."""
    text = F.concat(F.lit("Point "), F.col("label"), F.lit(" is left out of the estimates: confirm that the reason still holds."))
    return points.where("excluded").drop("excluded").withColumn("check", text)


def comparison_strip(
    charts: Mapping[str, Chart], violations: Mapping[str, DataFrame], keys: list[str]
) -> DataFrame:
    """Flags and rules per chart and key, each with its tone."""
    table = method_summary(charts, violations).select(*keys, "chart", "method", "flags", "rules")
    return table.withColumns(
        {
            "flags_tone": F.when(F.col("flags") > 0, "critical").otherwise("positive"),
            "rules_tone": F.when(F.col("rules") > 0, "warning").otherwise("positive"),
            "n_charts": F.lit(len(charts)).cast("long"),
        }
    )
