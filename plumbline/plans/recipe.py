"""From a recipe to a full analysis: phases, chart, rules, capability, findings.

Everything returned is lazy; each table is its own Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import (
    attributes,
    multivariate,
    rare_events,
    short_run,
    time_weighted,
    variables,
)
from plumbline.operators.capability import NOT_CAPABLE_KINDS, capability
from plumbline.operators.chart import Chart, excluded_flag
from plumbline.operators.findings import facts, findings, health
from plumbline.operators.rules import (
    NELSON_DEFAULT,
    violation_counts,
    violations,
)
from plumbline.operators.series import IDX, PHASE, Roles, join_keys
from plumbline.operators.subgroups import axis_labels, phase_table

CHARTS: dict[str, Callable[..., Chart]] = {
    "imr": variables.imr,
    "xbar_r": variables.xbar_r,
    "xbar_s": variables.xbar_s,
    "r": variables.r,
    "s": variables.s,
    "mr": variables.mr,
    "levey_jennings": variables.levey_jennings,
    "run": variables.run_chart,
    "three_way": variables.three_way,
    "presummarize": variables.presummarize,
    "short_run": short_run.short_run,
    "g": rare_events.g,
    "t": rare_events.t,
    "ewma": time_weighted.ewma,
    "cusum": time_weighted.cusum,
    "cusum_vmask": time_weighted.cusum_vmask,
    "hotelling_t2": multivariate.hotelling_t2,
    "mewma": multivariate.mewma,
}
SUBGROUPED = frozenset(
    {"xbar_r", "xbar_s", "r", "s", "three_way", "presummarize", *attributes.KINDS}
)
KINDS = (*CHARTS, *attributes.KINDS)


def draw(kind: str, df: DataFrame, roles: Roles, **options) -> Chart:
    if kind in attributes.KINDS:
        return attributes.attribute(kind, df, roles, **options)
    if kind not in CHARTS:
        raise ValueError(f"unknown chart {kind!r}; choose from {sorted(KINDS)}")
    return CHARTS[kind](df, roles, **options)


@dataclass(frozen=True)
class Recipe:
    kind: str
    roles: Roles
    options: Mapping = field(default_factory=dict)
    nelson: tuple[int, ...] = NELSON_DEFAULT
    westgard: tuple[str, ...] = ()
    custom_rules: Mapping[int, Mapping[str, int]] | None = None
    usl: float | None = None
    lsl: float | None = None
    exclude: str | None = None


@dataclass(frozen=True)
class Analysis:
    recipe: Recipe
    chart: Chart
    points: DataFrame
    params: DataFrame
    violations: DataFrame
    violation_counts: DataFrame
    capability: DataFrame | None
    phases: DataFrame
    phase_order: DataFrame

    def findings(self, overrides: Mapping[str, float] | None = None) -> DataFrame:
        known = facts(
            self.chart,
            nelson=self.recipe.nelson,
            westgard=self.recipe.westgard,
            custom=self.recipe.custom_rules,
            capability=self.capability,
            phases=self.phase_order,
            overrides=overrides,
        )
        return findings(known)

    def health(self) -> DataFrame:
        return health(self.findings(), self.chart.keys)


def analyze(df: DataFrame, recipe: Recipe) -> Analysis:
    """Run a recipe.  ``exclude`` names a boolean column: rows left out of estimation.

    Excluded rows are charted against the limits of the others, on every kind of chart
    and in one drawing; points have an ``excluded`` column then.  A subgroup is charted
    with all its rows, estimated from without the excluded ones, and excluded itself if
    all its rows are.  The positions of a phase count the points of the chart.
    """
    roles = replace(recipe.roles, excluded=recipe.exclude) if recipe.exclude else recipe.roles
    used = df if roles.excluded is None else df.where(~excluded_flag(roles))
    chart = draw(recipe.kind, df, roles, **recipe.options)
    fired = violations(chart, recipe.nelson, recipe.westgard, recipe.custom_rules)
    able = None
    if recipe.usl is not None and recipe.lsl is not None and recipe.kind not in NOT_CAPABLE_KINDS:
        measured = used
        if recipe.options.get("missing") == "zero":
            measured = used.withColumn(recipe.roles.value, F.coalesce(F.col(recipe.roles.value).cast("double"), F.lit(0.0)))
        able = capability(measured, recipe.roles, chart, recipe.usl, recipe.lsl)
    phases = phase_table(df, recipe.roles, chart.points)
    order = chart.order_column
    points = chart.points_with(order) if order else chart.points
    points = axis_labels(points, subgrouped="subgroup" in points.columns, order=order)
    points = points.drop(order) if order else points
    starts = phases.select(*chart.keys, "start_index")
    points = join_keys(points, starts, chart.keys).withColumn(
        "global_idx", F.col("start_index") + F.col(IDX)
    ).drop("start_index")
    return Analysis(recipe, chart, points, chart.params, fired,
                    violation_counts(fired, chart.keys), able, phases,
                    phase_table(df, recipe.roles))


__all__ = ["CHARTS", "KINDS", "PHASE", "Analysis", "Recipe", "analyze", "draw"]
