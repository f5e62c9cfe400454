"""Findings: rows that say what a chart shows.

One pass over the points collects the facts of every key (counts per rule, zones,
runs, moments); the findings are then expressions over that table of one row per
key.  Columns of a finding: the chart's keys, generator, category, severity, title,
metric_label, metric_value, detail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.capability import grade
from plumbline.operators.chart import Chart
from plumbline.operators.rules import DESCRIPTIONS, NELSON_DEFAULT, flag_name, with_rules
from plumbline.operators.series import IDX, PHASE, join_keys, medians_of
from plumbline.operators.variables import runs_test

# Thresholds, each of which can be overridden.
STANDARDS = {
    "cpk": 1.33,
    "cpk_marginal": 1.0,
    "max_ooc_percent": 2.0,
    "max_ooc_count": 3,
    "centering": 0.9,
    "runs_z": 1.96,
    "zone_deviation": 0.2,
}
CENTERING_WARNING = 0.78
EXPECTED_ZONE_C = 0.6827
RANK = {"good": 0, "info": 1, "warning": 2, "danger": 3}
# Labels and titles of findings, by severity.
HEALTH = {"good": "Healthy", "info": "Normal", "warning": "Attention", "danger": "Critical"}
TITLES = {
    "stability": {"good": "Process Stable", "warning": "Minor Instability", "danger": "Process Unstable"},
    "capability": {"good": "Capable", "warning": "Marginal Capability", "danger": "Not Capable"},
    "centering": {"good": "Well Centered", "warning": "Off Center", "danger": "Significantly Off Center"},
}
STABLE = "No rule violations detected. Process is in statistical control."
CATEGORIES = ("stability", "capability", "statistical", "pattern")


def standards(overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    unknown = set(overrides or {}) - set(STANDARDS)
    if unknown:
        raise ValueError(f"unknown standards: {sorted(unknown)}")
    return {**STANDARDS, **(overrides or {})}


@dataclass(frozen=True)
class Facts:
    """One row per key, and what is known about it."""

    df: DataFrame
    keys: list[str]
    rules: tuple[str, ...]
    limits: Mapping[str, float] = field(default_factory=standards)
    has_phases: bool = False
    has_capability: bool = False


def zone_aggregates() -> dict[str, Column]:
    """Points per zone: C within 1 sigma, B within 2, A within 3, beyond."""
    distance = F.abs(F.col("value") - F.col("zone_cl")) / F.col("zone_sigma")
    d = F.when((F.col("zone_sigma") > 0) & F.col("value").isNotNull(), distance)
    return {
        "zone_n": F.count(d),
        "zone_c": F.count_if(d <= 1),
        "zone_b": F.count_if((d > 1) & (d <= 2)),
        "zone_a": F.count_if((d > 2) & (d <= 3)),
        "beyond": F.count_if(d > 3),
    }


def facts(
    chart: Chart,
    *,
    nelson: Iterable[int] = NELSON_DEFAULT,
    westgard: Iterable[str] = (),
    custom: Mapping[int, Mapping[str, int]] | None = None,
    capability: DataFrame | None = None,
    phases: DataFrame | None = None,
    overrides: Mapping[str, float] | None = None,
) -> Facts:
    nelson, westgard = tuple(nelson), tuple(westgard)
    rules = (*map(str, nelson), *westgard)
    keys = chart.keys
    above = F.col("value") > F.col("zone_cl")
    before = lambda w: {
        "_was": F.lag("value").over(w) > F.lag("zone_cl").over(w)
    }
    seq = with_rules(chart, nelson, westgard, custom, also=before)
    turned = (F.col(IDX) == 0) | (F.col("_was") != above)
    aggregates = {
        "points": F.count("value"),
        "mean": F.avg("value"),
        "std": F.coalesce(F.stddev_samp("value"), F.lit(0.0)),
        "min": F.min("value"),
        "max": F.max("value"),
        "n_above": F.count_if(above),
        "n_below": F.count_if(~above),
        "n_runs": F.count_if(turned),
        **zone_aggregates(),
        **{flag_name(r): F.count_if(F.col(flag_name(r))) for r in rules},
    }
    if not seq.blocked:
        aggregates["median"] = F.median("value")
    table = seq.df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    if seq.blocked:
        table = join_keys(table, medians_of(seq.df, keys, "value", "median", blocked=True), keys)
    params = chart.params
    if "center" not in params.columns:
        params = params.withColumn("center", F.lit(None).cast("double"))
    table = join_keys(
        table, params.select(*keys, "center", "sigma_hat", "method", "n_used"), keys
    )
    table = runs_test(table)
    if capability is not None:
        table = join_keys(table, capability.select(*keys, "cp", "cpk", "pp", "ppk"), keys)
    if phases is not None:
        # against the phase before, in order of appearance
        table = join_keys(table, phases.select(*keys, "phase_rank"), keys)
        w = Window.partitionBy(*[k for k in keys if k != PHASE]).orderBy("phase_rank")
        table = table.withColumns(
            {
                "from_phase": F.lag(PHASE).over(w),
                "from_center": F.lag("center").over(w),
                "from_sigma": F.lag("sigma_hat").over(w),
            }
        )
    return Facts(table, keys, rules, standards(overrides), phases is not None,
                 capability is not None)


def _entry(generator: str, category: str, severity, title, label: str, value: Column,
           detail: Column) -> Column:
    def text(v) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        F.lit(generator).alias("generator"),
        F.lit(category).alias("category"),
        text(severity).alias("severity"),
        text(title).alias("title"),
        F.lit(label).alias("metric_label"),
        value.cast("double").alias("metric_value"),
        detail.alias("detail"),
    )


def _title(generator: str, severity: Column) -> Column:
    by_severity = TITLES[generator]
    return (
        F.when(severity == "good", by_severity["good"])
        .when(severity == "warning", by_severity["warning"])
        .otherwise(by_severity["danger"])
    )


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0]) if columns else F.lit(0)


def stability(f: Facts) -> list[Column]:
    counts = [F.col(flag_name(r)) for r in f.rules]
    flags = _total(counts)
    fired = _total([(c > 0).cast("int") for c in counts])
    percent = F.coalesce(F.try_divide(flags, F.col("points")) * 100.0, F.lit(0.0))
    minor = (
        (fired <= 2)
        & (flags <= f.limits["max_ooc_count"])
        & (percent <= f.limits["max_ooc_percent"])
    )
    severity = F.when(flags == 0, "good").when(minor, "warning").otherwise("danger")
    detail = F.when(flags == 0, STABLE).otherwise(
        F.format_string("%d rules triggered across %d points", fired, flags)
    )
    title = _title("stability", severity)
    return [_entry("stability", "stability", severity, title, "OOC Points", flags, detail)]


def per_rule(f: Facts) -> list[Column]:
    return [
        F.when(
            F.col(flag_name(r)) > 0,
            _entry("rule", "stability", "danger" if r == "1" else "warning", f"Rule {r}", "Points",
                   F.col(flag_name(r)), F.lit(DESCRIPTIONS[r])),
        )
        for r in f.rules
    ]


def phase_shift(f: Facts) -> list[Column]:
    if not f.has_phases:
        return []
    shift = F.col("center") - F.col("from_center")
    before = F.col("from_sigma")
    sigmas = F.when(before > 0, F.abs(shift) / before).otherwise(0.0)
    severity = F.when(sigmas > 1.5, "danger").when(sigmas > 0.5, "warning").otherwise("info")
    change = F.when(
        before > 0, (F.coalesce("sigma_hat", F.lit(0.0)) - before) / before * 100.0
    ).otherwise(0.0)
    detail = F.format_string("%s → %s: sigma %+.1f%%", "from_phase", PHASE, change)
    return [
        F.when(
            shift.isNotNull(),
            _entry("phase_shift", "stability", severity, "Phase Shift", "Mean Shift", shift, detail),
        )
    ]


def capability_verdict(f: Facts) -> list[Column]:
    if not f.has_capability:
        return []
    g = grade(F.col("cpk"), f.limits["cpk"], f.limits["cpk_marginal"])
    severity = F.when(g == "good", "good").when(g == "marginal", "warning").otherwise("danger")
    title = _title("capability", severity)
    detail = F.format_string("Cp %.2f, Cpk %.2f, Pp %.2f, Ppk %.2f", "cp", "cpk", "pp", "ppk")
    entry = _entry("capability", "capability", severity, title, "Cpk", F.col("cpk"), detail)
    return [F.when(F.col("cpk").isNotNull(), entry)]


def centering(f: Facts) -> list[Column]:
    if not f.has_capability:
        return []
    ratio, good = F.try_divide("cpk", "cp"), f.limits["centering"]
    low = good * CENTERING_WARNING
    severity = F.when(ratio >= good, "good").when(ratio >= low, "warning").otherwise("danger")
    title = _title("centering", severity)
    detail = F.format_string("Cpk/Cp ratio: %.0f%%", ratio * 100.0)
    entry = _entry("centering", "capability", severity, title, "Cpk/Cp", ratio, detail)
    return [F.when(ratio.isNotNull(), entry)]


def statistics_summary(f: Facts) -> list[Column]:
    detail = F.format_string(
        "N=%d, Mean=%.4f, Std=%.4f, Median=%.4f, Range=[%.4f, %.4f].",
        "points", "mean", "std", "median", "min", "max",
    )
    entry = _entry("statistics", "statistical", "info", "Summary Statistics", "N",
                   F.col("points"), detail)
    return [F.when(F.col("points") > 0, entry)]


def sigma_note(f: Facts) -> list[Column]:
    detail = F.format_string("Estimated via %s using %d observations.", "method", "n_used")
    entry = _entry("sigma_method", "statistical", "info", "Sigma Method", "sigma",
                   F.col("sigma_hat"), detail)
    return [F.when(F.col("sigma_hat").isNotNull(), entry)]


def zone_distribution(f: Facts) -> list[Column]:
    def share(c: str) -> Column:
        return F.try_divide(F.col(c), F.col("zone_n"))

    inner = share("zone_c")
    off = F.abs(inner - EXPECTED_ZONE_C) > f.limits["zone_deviation"]
    detail = F.format_string(
        "Zone C: %.1f%%, B: %.1f%%, A: %.1f%%, Beyond: %.1f%%.",
        *[share(c) * 100.0 for c in ("zone_c", "zone_b", "zone_a", "beyond")],
    )
    entry = _entry("zones", "statistical", F.when(off, "warning").otherwise("info"),
                   "Zone Distribution", "Zone C", inner, detail)
    return [F.when(F.col("zone_n") > 0, entry)]


def runs_detection(f: Facts) -> list[Column]:
    """Runs above / not above the centre (ties count as below), from ten points up."""
    z, bound = F.col("z"), f.limits["runs_z"]
    title = (
        F.when(z < -bound, "Shift Pattern").when(z > bound, "Oscillation Pattern")
        .otherwise("Runs Normal")
    )
    severity = F.when(F.abs(z) > bound, "warning").otherwise("info")
    detail = F.format_string("%d runs observed, %.1f expected. Z=%.2f.", "n_runs",
                             "expected_runs", "z")
    entry = _entry("runs", "pattern", severity, title, "Runs", F.col("n_runs"), detail)
    return [F.when((F.col("points") >= 10) & z.isNotNull(), entry)]


# Rules that are patterns of their own.
PATTERNS = {
    "3": ("trend", "Trend Detected"),
    "7": ("stratification", "Stratification"),
    "8": ("mixture", "Mixture Pattern"),
}


def patterns(f: Facts) -> list[Column]:
    return [
        F.when(
            F.col(flag_name(r)) > 0,
            _entry(name, "pattern", "warning", title, "Points", F.col(flag_name(r)),
                   F.lit(DESCRIPTIONS[r])),
        )
        for r, (name, title) in PATTERNS.items()
        if r in f.rules
    ]


GENERATORS: dict[str, Callable[[Facts], list[Column]]] = {
    "stability": stability,
    "rule": per_rule,
    "phase_shift": phase_shift,
    "capability": capability_verdict,
    "centering": centering,
    "statistics": statistics_summary,
    "sigma_method": sigma_note,
    "zones": zone_distribution,
    "runs": runs_detection,
    "patterns": patterns,
}


def findings(f: Facts, generators: Iterable[str] = tuple(GENERATORS)) -> DataFrame:
    """The findings of the chosen generators, one row each."""
    unknown = set(generators) - set(GENERATORS)
    if unknown:
        raise ValueError(f"unknown generators: {sorted(unknown)}")
    entries = [entry for g in generators for entry in GENERATORS[g](f)]
    if not entries:
        raise ValueError("the chosen generators need phases or capability")
    return f.df.select(*f.keys, F.inline(F.array_compact(F.array(*entries))))


def health(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Worst severity, counts and key figures per key, and findings per category."""
    rank = F.lit(0)
    for name, value in RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)

    def figure(generator: str) -> Column:
        return F.max(F.when(F.col("generator") == generator, F.col("metric_value")))

    table = findings.withColumn("_rank", rank).groupBy(*keys).agg(
        F.max_by("severity", "_rank").alias("severity"),
        F.count_if(F.col("severity") == "danger").alias("n_danger"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        figure("stability").alias("ooc_count"),
        figure("capability").alias("cpk"),
        figure("statistics").alias("n"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES],
    )
    labels = F.create_map(*[F.lit(v) for pair in HEALTH.items() for v in pair])
    return table.withColumn("label", F.element_at(labels, F.col("severity")))
