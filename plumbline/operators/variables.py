"""Variables charts: individuals, subgroup means and dispersions, run chart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions.quantiles import normal_two_sided
from plumbline.operators.chart import (
    MR_DIVISOR,
    Chart,
    build,
    estimating_range,
    individuals,
    moving_range,
    one_of,
    positive,
    used,
    zone_lines,
)
from plumbline.operators.series import IDX, Roles, Sequence, join_keys
from plumbline.operators.subgroups import estimated, subgroups, typical_size

INDIVIDUAL_SIGMA = ("moving_range", "median_moving_range", "levey_jennings", "range", "stddev")


def band(center: str, half, *, floor_zero: bool = False) -> dict:
    lower = F.col(center) - half
    return {
        "ucl": F.col(center) + half,
        "cl": F.col(center) + F.lit(0.0),
        "lcl": F.greatest(lower, F.lit(0.0)) if floor_zero else lower,
    }


def imr(
    df: DataFrame,
    roles: Roles,
    *,
    k_sigma: float = 3.0,
    sigma_method: str = "moving_range",
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Individuals and moving ranges.

    With ``sigma_method`` range or stddev the chart falls back to subgroup means
    with limits at +-k sigma (not divided by the root of the subgroup size).
    """
    positive(k_sigma, "k_sigma")
    one_of(sigma_method, INDIVIDUAL_SIGMA, "sigma_method")
    if sigma_method in ("range", "stddev"):
        return _subgroup_fallback(df, roles, k_sigma, sigma_method, missing, sizing)
    if sigma_method == "levey_jennings":
        seq = individuals(df, roles, missing=missing, **sizing)
        return _overall(seq, roles, k_sigma, "imr")
    seq = moving_range(individuals(df, roles, missing=missing, **sizing))
    seq, ranges = estimating_range(seq, roles)
    aggregates = {
        "center": F.avg(used("value", roles)),
        "mr_bar": F.avg(ranges),
        "n_used": F.count(ranges),
        "n": F.count(used("value", roles)),
    }
    medians, sigma = None, F.col("mr_bar") / MR_DIVISOR
    if sigma_method == "median_moving_range":
        medians, sigma = {"mr_median": ranges}, F.col("mr_median") / k.MEDIAN_MR_DIVISOR
    return build(
        "imr",
        seq,
        aggregates,
        {"sigma_hat": sigma, "method": F.lit(sigma_method)},
        {**band("center", k_sigma * F.col("sigma_hat")), **zone_lines("center", "sigma_hat")},
        k_sigma=k_sigma,
        medians=medians,
        secondary=lambda s: _range_part(s, k_sigma, 2),
    )


def _range_part(seq: Sequence, k_sigma: float, span: int) -> Sequence:
    """Moving ranges with their own limits; the first span - 1 rows have none."""
    center = k.constant("d2", span) * F.col("sigma_hat")
    half = k_sigma * k.constant("d3", span) * F.col("sigma_hat")
    rows = seq.df.where(F.col(IDX) >= span - 1).withColumns(
        {
            IDX: F.col(IDX) - (span - 1),
            "value": F.col("mr"),
            "ucl": center + half,
            "cl": center,
            "lcl": F.greatest(center - half, F.lit(0.0)),
        }
    )
    return seq.with_df(rows)


def _overall(seq: Sequence, roles: Roles, k_sigma: float, kind: str) -> Chart:
    value = used("value", roles)
    return build(
        kind,
        seq,
        {"center": F.avg(value), "sigma_hat": F.stddev_samp(value), "n_used": F.count(value),
         "n": F.count(value)},
        {"method": F.lit("levey_jennings")},
        {**band("center", k_sigma * F.col("sigma_hat")), **zone_lines("center", "sigma_hat")},
        k_sigma=k_sigma,
    )


def _subgroup_fallback(df, roles, k_sigma, method, missing, sizing) -> Chart:
    spread, divisor = ("range", k.d2) if method == "range" else ("std", k.c4)
    seq = subgroups(df, roles, ("mean", spread), missing=missing, **sizing)
    seq = seq.with_columns({"value": F.col("mean")})
    estimate = _spread_estimate(spread, divisor, roles)
    return build(
        "imr",
        seq,
        {"center": F.avg(estimated("mean", roles)), "sigma_hat": F.avg(estimate), "n_used": F.count(estimate)},
        {"method": F.lit(method)},
        {**band("center", k_sigma * F.col("sigma_hat")), **zone_lines("center", "sigma_hat")},
        k_sigma=k_sigma,
        extra_columns=("subgroup",),
    )


def levey_jennings(
    df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, missing: str = "drop", **sizing
) -> Chart:
    """Mean +- k overall sample standard deviations."""
    positive(k_sigma, "k_sigma")
    seq = individuals(df, roles, missing=missing, **sizing)
    return _overall(seq, roles, k_sigma, "levey_jennings")


def mr(
    df: DataFrame,
    roles: Roles,
    *,
    span: int = 2,
    k_sigma: float = 3.0,
    sigma_method: str = "moving_range",
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Moving ranges over ``span`` values; n - span + 1 points."""
    positive(k_sigma, "k_sigma")
    one_of(sigma_method, ("moving_range", "median_moving_range"), "sigma_method")
    if sigma_method == "median_moving_range" and span != 2:
        raise ValueError("the median moving range is defined for span 2")
    seq = moving_range(individuals(df, roles, missing=missing, **sizing), span)
    seq, ranges = estimating_range(seq, roles, span)
    medians, sigma = None, F.col("mr_bar") / k.constant("d2", span)
    if sigma_method == "median_moving_range":
        medians, sigma = {"mr_median": ranges}, F.col("mr_median") / k.MEDIAN_MR_DIVISOR
    scale = k.constant("d3", span)
    return build(
        "mr",
        seq,
        {"mr_bar": F.avg(ranges), "n_used": F.count(ranges)},
        [{"sigma_hat": sigma, "method": F.lit(sigma_method)},
         {"center": k.constant("d2", span) * F.col("sigma_hat")}],
        {},
        k_sigma=k_sigma,
        medians=medians,
        finish=lambda s: _range_part(s, k_sigma, span).with_columns(
            zone_lines("mr_bar", scale * F.col("sigma_hat"))
        ),
    )


def _spread_estimate(spread: str, divisor, roles: Roles):
    """Sigma of a subgroup of two rows or more."""
    n = F.col(estimated("n", roles))
    return F.when(n >= 2, F.col(estimated(spread, roles)) / divisor(n))


def _dispersion(df, roles, statistic: str, missing, sizing) -> tuple[Sequence, dict]:
    """Subgroups with sigma from their ranges or deviations (sizes >= 2 only)."""
    spread, divisor = ("range", k.d2) if statistic == "range" else ("std", k.c4)
    seq = subgroups(df, roles, ("mean", spread), missing=missing, **sizing)
    estimate = _spread_estimate(spread, divisor, roles)
    return seq, {"sigma_hat": F.avg(estimate), "n_used": F.count(estimate)}


def _dispersion_lines(statistic: str, k_sigma: float) -> dict:
    n = F.col("n")
    low, wide = (k.d2(n), k.d3(n)) if statistic == "range" else (k.c4(n), k.c5(n))
    center, half = low * F.col("sigma_hat"), k_sigma * wide * F.col("sigma_hat")
    return {
        "ucl": center + half,
        "cl": center,
        "lcl": F.greatest(center - half, F.lit(0.0)),
    }


def _xbar(kind: str, statistic: str, df, roles, k_sigma, zone_scale, missing, sizing) -> Chart:
    positive(k_sigma, "k_sigma")
    one_of(zone_scale, ("point", "mean"), "zone_scale")
    seq, sigma = _dispersion(df, roles, statistic, missing, sizing)
    column = "range" if statistic == "range" else "std"
    zone_sigma = F.col("sigma_hat")
    if zone_scale == "mean":
        zone_sigma = zone_sigma / F.sqrt(F.col("harmonic_n"))
    return build(
        kind,
        seq,
        {"center": F.avg(estimated("mean", roles)), "inverse_n": F.avg(1.0 / F.col(estimated("n", roles))), **sigma},
        {"method": F.lit(statistic), "harmonic_n": 1.0 / F.col("inverse_n")},
        {
            "value": F.col("mean"),
            **band("center", k_sigma * F.col("sigma_hat") / F.sqrt("n")),
            **zone_lines(F.col("center"), zone_sigma),
        },
        k_sigma=k_sigma,
        secondary=lambda s: s.with_columns(
            {"value": F.col(column), **_dispersion_lines(statistic, k_sigma)}
        ),
        extra_columns=("subgroup", "n"),
    )


def xbar_r(df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, zone_scale: str = "point",
           missing: str = "drop", **sizing) -> Chart:
    """Subgroup means with sigma from ranges.

    Zones use sigma of a single observation unless ``zone_scale="mean"``.
    """
    return _xbar("xbar_r", "range", df, roles, k_sigma, zone_scale, missing, sizing)


def xbar_s(df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, zone_scale: str = "point",
           missing: str = "drop", **sizing) -> Chart:
    """Subgroup means with sigma from standard deviations."""
    return _xbar("xbar_s", "stddev", df, roles, k_sigma, zone_scale, missing, sizing)


def _spread_chart(kind: str, statistic: str, df, roles, k_sigma, missing, sizing) -> Chart:
    positive(k_sigma, "k_sigma")
    seq, sigma = _dispersion(df, roles, statistic, missing, sizing)
    column, wide = ("range", k.d3) if statistic == "range" else ("std", k.c5)
    seq = seq.beside(typical_size(seq, estimated("n", roles)).withColumnRenamed("typical_n", "_typical"))
    return build(
        kind,
        seq,
        {"center": F.avg(estimated(column, roles)), "typical_n": F.max("_typical"), **sigma},
        [{"method": F.lit(statistic)},
         {"zone_spread": wide(F.col("typical_n")) * F.col("sigma_hat")}],
        {
            "value": F.col(column),
            **_dispersion_lines(statistic, k_sigma),
            **zone_lines("center", "zone_spread"),
        },
        k_sigma=k_sigma,
        extra_columns=("subgroup", "n"),
    )


def r(df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, missing: str = "drop",
      **sizing) -> Chart:
    """Subgroup ranges."""
    return _spread_chart("r", "range", df, roles, k_sigma, missing, sizing)


def s(df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, missing: str = "drop",
      **sizing) -> Chart:
    """Subgroup standard deviations."""
    return _spread_chart("s", "stddev", df, roles, k_sigma, missing, sizing)


def count_runs(seq: Sequence, side: str) -> DataFrame:
    """Runs of equal non-zero ``side`` (+1 / -1) per key; zeros are passed over."""
    if not seq.blocked:
        back = Window.partitionBy(*seq.keys).orderBy(IDX)
        previous = F.lag(side).over(back)
        kept = seq.df.where(F.col(side) != 0).withColumn(
            "_turn", F.when(previous.isNull() | (previous != F.col(side)), 1).otherwise(0)
        )
        return kept.groupBy(*seq.keys).agg(F.sum("_turn").alias("n_runs"))
    # Per block: turns inside it, and its first and last side for the seams.
    cut, w = seq._cut()._own().where(F.col(side) != 0), seq._block_window()
    previous = F.lag(side).over(w)
    turn = F.when(previous != F.col(side), 1).otherwise(0)
    blocks = (
        cut.withColumn("_turn", turn)
        .groupBy(*seq.keys, "_block")
        .agg(
            F.sum("_turn").alias("_turns"),
            F.min_by(side, IDX).alias("_first"),
            F.max_by(side, IDX).alias("_last"),
        )
    )
    left = F.lag("_last").over(Window.partitionBy(*seq.keys).orderBy("_block"))
    seam = F.when(left.isNull() | (left != F.col("_first")), 1).otherwise(0)
    return (
        blocks.withColumn("_turns", F.col("_turns") + seam)
        .groupBy(*seq.keys)
        .agg(F.sum("_turns").alias("n_runs"))
    )


def run_chart(
    df: DataFrame,
    roles: Roles,
    *,
    center_method: str = "median",
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Runs about the centre, with their expectation and two-sided p-value.

    Excluded rows count in no run.  The chart has no limits of its own; lines at +-k sigma from moving ranges keep
    the rules quiet.
    """
    one_of(center_method, ("median", "mean"), "center_method")
    positive(k_sigma, "k_sigma")
    seq = individuals(df, roles, missing=missing, **sizing).with_columns({"observed": used("value", roles)})
    seq, ranges = estimating_range(seq, roles)
    aggregates = {"mr_bar": F.avg(ranges), "n_used": F.count("observed")}
    medians = {"center": "observed"} if center_method == "median" else None
    if medians is None:
        aggregates["center"] = F.avg("observed")
    sigma = F.when(F.col("mr_bar") > 0, F.col("mr_bar") / MR_DIVISOR).otherwise(1.0)
    chart = build(
        "run",
        seq,
        aggregates,
        {"sigma_hat": sigma, "method": F.lit("run_chart")},
        {**band("center", k_sigma * F.col("sigma_hat")), **zone_lines("center", "sigma_hat")},
        k_sigma=k_sigma,
        medians=medians,
    )
    side = F.when(F.col("observed") > F.col("cl"), 1).when(F.col("observed") < F.col("cl"), -1)
    sided = chart.sequence.with_columns({"_side": side.otherwise(0)})
    sides = sided.df.groupBy(*seq.keys).agg(
        F.count_if(F.col("_side") == 1).alias("n_above"),
        F.count_if(F.col("_side") == -1).alias("n_below"),
    )
    params = join_keys(chart.params, sides, seq.keys)
    params = join_keys(params, count_runs(sided, "_side"), seq.keys)
    return Chart("run", seq.keys, runs_test(params), chart.sequence, k_sigma)


def runs_test(params: DataFrame) -> DataFrame:
    """Expected runs, z and p from n_above, n_below, n_runs; p is 1 where undefined."""
    a, b = F.col("n_above").cast("double"), F.col("n_below").cast("double")
    total, twice = a + b, 2.0 * a * b
    variance = twice * (twice - total) / (total * total * (total - 1.0))
    two_sided = (a > 0) & (b > 0)
    return (
        params.withColumns(
            {
                "n_runs": F.coalesce(F.col("n_runs"), F.lit(0)).cast("long"),
                "expected_runs": F.when(total == 0, 0.0)
                .when(~two_sided, 1.0)
                .otherwise(F.try_divide(twice, total) + 1.0),
                "_variance": F.when(two_sided & (total > 1), variance),
            }
        )
        .withColumn(
            "z",
            F.when(
                F.col("_variance") > 0,
                (F.col("n_runs") - F.col("expected_runs")) / F.sqrt("_variance"),
            ),
        )
        .withColumn("p_value", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))
        .drop("_variance")
    )


def three_way(
    df: DataFrame,
    roles: Roles,
    *,
    within_method: str = "range",
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Subgroup means against between + within variation.

    Within limits for ranges always use 3 sigma, those for deviations use k.
    """
    positive(k_sigma, "k_sigma")
    one_of(within_method, ("range", "stddev"), "within_method")
    seq, sigma = _dispersion(df, roles, within_method, missing, sizing)
    column = "range" if within_method == "range" else "std"
    seq, ranges = estimating_range(seq, roles, value=estimated("mean", roles))
    within = F.coalesce(F.col("sigma_w"), F.lit(0.0))
    nominal = F.greatest(F.rint("harmonic_n"), F.lit(2.0)).cast("int")
    steps = [
        {
            "harmonic_n": 1.0 / F.col("inverse_n"),
            "sigma_within": within,
            "sigma_mr": F.col("mr_bar") / MR_DIVISOR,
        },
        {
            "sigma_between": F.sqrt(
                F.greatest(
                    F.col("sigma_mr") ** 2 - F.col("sigma_within") ** 2 / F.col("harmonic_n"),
                    F.lit(0.0),
                )
            )
        },
        {
            "sigma_hat": F.sqrt(F.col("sigma_within") ** 2 + F.col("sigma_between") ** 2),
            "nominal_n": nominal,
            "method": F.lit("three_way"),
        },
    ]
    return build(
        "three_way",
        seq,
        {
            "center": F.avg(estimated("mean", roles)),
            "inverse_n": F.avg(1.0 / F.col(estimated("n", roles))),
            "mr_bar": F.avg(ranges),
            "n_used": F.count(estimated("mean", roles)),
            "sigma_w": sigma["sigma_hat"],
        },
        steps,
        {
            "value": F.col("mean"),
            **band("center", k_sigma * F.col("sigma_hat") / F.sqrt("harmonic_n")),
            **zone_lines("center", "sigma_hat"),
        },
        k_sigma=k_sigma,
        secondary=lambda s: s.with_columns(_within_lines(column, within_method, k_sigma)),
        extra_columns=("subgroup", "n"),
    )


def _within_lines(column: str, method: str, k_sigma: float) -> dict:
    n, sigma = F.col("nominal_n"), F.col("sigma_within")
    if method == "range":
        center = sigma * k.d2(n)
        spread = 3.0 * k.d3(n) / k.d2(n)
        upper, lower = center * (1.0 + spread), center * F.greatest(1.0 - spread, F.lit(0.0))
    else:
        center = sigma * k.c4(n)
        half = k_sigma * sigma * F.sqrt(1.0 - k.c4(n) ** 2)
        upper, lower = center + half, F.greatest(center - half, F.lit(0.0))
    return {"value": F.col(column), "ucl": upper, "cl": center, "lcl": lower}


def presummarize(
    df: DataFrame,
    roles: Roles,
    *,
    target: float,
    sigma: float,
    summary_stat: str = "mean",
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Subgroup summaries against a known target and sigma."""
    positive(k_sigma, "k_sigma")
    positive(sigma, "sigma")
    one_of(summary_stat, ("mean", "median", "individual"), "summary_stat")
    if not math.isfinite(target):
        raise ValueError("target must be finite")
    if summary_stat == "individual":
        seq = individuals(df, roles, missing=missing, **sizing)
        seq = seq.with_columns({"n": F.lit(1).cast("long"), "summary": F.col("value")})
    else:
        seq = subgroups(df, roles, ("mean",), missing=missing,
                        median=summary_stat == "median", **sizing)
        seq = seq.with_columns({"summary": F.col(summary_stat)})
    half = k_sigma * sigma / F.sqrt("n")
    return build(
        "presummarize",
        seq,
        {"n_points": F.count("summary")},
        {
            "center": F.lit(float(target)),
            "sigma_hat": F.lit(float(sigma)),
            "method": F.lit("levey_jennings"),
            "n_used": F.lit(0).cast("long"),
        },
        {
            "value": F.col("summary"),
            **band("center", half),
            **zone_lines("center", "sigma_hat"),
        },
        k_sigma=k_sigma,
        extra_columns=("n",) if summary_stat == "individual" else ("subgroup", "n"),
    )
