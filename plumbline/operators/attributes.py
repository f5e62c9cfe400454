"""Attribute charts: p, np, c, u and the Laney adjusted p' and u'.

Per subgroup, x is the sum of the values and n the number of rows (or a fixed
number of trials).  Means of the per-point sigmas are closed forms of the mean
(inverse) root of n, so one aggregation gives every parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chart import (
    MR_DIVISOR,
    Chart,
    build,
    estimating_range,
    one_of,
    positive,
    zone_lines,
)
from plumbline.operators.series import Roles, Sequence
from plumbline.operators.subgroups import estimated, subgroups

KINDS = ("p", "np", "c", "u", "laney_p", "laney_u")


def binomial_sigma(rate: Column, n: Column) -> Column:
    return F.sqrt(rate * (1.0 - rate) / n)


def poisson_sigma(rate: Column, n: Column) -> Column:
    return F.sqrt(rate / n)


def binomial_limits(rate: Column, n: Column, width: Column | float) -> dict[str, Column]:
    half = width * binomial_sigma(rate, n)
    return {
        "ucl": F.least(rate + half, F.lit(1.0)),
        "cl": rate,
        "lcl": F.greatest(rate - half, F.lit(0.0)),
    }


def poisson_limits(rate: Column, n: Column, width: Column | float) -> dict[str, Column]:
    half = width * poisson_sigma(rate, n)
    return {"ucl": rate + half, "cl": rate, "lcl": F.greatest(rate - half, F.lit(0.0))}


def attribute_counts(
    df: DataFrame, roles: Roles, *, n_trials: float | None = None, missing: str = "drop", **sizing
) -> Sequence:
    """Numbered subgroups with ``x`` and ``n``; with excluded rows also those of the others."""
    seq = subgroups(df, roles, ("total",), missing=missing, **sizing)
    n = F.lit(positive(n_trials, "n_trials")) if n_trials is not None else F.col("n").cast("double")
    if roles.excluded is None:
        return seq.with_columns({"n": n, "x": F.col("total")})
    some = F.when(F.col("used_n").isNotNull(), n if n_trials is not None else F.col("used_n").cast("double"))
    return seq.with_columns({"n": n, "x": F.col("total"), "used_n": some, "used_x": F.col("used_total")})


def attribute(
    kind: str,
    df: DataFrame,
    roles: Roles,
    *,
    n_trials: float | None = None,
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    one_of(kind, KINDS, "kind")
    positive(k_sigma, "k_sigma")
    seq = attribute_counts(df, roles, n_trials=n_trials, missing=missing, **sizing)
    rate, n, x = F.col("rate"), F.col("n"), F.col("x")
    some_n, some_x = estimated("n", roles), estimated("x", roles)
    binomial = kind in ("p", "np", "laney_p")
    unit = F.sqrt(rate * (1.0 - rate)) if binomial else F.sqrt(rate)
    aggregates = {
        "sum_x": F.sum(some_x),
        "sum_n": F.sum(some_n),
        "n_bar": F.avg(some_n),
        "root_n": F.avg(F.sqrt(some_n)),
        "inverse_root_n": F.avg(1.0 / F.sqrt(some_n)),
        "n_used": F.count(some_n),
    }
    if kind in ("np", "c"):
        half = k_sigma * unit * F.sqrt("n")
        lines = {
            "value": x,
            "ucl": F.least(n * rate + half, n) if binomial else n * rate + half,
            "cl": n * rate,
            "lcl": F.greatest(n * rate - half, F.lit(0.0)),
        }
        derived = {"center": rate * F.col("n_bar"), "sigma_hat": unit * F.col("root_n")}
    else:
        width = F.lit(float(k_sigma))
        derived = {"center": rate + F.lit(0.0), "sigma_hat": unit * F.col("inverse_root_n")}
        if kind.startswith("laney"):
            seq, ranges = _residual_ranges(seq, roles, binomial)
            aggregates["z_mr_bar"] = F.avg(ranges)
            derived["sigma_z"] = F.col("z_mr_bar") / MR_DIVISOR
            width = width * F.col("sigma_z")
        limits = binomial_limits if binomial else poisson_limits
        lines = {"value": x / n, **limits(rate, n, width)}
    return build(
        kind,
        seq,
        aggregates,
        [{"rate": F.col("sum_x") / F.col("sum_n")}, {**derived, "method": F.lit(kind)}],
        {**lines, **zone_lines("center", "sigma_hat")},
        k_sigma=k_sigma,
        extra_columns=("subgroup", "n"),
    )


def _residual_ranges(seq: Sequence, roles: Roles, binomial: bool) -> tuple[Sequence, str]:
    """|z_i - z_(i-1)| of standardized residuals (sigma 1 where it is 0)."""
    n, x = F.col(estimated("n", roles)), F.col(estimated("x", roles))
    seq = seq.attach({"_x": F.sum(x), "_n": F.sum(n)})
    seq = seq.with_columns({"_rate": F.col("_x") / F.col("_n")})
    sigma = (binomial_sigma if binomial else poisson_sigma)(F.col("_rate"), n)
    z = (x / n - F.col("_rate")) / F.when(sigma > 0, sigma).otherwise(1.0)
    seq, ranges = estimating_range(seq.with_columns({"_z": z}), roles, value="_z", name="z_mr")
    return seq.drop("_z", "_rate", "_x", "_n"), ranges
