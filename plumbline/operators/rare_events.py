"""Rare event charts: counts between events (g) and times between events (t)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.quantiles import NORMAL, chi2_quantile_of
from plumbline.operators.chart import Chart, build_joined, individuals, positive, used, zone_lines
from plumbline.operators.series import Roles, Sequence, attach_row, join_keys
from plumbline.session import durable


def _with_spread(params: DataFrame, k_sigma: float) -> DataFrame:
    """Half-width of the wider side over k: these limits are not symmetric."""
    wide = F.greatest(F.abs(F.col("p_ucl") - F.col("center")), F.abs(F.col("center") - F.col("p_lcl")))
    return params.withColumn("sigma_hat", F.greatest(wide / k_sigma, F.lit(1e-10)))


def _lines() -> dict:
    return {
        "ucl": F.col("p_ucl"),
        "cl": F.col("center"),
        "lcl": F.col("p_lcl"),
        **zone_lines("center", "sigma_hat"),
    }


def g(
    df: DataFrame, roles: Roles, *, k_sigma: float = 3.0, missing: str = "drop", **sizing
) -> Chart:
    """Negative binomial limits through a chi-square with fractional degrees of freedom."""
    positive(k_sigma, "k_sigma")
    seq = individuals(df, roles, missing=missing, **sizing)
    value = used("value", roles)
    over = F.try_divide(F.var_samp(value), F.avg(value)) - 1.0
    params = seq.df.groupBy(*seq.keys).agg(
        F.avg(value).alias("center"),
        F.when(F.avg(value) > 0, F.greatest(F.coalesce(over, F.lit(0.0)), F.lit(0.0)))
        .otherwise(0.0)
        .alias("overdispersion"),
        F.count(value).alias("n_used"),
    )
    tail = NORMAL.cdf(-k_sigma)
    scale = 1.0 + F.col("overdispersion")
    params = params.withColumn("freedom", 2.0 / scale)

    def line(p: float):
        return (chi2_quantile_of(p, F.col("freedom")) * scale - 1.0) / 2.0

    params = params.withColumns(
        {
            "p_ucl": line(1.0 - tail),
            "p_lcl": F.greatest(line(tail), F.lit(0.0)),
            "method": F.lit("g_chart"),
        }
    )
    return build_joined("g", seq, _with_spread(params, k_sigma), _lines(), k_sigma=k_sigma)


def weibull_fit(seq: Sequence, roles: Roles, *, tolerance: float = 1e-10, most_steps: int = 100) -> DataFrame:
    """Maximum likelihood Weibull ``shape`` and ``scale`` per key, location 0, values > 0 only.

    Newton's method on the shape, kept inside the interval in which the likelihood's
    slope changes sign.  Equal values are counted once, whatever the size of a key, and
    each step is one grouped aggregation over the counts of the keys still iterating;
    a key leaves once its step is below ``tolerance`` of the shape.  ``converged`` is
    false for keys that have not after ``most_steps``.  Values are divided by their
    maximum, which keeps powers below 1.  Keys with fewer than two positive values, or
    all equal, get nulls.
    """
    keys = seq.keys
    rows = seq.df.where((F.col("value") > 0) & used(F.lit(True), roles))
    counts = durable(rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    n, lnx = F.col("_n"), F.ln("value")
    total, mean = F.sum(n), F.sum(n * lnx) / F.sum(n)
    deviation = F.sqrt(F.greatest(F.sum(n * lnx * lnx) / total - mean * mean, F.lit(0.0)))
    varied = (total >= 2) & (F.count(F.lit(1)) > 1)
    first = counts.groupBy(*keys).agg(
        total.alias("_total"),
        F.max("value").alias("_top"),
        (mean - F.ln(F.max("value"))).alias("_mean"),
        F.when(varied, F.try_divide(F.lit(math.pi / math.sqrt(6.0)), deviation)).alias("shape"),
    ).withColumns({"_low": F.lit(0.0), "_high": F.lit(math.inf), "scale": F.lit(None).cast("double"), "converged": F.lit(False)})
    first = durable(first)
    known = ["_total", "_top", "_mean", "shape", "_low", "_high"]
    finished, active, step = [first.where(F.col("shape").isNull())], first.where(F.col("shape").isNotNull()), 0
    while step < most_steps and not active.isEmpty():
        y, k = F.col("value") / F.col("_top"), F.col("shape")
        power = n * F.pow(y, k)
        state = active.select(*keys, *known)
        met = attach_row(counts, state.drop(*keys)) if seq.single else join_keys(counts, state, keys, "inner", nulls=seq.nulls)
        sums = met.groupBy(*keys).agg(
            *[F.max(c).alias(c) for c in known],
            F.sum(power).alias("_s0"), F.sum(power * F.ln(y)).alias("_s1"), F.sum(power * F.ln(y) ** 2).alias("_s2"),
        )
        ratio = F.col("_s1") / F.col("_s0")
        slope = -1.0 / (k * k) - (F.col("_s2") / F.col("_s0") - ratio * ratio)
        value = 1.0 / k + F.col("_mean") - ratio
        low, high = F.when(value > 0, k).otherwise(F.col("_low")), F.when(value > 0, F.col("_high")).otherwise(k)
        newton = k - value / slope
        halved = F.when(high == math.inf, 2.0 * k).otherwise((low + high) / 2.0)
        moved = sums.withColumns({
            "_low": low, "_high": high,
            "_next": F.when((newton > low) & (newton < high), newton).otherwise(halved),
            "scale": F.col("_top") * F.pow(F.col("_s0") / F.col("_total"), 1.0 / k),
            "converged": F.abs(newton - k) <= tolerance * k,
        })
        moved = durable(moved.select(*keys, *known, "_next", "scale", "converged"))
        finished.append(moved.where("converged"))
        active = moved.where("not converged").withColumn("shape", F.col("_next"))
        step += 1
    finished.append(active)
    return reduce(DataFrame.unionByName, [t.select(*keys, "shape", "scale", "converged") for t in finished])


def weibull_quantile(p: float):
    return F.col("scale") * F.pow(F.lit(-math.log1p(-p)), 1.0 / F.col("shape"))


def t(
    df: DataFrame,
    roles: Roles,
    *,
    k_sigma: float = 3.0,
    tolerance: float = 1e-10,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Times between events with limits at Weibull quantiles; ``converged`` is a parameter."""
    positive(k_sigma, "k_sigma")
    seq = individuals(df, roles, missing=missing, **sizing)
    sizes = seq.df.groupBy(*seq.keys).agg(F.count(used("value", roles)).alias("n_used"))
    params = join_keys(sizes, weibull_fit(seq, roles, tolerance=tolerance), seq.keys).withColumns(
        {
            "p_ucl": weibull_quantile(NORMAL.cdf(k_sigma)),
            "center": weibull_quantile(0.5),
            "p_lcl": F.greatest(weibull_quantile(NORMAL.cdf(-k_sigma)), F.lit(0.0)),
            "method": F.lit("t_chart"),
        }
    )
    return build_joined("t", seq, _with_spread(params, k_sigma), _lines(), k_sigma=k_sigma)
