"""Time weighted charts: EWMA, tabular CUSUM and the V-mask.

With a subgroup column they chart subgroup means, otherwise single values.
Sigma comes from moving ranges of what is charted.  Excluded rows pass through the
statistics, but neither target nor sigma is estimated from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.chart import (
    MR_DIVISOR,
    Chart,
    estimating_range,
    individuals,
    positive,
    used,
    zone_lines,
)
from plumbline.operators.series import (
    BLOCK,
    IDX,
    Roles,
    Sequence,
    scanned_blocks,
)
from plumbline.operators.subgroups import estimated, subgroups
from plumbline.session import durable


def charted_values(df: DataFrame, roles: Roles, *, missing: str = "drop", **sizing) -> Sequence:
    """Subgroup means, or single values with n = 1."""
    if roles.subgroup is None:
        seq = individuals(df, roles, missing=missing, **sizing)
        return seq.with_columns({"n": F.lit(1).cast("long")})
    seq = subgroups(df, roles, ("mean",), missing=missing, **sizing)
    return seq.with_df(seq.df.withColumnRenamed("mean", "value"))


def _fitted(seq: Sequence, roles: Roles, target: float | None, sigma: float | None) -> tuple[Sequence, DataFrame]:
    """Target and sigma on every row, and the parameter table."""
    value, n = ("value", "n") if roles.subgroup is None else (estimated("mean", roles), estimated("n", roles))
    value = "value" if value == "mean" else value
    seq, ranges = estimating_range(seq, roles, value=value)
    aggregates = {
        "mean": F.avg(used(value, roles)),
        "mr_bar": F.avg(ranges),
        "n_used": F.count(ranges),
        "n_bar": F.avg(used(n, roles)),
    }
    derived = {
        "target": F.lit(float(target)) if target is not None else F.col("mean") + F.lit(0.0),
        "sigma_hat": F.col("mr_bar") / MR_DIVISOR,
        "method": F.lit("moving_range"),
    }
    scale = {"scale_sigma": F.lit(float(sigma)) if sigma else F.col("sigma_hat") + F.lit(0.0)}
    params = seq.params(aggregates).withColumns(derived).withColumns(scale)
    return seq.attach(aggregates).with_columns(derived, scale), params


def ewma(
    df: DataFrame,
    roles: Roles,
    *,
    lam: float = 0.2,
    target: float | None = None,
    k_sigma: float = 3.0,
    exact_limits: bool = True,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Exponentially weighted moving average with exact or asymptotic limits."""
    positive(k_sigma, "k_sigma")
    if not 0 < lam <= 1:
        raise ValueError(f"lam must be in (0, 1], got {lam}")
    seq = charted_values(df, roles, missing=missing, **sizing)
    seq, params = _fitted(seq, roles, target, None)
    seq = seq.smoothed(lam, {"ewma": (F.col("value"), F.col("target"))})
    seq = seq.frame(
        1,
        lambda w: {
            "residual": F.col("value") - F.coalesce(F.lag("ewma").over(w), F.col("target"))
        },
    )
    spread = lam / (2.0 - lam)
    if exact_limits:
        variance = spread * grown_share(lam) / F.col("n")
    else:
        variance = spread / F.col("n_bar")
    half = k_sigma * F.col("sigma_hat") * F.sqrt(variance)
    seq = seq.with_columns(
        {
            "observed": F.col("value"),
            "value": F.col("ewma"),
            "ucl": F.col("target") + half,
            "cl": F.col("target") + F.lit(0.0),
            "lcl": F.col("target") - half,
            **zone_lines("target", "sigma_hat"),
        },
        {"signal": (F.col("value") > F.col("ucl")) | (F.col("value") < F.col("lcl"))},
    )

    def forecast() -> DataFrame:
        return seq.df.groupBy(*seq.keys).agg(F.max_by("ewma", IDX).alias("forecast"))

    return Chart("ewma", seq.keys, params, seq, k_sigma,
                 extra_columns=("observed", "residual", "signal"), notes={"forecast": forecast})


def grown_share(lam: float) -> Column:
    """1 - (1 - lam)**(2 (idx + 1)): how far the variance of a smoothed value has grown."""
    return F.lit(1.0) if lam == 1.0 else -F.expm1(2.0 * math.log1p(-lam) * (F.col(IDX) + 1))


def _check_cusum(h: float, k: float, head_start: float) -> None:
    positive(h, "h")
    positive(k, "k")
    if not math.isfinite(head_start) or head_start < 0:
        raise ValueError(f"head_start must not be negative, got {head_start}")


def cusum_statistics(seq: Sequence, z: Column, k: float, head_start: float = 0.0) -> Sequence:
    """C+ and C- of standardized deviations ``z`` and their running sum ``_total``, without a recursion.

    With S the running sum of z - k, C+ is S less its running minimum (not above
    -head_start); C- mirrors it.  A block starts from 0: what flows in becomes
    max(C_block, inflow + S_block) at its end, and these functions of a key's blocks are
    composed by doubling.
    """
    seq = seq.with_columns({"_z": z})
    upto = (Window.unboundedPreceding, 0)
    cut = seq._cut() if seq.blocked else seq
    w = (cut._block_window() if seq.blocked else seq._window()).rowsBetween(*upto)
    sums = {
        "_total": F.sum("_z").over(w),
        "_up": F.sum(F.col("_z") - k).over(w),
        "_down": F.sum(F.col("_z") + k).over(w),
    }
    head = 0.0 if seq.blocked else head_start
    sides = {
        "c_plus": F.col("_up") - F.least(F.lit(-head), F.min("_up").over(w)),
        "c_minus": F.col("_down") - F.greatest(F.lit(head), F.max("_down").over(w)),
    }
    if not seq.blocked:
        return seq.with_columns(sums, sides).drop("_z", "_up", "_down")
    rows = durable(cut._own().withColumns(sums).withColumns(sides).drop("_z"))
    ends = {"_s": "_total", "_su": "_up", "_sd": "_down", "_cu": "c_plus", "_cd": "c_minus"}
    blocks = rows.groupBy(*seq.keys, BLOCK).agg(*[F.max_by(c, IDX).alias(n) for n, c in ends.items()])
    none = {"_s": 0.0, "_su": 0.0, "_sd": 0.0, "_cu": -math.inf, "_cd": math.inf}

    def compose(earlier) -> dict[str, Column]:
        return {
            **{n: F.col(n) + earlier(n, 0.0) for n in ("_s", "_su", "_sd")},
            "_cu": F.greatest(F.col("_cu"), earlier("_cu", -math.inf) + F.col("_su")),
            "_cd": F.least(F.col("_cd"), earlier("_cd", math.inf) + F.col("_sd")),
        }

    rows = seq.joined(rows, scanned_blocks(blocks, seq.keys, compose, none), BLOCK)
    up = F.greatest(F.col("_cu"), head_start + F.col("_su"))
    down = F.least(F.col("_cd"), -head_start + F.col("_sd"))
    rows = rows.withColumns(
        {
            "_total": F.col("_total") + F.col("_s"),
            "c_plus": F.greatest(F.col("c_plus"), up + F.col("_up")),
            "c_minus": F.least(F.col("c_minus"), down + F.col("_down")),
        }
    )
    return seq.with_df(rows.drop("_up", "_down", BLOCK, *ends))


def _standardized() -> Column:
    return F.try_divide(F.col("value") - F.col("target"), F.col("scale_sigma"))


def shift_starts(seq: Sequence) -> DataFrame:
    """For each run of signals: where it starts and the row after the last zero before it."""
    seq = seq.last_known(
        _zero_up=F.when(F.col("c_plus") == 0, F.col(IDX)),
        _zero_down=F.when(F.col("c_minus") == 0, F.col(IDX)),
    )
    seq = seq.frame(
        1,
        lambda w: {
            "_was_up": F.coalesce(F.lag("signal_upper").over(w), F.lit(False)),
            "_was_down": F.coalesce(F.lag("signal_lower").over(w), F.lit(False)),
        },
    )
    sides = F.array(
        F.when(F.col("signal_upper") & ~F.col("_was_up"),
               F.struct(F.lit("upper").alias("side"), F.col("_zero_up").alias("zero"))),
        F.when(F.col("signal_lower") & ~F.col("_was_down"),
               F.struct(F.lit("lower").alias("side"), F.col("_zero_down").alias("zero"))),
    )
    return seq.df.select(
        *seq.keys, F.col(IDX).alias("signal_idx"), F.explode(F.array_compact(sides)).alias("_s")
    ).select(
        *seq.keys,
        "signal_idx",
        F.col("_s.side").alias("side"),
        F.coalesce(F.col("_s.zero") + 1, F.lit(0)).cast("long").alias("shift_start"),
    )


def cusum(
    df: DataFrame,
    roles: Roles,
    *,
    h: float = 5.0,
    k: float = 0.5,
    target: float | None = None,
    sigma: float | None = None,
    head_start: float = 0.0,
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Tabular CUSUM; charts C+ between -h and h, C- alongside."""
    positive(k_sigma, "k_sigma")
    _check_cusum(h, k, head_start)
    seq = charted_values(df, roles, missing=missing, **sizing)
    seq, params = _fitted(seq, roles, target, sigma)
    seq = cusum_statistics(seq, _standardized(), k, head_start)
    seq = seq.with_columns(
        {
            "observed": F.col("value"),
            "value": F.col("c_plus"),
            "ucl": F.lit(float(h)),
            "cl": F.lit(0.0),
            "lcl": F.lit(-float(h)),
            "signal_upper": F.col("c_plus") > h,
            "signal_lower": F.col("c_minus") < -h,
            **zone_lines(F.lit(0.0), F.col("sigma_hat")),
        }
    )
    return Chart("cusum", seq.keys, params, seq, k_sigma,
                 extra_columns=("observed", "c_minus", "signal_upper", "signal_lower"),
                 notes={"shifts": lambda: shift_starts(seq)})


def cusum_vmask(
    df: DataFrame,
    roles: Roles,
    *,
    h: float = 5.0,
    k: float = 0.5,
    d_units: float = 1.0,
    target: float | None = None,
    sigma: float | None = None,
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Cumulative sums with a V-mask; the mask signals where the tabular CUSUM does."""
    positive(k_sigma, "k_sigma")
    _check_cusum(h, k, 0.0)
    positive(d_units, "d_units")
    seq = charted_values(df, roles, missing=missing, **sizing)
    seq, params = _fitted(seq, roles, target, sigma)
    seq = cusum_statistics(seq, _standardized(), k)
    lead = h / (2.0 * k)
    seq = seq.with_columns(
        {
            "observed": F.col("value"),
            "value": F.col("_total"),
            "ucl": F.lit(float(h)),
            "cl": F.lit(0.0),
            "lcl": F.lit(-float(h)),
            "vertex_x": F.col(IDX) + lead,
            "vertex_y": F.col("_total"),
            "upper_slope": F.lit(float(k)),
            "lower_slope": F.lit(-float(k)),
            "signal": (F.col("c_plus") > h) | (F.col("c_minus") < -h),
            **zone_lines(F.lit(0.0), F.col("sigma_hat")),
        }
    )
    mask = {"lead_distance": F.lit(lead), "half_angle": F.lit(math.atan(k / d_units))}
    return Chart("cusum_vmask", seq.keys, params.withColumns(mask), seq, k_sigma,
                 extra_columns=("observed", "vertex_x", "vertex_y", "upper_slope", "lower_slope",
                                "signal"))
