"""Drift and simple forecasts for every series at once.

Five small models are fitted as aggregations: last value (naive), drift, linear
trend, seasonal naive and exponential smoothing.  Per series the one with the
lowest mean absolute percentage error on the held-out tail is refitted on all
values, shifted to continue from the last value, and given expanding intervals.
"""

from __future__ import annotations

from dataclasses import replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chart import measurements, order_of
from plumbline.operators.series import IDX, Roles, Sequence, join_keys, sequence
from plumbline.session import durable

MIN_POINTS = 10
MODELS = ("naive", "drift", "linear", "seasonal", "smoothing")
MIN_LAG, MAX_LAG = 4, 48
ACCEPTED_ACF = 0.3
SMOOTHING = 0.3


def observations(df: DataFrame, roles: Roles, **sizing) -> Sequence:
    """Numbered values; missing and unparsable ones are dropped."""
    parsed = df.withColumn("_parsed", F.col(roles.value).try_cast("double"))
    rows = measurements(parsed, replace(roles, value="_parsed")).where(~F.isnan("value"))
    return sequence(rows, roles.keys, order_of(roles), single=roles.single, **sizing)


def season_length(seq: Sequence) -> DataFrame:
    """Lag of the highest autocorrelation among 4..min(48, n // 2), if above 0.3, else 1."""
    seq = seq.attach({"_n": F.count("value"), "_mean": F.avg("value")})
    dev = F.col("value") - F.col("_mean")
    seq = seq.with_columns({"_dev": dev})
    lags = range(MIN_LAG, MAX_LAG + 1)
    seq = seq.frame(MAX_LAG, lambda w: {f"_l{k}": F.lag("_dev", k).over(w) for k in lags})
    sums = seq.df.groupBy(*seq.keys).agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_dev") * F.col("_dev")).alias("_var"),
        *[F.sum(F.col("_dev") * F.col(f"_l{k}")).alias(f"_p{k}") for k in lags],
    )
    allowed = F.floor(F.col("n") / 2)
    candidates = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.lit(k) <= allowed) & (F.col("_var") > 0),
                    # the shorter lag wins a tie
                    F.struct(
                        F.try_divide(F.col(f"_p{k}"), F.col("_var")).alias("acf"),
                        F.lit(-k).alias("minus_lag"),
                    ),
                )
                for k in lags
            ]
        )
    )
    best = F.array_max(candidates)
    found = (F.col("n") >= 12) & (F.col("_best.acf") > ACCEPTED_ACF)
    return sums.withColumn("_best", best).select(
        *seq.keys,
        "n",
        F.col("_best.acf").alias("best_acf"),
        F.when(found, -F.col("_best.minus_lag")).otherwise(1).cast("long").alias("period"),
    )


def slope(seq: Sequence) -> DataFrame:
    """Least squares slope on the position, with n and the sample deviation."""
    return seq.df.groupBy(*seq.keys).agg(
        F.count("value").alias("n"),
        F.coalesce(F.regr_slope("value", F.col(IDX).cast("double")), F.lit(0.0)).alias("slope"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sigma"),
    )


def drift_score(slope: Column, sigma: Column, n: Column) -> Column:
    """min(1, |slope| over the standard error of the mean), 0 without variation."""
    score = F.least(F.lit(1.0), F.abs(slope) * F.sqrt(n) / F.nullif(sigma, F.lit(0.0)))
    return F.when((sigma == 0) | (n < 2), 0.0).otherwise(score)


def drift(seq: Sequence) -> DataFrame:
    # fixed values: thresholds and labels
    score = drift_score(F.col("slope"), F.col("sigma"), F.col("n"))
    label = (
        F.when(F.col("drift_score") > 0.7, "High drift")
        .when(F.col("drift_score") > 0.3, "Approaching drift")
        .otherwise("Low drift")
    )
    return slope(seq).withColumn("drift_score", score).withColumn("drift_label", label)


def _train_sums(until: Column, position: Column, value: Column) -> dict[str, Column]:
    """Sums over the rows before ``until`` that fit every model but the seasonal one."""
    inside = position < until
    x = position.cast("double")

    def over(c: Column) -> Column:
        return F.when(inside, c)

    return {
        "first": F.min_by(value, over(position)),
        "last": F.max_by(value, over(position)),
        "slope": F.regr_slope(over(value), over(x)),
        "intercept": F.regr_intercept(over(value), over(x)),
        "level": F.max_by(F.col("_level"), over(position)),
    }


def _model_value(model: str, fit: str, size: Column, position: Column, season: Column) -> Column:
    """What a model fitted on the first ``size`` rows says for a later position."""
    last, first = F.col(f"{fit}_last"), F.col(f"{fit}_first")
    ahead = position - size + 1
    if model == "naive":
        return last
    if model == "drift":
        return last + ahead * F.try_divide(last - first, size - 1)
    if model == "linear":
        return F.col(f"{fit}_intercept") + F.col(f"{fit}_slope") * position
    if model == "smoothing":
        return F.col(f"{fit}_level")
    return season


def _season_table(rows: DataFrame, until: str, keys: list[str]) -> DataFrame:
    """The last ``period`` values before ``until``."""
    tail = (F.col(IDX) < F.col(until)) & (F.col(IDX) >= F.col(until) - F.col("period"))
    return rows.where(tail).select(
        *keys, (F.col(IDX) % F.col("period")).alias("_slot"), F.col("value").alias("_season")
    )


def forecast(
    df: DataFrame,
    roles: Roles,
    *,
    horizon: int = 20,
    confidence: float = 0.95,
    period: int | None = None,
    ucl: float | None = None,
    lcl: float | None = None,
    limits: DataFrame | None = None,
    **sizing,
) -> tuple[DataFrame, DataFrame]:
    """(summary, projection): per series the model and drift, and ``horizon`` future rows.

    Breaches are of ``ucl`` and ``lcl``, or of each series' own limits if ``limits``, a
    table of the keys with ucl and lcl, is given.  Series with fewer than 10 values have
    the status ``too short``, no model and no projection.
    """
    if horizon < 1:
        raise ValueError(f"horizon must be positive, got {horizon}")
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be between 0 and 1, got {confidence}")
    seq = observations(df, roles, **sizing)
    keys = seq.keys
    found = season_length(seq)
    length = F.lit(period) if period else F.col("period")
    sizes = (
        found.where(F.col("n") >= MIN_POINTS)
        .withColumn("period", F.least(length, F.greatest(F.floor(F.col("n") / 3), F.lit(1))))
        .withColumn("holdout", F.greatest(F.least(F.col("period"), F.floor(F.col("n") / 3)),
                                          F.ceil(F.col("n") / 5)))
        .withColumn("train", (F.col("n") - F.col("holdout")).cast("long"))
        .select(*keys, "n", "period", "train")
    )
    seq = seq.attach({"_start": F.min_by("value", IDX)})
    seq = seq.smoothed(SMOOTHING, {"_level": (F.col("value"), F.col("_start"))})
    # what smoothing says for a row is its level one row before
    seq = seq.frame(1, lambda w: {"_before": F.coalesce(F.lag("_level").over(w), F.col("_start")),
                                  "_previous": F.lag("value").over(w)})
    # Every model reads these rows, several times: they are computed and written once.
    rows = durable(join_keys(seq.df, sizes, keys, "inner"))
    position, value = F.col(IDX), F.col("value")
    fits = rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "period", "train")],
        *[c.alias(f"t_{m}") for m, c in _train_sums(F.col("train"), position, value).items()],
        *[c.alias(f"f_{m}") for m, c in _train_sums(F.col("n"), position, value).items()],
    )
    # -- hold-out error of every model, in one pass over the tail
    tail = join_keys(rows.drop("n", "period", "train"), fits, keys).where(
        position >= F.col("train")
    ).withColumn("_slot", position % F.col("period"))
    tail = join_keys(tail, _season_table(rows, "train", keys), [*keys, "_slot"])
    errors = tail.groupBy(*keys).agg(
        *[
            F.avg(
                F.abs(F.try_divide(
                    value - _model_value(m, "t", F.col("train"), position, F.col("_season")), value
                ))
            ).alias(f"mape_{m}")
            for m in MODELS
        ]
    )
    ranked = F.array_min(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"mape_{m}").isNotNull(),
                        F.struct(F.col(f"mape_{m}").alias("mape"), F.lit(i).alias("rank"),
                                 F.lit(m).alias("model")),
                    )
                    for i, m in enumerate(MODELS)
                ]
            )
        )
    )
    chosen = durable(
        join_keys(fits, errors, keys).withColumn("_best", ranked).withColumns(
            {"model": F.coalesce(F.col("_best.model"), F.lit("naive")), "mape": F.col("_best.mape")}
        )
    )
    # -- in-sample one-step residuals of the chosen model
    full = join_keys(rows.drop("n", "period", "train"), chosen, keys)
    seasonal = chosen.where(F.col("model") == "seasonal").select(*keys, "period")
    season_before = join_keys(rows.drop("n", "period", "train"), seasonal, keys, "inner").select(
        *keys, (position + F.col("period")).alias(IDX), value.alias("_earlier")
    )
    full = join_keys(full, season_before, [*keys, IDX])
    step = F.try_divide(F.col("f_last") - F.col("f_first"), F.col("n") - 1)
    said = (
        F.when(F.col("model") == "linear", F.col("f_intercept") + F.col("f_slope") * position)
        .when(F.col("model") == "smoothing", F.col("_before"))
        .when(F.col("model") == "drift", F.col("_previous") + step)
        .when(F.col("model") == "seasonal", F.col("_earlier"))
        .otherwise(F.col("_previous"))
    )
    residuals = full.groupBy(*keys).agg(F.stddev_samp(value - said).alias("residual_sigma"))
    scale = F.coalesce(F.nullif(F.col("residual_sigma"), F.lit(0.0)), F.lit(1e-10))
    drifts = drift(seq.with_df(rows)).select(*keys, "drift_score", "drift_label")
    summary = join_keys(join_keys(chosen, residuals, keys), drifts, keys).withColumn(
        "residual_sigma", scale
    )
    projection = project(summary, _season_table(rows, "n", keys), keys, horizon, confidence)
    out_of_control = steps_to_breach(projection, keys, ucl, lcl, limits)
    summary = join_keys(summary, out_of_control, keys).select(
        *keys, "n", "period", "model", "mape", "residual_sigma", "drift_score", "drift_label",
        "steps_to_breach", F.lit("forecast").alias("status"),
    )
    short = found.where(F.col("n") < MIN_POINTS).select(*keys, "n", F.lit("too short").alias("status"))
    return summary.unionByName(short, allowMissingColumns=True), projection


def project(
    summary: DataFrame, seasons: DataFrame, keys: list[str], horizon: int, confidence: float
) -> DataFrame:
    """Future rows of the chosen model, continuing from the last value."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    future = summary.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    position = F.col("n") + F.col("h") - 1
    future = future.withColumns({"x": position, "_slot": position % F.col("period")})
    future = join_keys(future, seasons, [*keys, "_slot"])
    raw = F.lit(None).cast("double")
    for m in MODELS:
        said = _model_value(m, "f", F.col("n"), F.col("x"), F.col("_season"))
        raw = F.when(F.col("model") == m, said).otherwise(raw)
    future = future.withColumn("_raw", raw)
    starts = future.where(F.col("h") == 1).select(*keys, F.col("_raw").alias("_raw1"))
    future = join_keys(future, starts, keys)
    offset = F.col("f_last") - F.col("_raw1")
    y = F.when(F.abs(offset) > 1e-10, F.col("_raw") + offset).otherwise(F.col("_raw"))
    width = interval_width(z, F.col("residual_sigma"), F.col("h"), F.col("n"))
    return future.select(
        *keys,
        F.col("h").cast("long").alias("h"),
        F.col("x").cast("long").alias("x"),
        y.alias("y"),
        (y + width).alias("upper"),
        (y - width).alias("lower"),
    )


def interval_width(z: float, residual_sigma: Column, h: Column, n: Column) -> Column:
    return z * residual_sigma * F.sqrt(1.0 + h / (n / 2.0))


def steps_to_breach(
    projection: DataFrame,
    keys: list[str],
    ucl: float | None = None,
    lcl: float | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """First h whose projection reaches a limit; null if none does or limits are missing."""
    if limits is not None:
        own = limits.select(*keys, F.col("ucl").alias("_ucl"), F.col("lcl").alias("_lcl"))
        projection = join_keys(projection, own, keys)
        breach = (F.col("y") >= F.col("_ucl")) | (F.col("y") <= F.col("_lcl"))
    elif ucl is None or lcl is None:
        breach = F.lit(False)
    else:
        breach = (F.col("y") >= ucl) | (F.col("y") <= lcl)
    return projection.groupBy(*keys).agg(F.min(F.when(breach, F.col("h"))).alias("steps_to_breach"))
