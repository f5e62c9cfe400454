"""Short run charts: several products on one chart, each about its own target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.constants import constant
from plumbline.operators.chart import (
    MR_DIVISOR,
    Chart,
    build,
    estimating_range,
    measurements,
    moving_range,
    one_of,
    order_of,
    positive,
    used,
    zone_lines,
)
from plumbline.operators.series import IDX, Roles, Sequence, join_keys, sequence


def product_statistics(rows: DataFrame, roles: Roles, known: DataFrame | None, **sizing):
    """Target and sigma per product; given ones (product, target, sigma) come first."""
    keys, value = [*roles.keys, "product"], used("value", roles)
    seq, ranges = estimating_range(sequence(rows, keys, order_of(roles), **sizing), roles)
    stats = seq.df.groupBy(*keys).agg(
        F.avg(value).alias("target"),
        F.coalesce(F.avg(ranges) / MR_DIVISOR, F.lit(0.0)).alias("product_sigma"),
        F.count(value).alias("n"),
    )
    if known is None:
        return stats
    given = known.select(
        "product", F.col("target").alias("_target"), F.col("sigma").alias("_sigma")
    )
    return (
        join_keys(stats, given, ["product"])
        .withColumn("target", F.coalesce("_target", "target"))
        .withColumn("product_sigma", F.coalesce("_sigma", "product_sigma"))
        .drop("_target", "_sigma")
    )


def short_run(
    df: DataFrame,
    roles: Roles,
    *,
    scaling: str = "centered",
    known: DataFrame | None = None,
    k_sigma: float = 3.0,
    missing: str = "drop",
    **sizing,
) -> Chart:
    """Values less their product's target, or that over the product's sigma.

    Rows without a product share the product ``default``.  Dispersion limits always
    use 3 sigma.
    """
    positive(k_sigma, "k_sigma")
    one_of(scaling, ("centered", "standardized"), "scaling")
    rows = measurements(df, roles, missing=missing)
    label = F.col("subgroup").cast("string") if roles.subgroup else F.lit(None).cast("string")
    product = F.when(label.isNull() | (label == ""), F.lit("default")).otherwise(label)
    rows = rows.withColumn("product", product)
    stats = product_statistics(rows, roles, known, **sizing)
    joined = join_keys(rows, stats.drop("n"), [*roles.keys, "product"])
    off = F.col("value") - F.col("target")
    if scaling == "standardized":
        off = F.when(F.col("product_sigma") > 0, F.try_divide(off, F.col("product_sigma"))).otherwise(0.0)
    seq = sequence(joined, roles.keys, order_of(roles), sized_by=rows, single=roles.single,
                   **sizing)
    seq = seq.with_columns({"transformed": off})
    seq = moving_range(seq, value="transformed")
    seq, ranges = estimating_range(seq, roles, value="transformed")
    center = F.avg(used("transformed", roles)) if scaling == "centered" else F.avg(F.lit(0.0))
    return build(
        "short_run",
        seq,
        {"center": center, "mr_bar": F.avg(ranges), "n_used": F.count(used("value", roles))},
        {"sigma_hat": F.coalesce(F.col("mr_bar") / MR_DIVISOR, F.lit(0.0)),
         "method": F.lit("short_run")},
        {
            "observed": F.col("value"),
            "value": F.col("transformed"),
            "ucl": F.col("center") + k_sigma * F.col("sigma_hat"),
            "cl": F.col("center") + F.lit(0.0),
            "lcl": F.col("center") - k_sigma * F.col("sigma_hat"),
            **zone_lines("center", "sigma_hat"),
        },
        k_sigma=k_sigma,
        secondary=_dispersion,
        extra_columns=("product", "observed"),
        notes={"products": lambda: stats},
    )


def _dispersion(seq: Sequence) -> Sequence:
    spread = 3.0 * constant("d3", 2) / constant("d2", 2)
    center = F.col("mr_bar") + F.lit(0.0)
    return seq.with_df(
        seq.df.where(F.col(IDX) >= 1).withColumns(
            {
                IDX: F.col(IDX) - 1,
                "value": F.col("mr"),
                "ucl": center * (1.0 + spread),
                "cl": center,
                "lcl": center * max(1.0 - spread, 0.0),
            }
        )
    )
