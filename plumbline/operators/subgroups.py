"""Rational subgroups: statistics per subgroup, in order of first appearance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.chart import EXCLUDED, measurements, order_of
from plumbline.operators.series import (
    PHASE,
    Roles,
    Sequence,
    group_sizes,
    join_keys,
    medians_of,
    phase_column,
    sequence,
)
from plumbline.session import block_rows, durable

STATISTICS = {
    "mean": F.avg,
    "range": lambda c: F.max(c) - F.min(c),
    "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    "total": F.sum,
}


def subgroup_keys(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    """Rows without a subgroup stand alone: each becomes a subgroup of one."""
    order = order_of(roles)
    if roles.subgroup is None:
        return df.withColumn("subgroup", F.lit(None).cast("string")), [*roles.keys, *order]
    label = F.col("subgroup").cast("string")
    missing = label.isNull() | (label == "")
    solo = {f"_solo{i}": F.when(missing, F.col(c)) for i, c in enumerate(order)}
    out = df.withColumns({"subgroup": F.when(~missing, label), **solo})
    return out, [*roles.keys, "subgroup", *solo]


def subgroup_table(
    df: DataFrame,
    roles: Roles,
    statistics: Iterable[str] = ("mean", "range", "std"),
    *,
    missing: str = "drop",
    median: bool = False,
) -> DataFrame:
    """One row per subgroup: ``n``, the statistics and ``_first``, its first order value.

    With excluded rows also the ``used_`` statistics of the others, null in a subgroup
    all of whose rows are excluded.
    """
    rows, by = subgroup_keys(measurements(df, roles, missing=missing), roles)
    order = order_of(roles)
    first = F.min(order[0] if len(order) == 1 else F.struct(*order))
    picked = {s: STATISTICS[s](F.col("value")) for s in statistics}
    if roles.excluded:
        kept = F.when(~F.col(EXCLUDED), F.col("value"))
        some = F.count(kept) > 0
        picked |= {f"used_{s}": F.when(some, STATISTICS[s](kept)) for s in statistics}
        picked |= {"used_n": F.when(some, F.count(kept)), EXCLUDED: ~some}
    table = rows.groupBy(*by).agg(
        first.alias("_first"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(s) for s, c in picked.items()],
    )
    if median:
        table = join_keys(table, medians_of(rows, by, "value", "median"), by)
    if roles.subgroup is None:
        return table.withColumn("subgroup", F.lit(None).cast("string"))
    return table


def subgroups(
    df: DataFrame,
    roles: Roles,
    statistics: Iterable[str] = ("mean", "range", "std"),
    *,
    missing: str = "drop",
    median: bool = False,
    **sizing,
) -> Sequence:
    """Subgroup statistics numbered in order of first appearance.

    There are never more subgroups than rows, so the raw rows serve as a cheap size
    check.  If they are too many for one task, the subgroups are written down and
    counted themselves: mostly they are few.
    """
    table = subgroup_table(df, roles, statistics, missing=missing, median=median)
    if sizing.get("blocked") is None:
        limit = block_rows(df.sparkSession, sizing.get("block_rows"))
        raw = group_sizes(measurements(df, roles, missing=missing), roles.keys)
        if raw.largest <= limit:
            sizing["blocked"] = False
        else:
            table = durable(table)
    seq = sequence(table, roles.keys, ["_first", "subgroup"], single=roles.single, **sizing)
    keep = [*roles.keys, "idx", "subgroup", "n", *statistics, *(["median"] if median else [])]
    if roles.excluded:
        keep += [*(f"used_{s}" for s in ("n", *statistics)), EXCLUDED]
    return seq.with_df(seq.df.select(*keep))


def estimated(statistic: str, roles: Roles) -> str:
    """The column of a subgroup statistic to estimate from."""
    return statistic if roles.excluded is None else f"used_{statistic}"


def harmonic_size(n: str | Column = "n") -> Column:
    """Harmonic mean of subgroup sizes, as an aggregate."""
    n = F.col(n) if isinstance(n, str) else n
    return F.count(n) / F.sum(1.0 / n)


def typical_size(seq: Sequence, n: str = "n") -> DataFrame:
    """The most common subgroup size per key; of equally common ones the first to appear."""
    counts = seq.df.where(F.col(n).isNotNull()).groupBy(*seq.keys, F.col(n).alias("n")).agg(
        F.count(F.lit(1)).alias("_many"), F.min("idx").alias("_seen")
    )
    return counts.groupBy(*seq.keys).agg(
        F.max_by("n", F.struct(F.col("_many"), -F.col("_seen"))).alias("typical_n")
    )


def phase_table(df: DataFrame, roles: Roles, points: DataFrame | None = None) -> DataFrame:
    """Phases per series in order of first appearance, with their global index range.

    The range counts ``points``, the points of a chart; without them it counts values.
    ``end_index`` is exclusive.
    """
    order = roles.order_columns
    first = F.min(order[0] if len(order) == 1 else F.struct(*order))
    per_phase = (
        df.withColumn(PHASE, phase_column(df, roles.phase))
        .groupBy(*roles.keys)
        .agg(first.alias("_first"), F.count(roles.value).alias("n"))
    )
    if points is not None:
        charted = points.groupBy(*roles.keys).agg(F.count(F.lit(1)).alias("n"))
        per_phase = join_keys(per_phase.drop("n"), charted, roles.keys).na.fill(0, ["n"])
    w = Window.partitionBy(*roles.series_columns).orderBy("_first", PHASE)
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return per_phase.select(
        *roles.keys,
        (F.row_number().over(w) - 1).cast("long").alias("phase_rank"),
        (upto - F.col("n")).alias("start_index"),
        upto.alias("end_index"),
    )


def axis_labels(points: DataFrame, *, subgrouped: bool, order: str | None = None) -> DataFrame:
    """Axis text: the subgroup where there is one, else the row's order value, else the 1-based position.

    ``order`` names the order column of points that stand for one row each.
    """
    position = F.col(order) if order else F.col("idx") + 1
    label = F.coalesce(F.col("subgroup"), F.lit("default")) if subgrouped else position.cast("string")
    return points.withColumn("label", label)
