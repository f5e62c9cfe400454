"""What a control chart returns, and the shared way to build one.

A chart is two lazy tables.  ``params`` has one row per key (series + phase),
``points`` one row per charted point with ``idx``, ``value``, ``ucl``, ``cl``,
``lcl`` and the scalar zone line and zone sigma the rules use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.constants import constant
from plumbline.operators.series import (
    IDX,
    PHASE,
    Roles,
    Sequence,
    phase_column,
    sequence,
)

EXCLUDED = "excluded"
POINT_COLUMNS = ("value", "ucl", "cl", "lcl", "zone_cl", "zone_sigma")


def positive(value: float, name: str) -> float:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and positive, got {value}")
    return float(value)


def one_of(value, allowed, name: str):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed, key=str)}, got {value!r}")
    return value


@dataclass(frozen=True)
class Chart:
    kind: str
    keys: list[str]
    params: DataFrame
    sequence: Sequence
    k_sigma: float
    secondary: Sequence | None = None
    extra_columns: tuple[str, ...] = ()
    notes: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)

    @property
    def points(self) -> DataFrame:
        return self.points_with()

    def points_with(self, *columns: str) -> DataFrame:
        """The points with further columns of their rows."""
        marked = [EXCLUDED] if EXCLUDED in self.sequence.held.columns else []
        return self.sequence.df.select(*self.keys, IDX, *POINT_COLUMNS, *self.extra_columns, *marked, *columns)

    @property
    def order_column(self) -> str | None:
        """The order column of points that are one row each."""
        columns = self.sequence.held.columns
        return "_o0" if "_o0" in columns and "_o1" not in columns and self.kind != "mr" else None

    def note(self, name: str) -> DataFrame:
        """A further table of the chart, planned when asked for."""
        if name not in self.notes:
            raise ValueError(f"chart {self.kind} has no {name}; it has {sorted(self.notes)}")
        return self.notes[name]()

    @property
    def secondary_points(self) -> DataFrame:
        """The dispersion half of a paired chart (moving ranges, ranges, deviations)."""
        if self.secondary is None:
            raise ValueError(f"chart {self.kind} has no dispersion part")
        return self.secondary.df.select(*self.keys, IDX, "value", "ucl", "cl", "lcl")


def measurements(df: DataFrame, roles: Roles, *, missing: str = "drop") -> DataFrame:
    """Series, phase, subgroup, order and value columns, nothing else.

    Missing values are dropped (``missing="zero"`` charts them as 0.0).  Only the
    columns a chart needs are kept, so scans read no others.
    """
    one_of(missing, ("drop", "zero"), "missing")
    value = F.col(roles.value).cast("double")
    columns = {
        **{c: F.col(c) for c in roles.series_columns},
        PHASE: phase_column(df, roles.phase),
        **({"subgroup": F.col(roles.subgroup)} if roles.subgroup else {}),
        **({EXCLUDED: excluded_flag(roles)} if roles.excluded else {}),
        **{f"_o{i}": F.col(c) for i, c in enumerate(roles.order_columns)},
        "value": F.coalesce(value, F.lit(0.0)) if missing == "zero" else value,
    }
    out = df.select(*[c.alias(n) for n, c in columns.items()])
    return out if missing == "zero" else out.where(F.col("value").isNotNull())


def excluded_flag(roles: Roles) -> Column:
    return F.coalesce(F.col(roles.excluded).cast("boolean"), F.lit(False))


def used(column: str | Column, roles: Roles) -> Column:
    """``column`` where a row is estimated from, null where it is excluded."""
    c = F.col(column) if isinstance(column, str) else column
    return c if roles.excluded is None else F.when(~F.col(EXCLUDED), c)


def order_of(roles: Roles) -> list[str]:
    return [f"_o{i}" for i in range(len(roles.order_columns))]


def individuals(df: DataFrame, roles: Roles, *, missing: str = "drop", **sizing) -> Sequence:
    rows = measurements(df, roles, missing=missing)
    return sequence(rows, roles.keys, order_of(roles), single=roles.single, **sizing)


def build(
    kind: str,
    seq: Sequence,
    aggregates: Mapping[str, Column],
    derived: Mapping[str, Column] | list[Mapping[str, Column]],
    lines: Mapping[str, Column],
    *,
    k_sigma: float,
    medians: Mapping[str, str] | None = None,
    secondary: Callable[[Sequence], Sequence] | None = None,
    finish: Callable[[Sequence], Sequence] | None = None,
    extra_columns: tuple[str, ...] = (),
    notes: Mapping[str, Callable[[], DataFrame]] | None = None,
) -> Chart:
    """Aggregate per key, derive the parameters, draw the lines.

    The same expressions make ``params`` (a grouped aggregation) and the columns
    of ``points``.
    """
    steps = [derived] if isinstance(derived, Mapping) else list(derived)
    params = seq.params(aggregates, medians)
    for step in steps:
        params = params.withColumns(dict(step))
    full = seq.attach(aggregates, medians).with_columns(*steps)
    pair = secondary(full) if secondary else None
    full = full.with_columns(lines)
    if finish:
        full = finish(full)
    return Chart(kind, seq.keys, params, full, k_sigma, pair, extra_columns, notes or {})


def build_joined(
    kind: str,
    seq: Sequence,
    params: DataFrame,
    lines: Mapping[str, Column] | list[Mapping[str, Column]],
    *,
    k_sigma: float,
    extra_columns: tuple[str, ...] = (),
) -> Chart:
    """As ``build`` for parameters that need more than plain aggregates (quantiles,
    fits, inverses): they are computed per key and joined to the rows."""
    rows = seq.beside(params)
    steps = [lines] if isinstance(lines, Mapping) else list(lines)
    return Chart(kind, seq.keys, params, rows.with_columns(*steps), k_sigma,
                 extra_columns=extra_columns)


def zone_lines(cl: str | Column, sigma: str | Column) -> dict[str, Column]:
    cl = F.col(cl) if isinstance(cl, str) else cl
    sigma = F.col(sigma) if isinstance(sigma, str) else sigma
    return {"zone_cl": cl, "zone_sigma": sigma}


def zones(points: DataFrame) -> DataFrame:
    """Zone boundaries from the zone line and zone sigma: +-1 and +-2 sigma."""
    cl, sigma = F.col("zone_cl"), F.col("zone_sigma")
    return points.withColumns(
        {
            "zone_a_upper": cl + 2.0 * sigma,
            "zone_b_upper": cl + sigma,
            "zone_b_lower": cl - sigma,
            "zone_a_lower": cl - 2.0 * sigma,
        }
    )


def moving_range(seq: Sequence, span: int = 2, value: str = "value", name: str = "mr") -> Sequence:
    """|x_i - x_(i-1)|, or max - min of ``span`` values; null until the span is full."""
    if span < 2:
        raise ValueError(f"span must be at least 2, got {span}")
    if span == 2:
        return seq.frame(
            1, lambda w: {name: F.abs(F.col(value) - F.lag(value).over(w))}
        )
    back = lambda w: w.rowsBetween(-(span - 1), 0)
    full = F.col(IDX) >= span - 1
    return seq.frame(
        span - 1,
        lambda w: {
            name: F.when(full, F.max(value).over(back(w)) - F.min(value).over(back(w)))
        },
    )


def estimating_range(seq: Sequence, roles: Roles, span: int = 2, value: str = "value", name: str = "mr") -> tuple[Sequence, str]:
    """Moving ranges to estimate from, and their column.

    With excluded rows these are the ranges of the others among themselves, reaching
    over the gaps.
    """
    if roles.excluded is None:
        return (seq if name in seq.held.columns else moving_range(seq, span, value, name)), name
    name, kept = f"{name}_used", F.when(~F.col(EXCLUDED), F.col(value))
    if span == 2 and not seq.blocked:
        before = seq._window().rowsBetween(Window.unboundedPreceding, -1)
        return seq.with_columns({name: F.abs(kept - F.last(kept, ignorenulls=True).over(before))}), name
    if span == 2:
        seq = seq.last_known(_seen=kept).frame(1, lambda w: {"_seen": F.lag("_seen").over(w)})
        return seq.with_columns({name: F.abs(kept - F.col("_seen"))}).drop("_seen"), name
    # positions among the rows that are excluded alike
    seq = seq.running_sum(_out=F.col(EXCLUDED).cast("long"))
    place = F.when(F.col(EXCLUDED), F.col("_out") - 1).otherwise(F.col(IDX) - F.col("_out"))
    rows = seq.df.withColumns({"_place": F.col(IDX), IDX: place}).drop("_out")
    alike = moving_range(replace(seq.with_df(rows), keys=[*seq.keys, EXCLUDED]), span, value, name).df
    rows = alike.withColumns({IDX: F.col("_place"), name: F.when(~F.col(EXCLUDED), F.col(name))}).drop("_place")
    return seq.with_df(rows), name


MR_DIVISOR = constant("d2", 2)
