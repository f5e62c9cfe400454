"""Nelson and Westgard rules over charted points.

All chosen rules are evaluated over the same ordering of a key: one sort, bounded
frames of at most ``n`` rows.  A rule's column is true on the points it flags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plumbline.operators.chart import Chart
from plumbline.operators.series import IDX, Sequence

NELSON_DEFAULT = (1, 2, 3, 4, 5)
NELSON_N = {2: 9, 3: 6, 4: 14, 5: 2, 6: 4, 7: 15, 8: 8}
NELSON_WINDOW = {5: 3, 6: 5}
WESTGARD = ("1_2s", "1_3s", "2_2s", "r_4s", "4_1s", "10_x")

# Fixed texts, by rule.
DESCRIPTIONS = {
    "1": "Point beyond control limits (Test 1)",
    "2": "9 consecutive points on same side of CL (Test 2)",
    "3": "6 consecutive points trending (Test 3)",
    "4": "14 consecutive alternating points (Test 4)",
    "5": "2 of 3 in Zone A or beyond, same side (Test 5)",
    "6": "4 of 5 in Zone B or beyond, same side (Test 6)",
    "7": "15 consecutive in Zone C (Test 7)",
    "8": "8 consecutive outside Zone C (Test 8)",
    "1_2s": "1 point beyond ±2σ (1_2s)",
    "1_3s": "1 point beyond ±3σ (1_3s)",
    "2_2s": "2 consecutive beyond ±2σ same side (2_2s)",
    "r_4s": "Consecutive points spanning >4σ (R_4s)",
    "4_1s": "4 consecutive beyond ±1σ same side (4_1s)",
    "10_x": "10 consecutive on same side of CL (10_x)",
}


def _columns() -> tuple[Column, Column, Column]:
    return F.col("value"), F.col("zone_cl"), F.col("zone_sigma")


def _side(value: Column, high: Column, low: Column, strict: bool = True) -> Column:
    up, down = (value > high, value < low) if strict else (value >= high, value <= low)
    return F.when(up, 1).when(down, -1).otherwise(0)


def _all_same(side: Column, n: int, w: WindowSpec) -> Column:
    """The last n rows exist and are all +1, or all -1."""
    back = w.rowsBetween(-(n - 1), 0)
    same = (F.min(side).over(back) == 1) | (F.max(side).over(back) == -1)
    return (F.col(IDX) >= n - 1) & same


def _all_true(flag: Column, n: int, w: WindowSpec) -> Column:
    back = w.rowsBetween(-(n - 1), 0)
    return (F.col(IDX) >= n - 1) & (F.min(flag.cast("int")).over(back) == 1)


def _some_same(side: Column, n: int, window: int, w: WindowSpec) -> Column:
    """n of the last ``window`` rows on the side of the current one."""
    back = w.rowsBetween(-(window - 1), 0)
    ups = F.sum((side == 1).cast("int")).over(back)
    downs = F.sum((side == -1).cast("int")).over(back)
    hit = ((side == 1) & (ups >= n)) | ((side == -1) & (downs >= n))
    return (F.col(IDX) >= window - 1) & hit


class _Rule:
    """Look-back in rows, helper columns, and the flag."""

    def __init__(
        self,
        halo: int,
        flag: Callable[[WindowSpec], Column],
        helpers: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
    ):
        self.halo, self.flag, self.helpers = halo, flag, helpers


def _steps(w: WindowSpec) -> dict[str, Column]:
    """Direction of the step into each row; null on the first row."""
    return {"_step": F.signum(F.col("value") - F.lag("value").over(w))}


def _turns(w: WindowSpec) -> dict[str, Column]:
    """True where the step is a reversal of the step before."""
    step = F.col("_step")
    return {"_turn": (step != 0) & (step == -F.lag("_step").over(w))}


def _nelson(test: int, n: int, window: int) -> _Rule:
    x, cl, sigma = _columns()
    inside = (x > cl - sigma) & (x < cl + sigma)
    if test == 1:
        return _Rule(0, lambda w: (x > F.col("ucl")) | (x < F.col("lcl")))
    if test == 2:
        return _Rule(n - 1, lambda w: _all_same(_side(x, cl, cl), n, w))
    if test == 3:
        back = n - 2
        return _Rule(
            n - 1,
            lambda w: (F.col(IDX) >= n - 1)
            & (
                (F.min("_step").over(w.rowsBetween(-back, 0)) == 1)
                | (F.max("_step").over(w.rowsBetween(-back, 0)) == -1)
            ),
        )
    if test == 4:
        # n alternating points: n - 1 steps, each but the first reversing the one before
        back = n - 3
        return _Rule(
            n - 1,
            lambda w: (F.col(IDX) >= n - 1)
            & (F.min(F.col("_turn").cast("int")).over(w.rowsBetween(-back, 0)) == 1),
        )
    if test in (5, 6):
        width = 2.0 if test == 5 else 1.0
        side = _side(x, cl + width * sigma, cl - width * sigma, strict=False)
        return _Rule(window - 1, lambda w: _some_same(side, n, window, w))
    if test == 7:
        return _Rule(n - 1, lambda w: _all_true(inside, n, w))
    if test == 8:
        return _Rule(n - 1, lambda w: _all_true(~inside, n, w))
    raise ValueError(f"unknown Nelson test {test}")


def _westgard(rule: str) -> _Rule:
    x, cl, sigma = _columns()
    one = _side(x, cl + sigma, cl - sigma)
    two = _side(x, cl + 2.0 * sigma, cl - 2.0 * sigma)
    if rule == "1_2s":
        return _Rule(0, lambda w: two != 0)
    if rule == "1_3s":
        return _Rule(0, lambda w: _side(x, cl + 3.0 * sigma, cl - 3.0 * sigma) != 0)
    if rule == "2_2s":
        return _Rule(1, lambda w: _all_same(two, 2, w))
    if rule == "r_4s":
        return _Rule(
            1,
            lambda w: F.coalesce(
                F.abs(x - F.lag("value").over(w)) > 4.0 * sigma, F.lit(False)
            ),
        )
    if rule == "4_1s":
        return _Rule(3, lambda w: _all_same(one, 4, w))
    if rule == "10_x":
        return _Rule(9, lambda w: _all_same(_side(x, cl, cl), 10, w))
    raise ValueError(f"unknown Westgard rule {rule!r}")


def chosen_rules(
    nelson: Iterable[int] = NELSON_DEFAULT,
    westgard: Iterable[str] = (),
    custom: Mapping[int, Mapping[str, int]] | None = None,
) -> dict[str, _Rule]:
    rules: dict[str, _Rule] = {}
    for test in nelson:
        own = (custom or {}).get(test, {})
        n = own.get("n", NELSON_N.get(test, 1))
        window = own.get("window", NELSON_WINDOW.get(test, n))
        if n < 1 or window < n:
            raise ValueError(f"Nelson test {test} needs 1 <= n <= window, got {n}, {window}")
        if test in (3, 4) and n < 3:
            raise ValueError(f"Nelson test {test} needs n of at least 3, got {n}")
        rules[str(test)] = _nelson(test, n, window)
    for rule in westgard:
        rules[rule] = _westgard(rule)
    return rules


def flag_name(test_id: str) -> str:
    return f"rule_{test_id}"


def with_rules(
    chart: Chart,
    nelson: Iterable[int] = NELSON_DEFAULT,
    westgard: Iterable[str] = (),
    custom: Mapping[int, Mapping[str, int]] | None = None,
    also: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
) -> Sequence:
    """The chart's points with one boolean column per rule.

    ``also`` adds columns that look back one row, over the same frame.
    """
    rules = chosen_rules(nelson, westgard, custom)
    seq = chart.sequence
    if not rules and also is None:
        return seq
    helpers = [] if also is None else [also]
    if {"3", "4"} & rules.keys():
        helpers.append(_steps)
    if "4" in rules:
        helpers.append(_turns)

    def flags(w: WindowSpec) -> dict[str, Column]:
        return {
            flag_name(t): F.coalesce(r.flag(w), F.lit(False)) for t, r in rules.items()
        }

    halo = max([r.halo for r in rules.values()] + ([1] if also else []))
    seq = seq.frame(halo, *helpers, flags)
    return seq.drop("_step", "_turn")


def point_rules(flagged: Sequence, rules: Iterable[str]) -> DataFrame:
    """One row per flagged point with the rules that fired there."""
    fired = F.array_compact(
        F.array(*[F.when(F.col(flag_name(t)), F.lit(t)) for t in rules])
    )
    return (
        flagged.df.select(*flagged.keys, IDX, "value", fired.alias("rules"))
        .where(F.size("rules") > 0)
    )


def violations(
    chart: Chart,
    nelson: Iterable[int] = NELSON_DEFAULT,
    westgard: Iterable[str] = (),
    custom: Mapping[int, Mapping[str, int]] | None = None,
) -> DataFrame:
    """Long form: one row per key, rule and flagged point."""
    nelson, westgard = tuple(nelson), tuple(westgard)
    flagged = with_rules(chart, nelson, westgard, custom)
    names = [*map(str, nelson), *westgard]
    if not names:
        raise ValueError("no rules chosen")
    return point_rules(flagged, names).select(
        *chart.keys, IDX, F.explode("rules").alias("test_id"), "value"
    )


def violation_counts(violations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rule that fires: points flagged, first and last of them."""
    return (
        violations.groupBy(*keys, "test_id")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min(IDX).alias("first_idx"),
            F.max(IDX).alias("last_idx"),
        )
        .withColumn("description", described(F.col("test_id")))
    )


def described(test_id: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in DESCRIPTIONS.items() for v in pair])
    return F.element_at(table, test_id)
