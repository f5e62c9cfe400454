"""Control chart constants for subgroups of 2..50 observations, as expressions.

The tables are small and fixed, so they travel inside the plan as literal arrays:
a lookup is a codegen'd ``element_at`` instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIZE, MAX_SIZE = 2, 50

# Fixed values (Harter 1960), for n = 2, 3, ..., 50.
D2 = (
    1.128, 1.693, 2.059, 2.326, 2.534, 2.704, 2.847, 2.970, 3.078, 3.173,
    3.258, 3.336, 3.407, 3.472, 3.532, 3.588, 3.640, 3.689, 3.735, 3.778,
    3.819, 3.858, 3.895, 3.931, 3.964, 3.997, 4.027, 4.057, 4.086, 4.113,
    4.139, 4.165, 4.189, 4.213, 4.236, 4.259, 4.280, 4.301, 4.322, 4.341,
    4.361, 4.379, 4.398, 4.415, 4.433, 4.450, 4.466, 4.482, 4.498,
)
D3 = (
    0.8525, 0.8884, 0.8798, 0.8641, 0.8480, 0.8332, 0.8198, 0.8078, 0.7971, 0.7873,
    0.7785, 0.7704, 0.7630, 0.7562, 0.7499, 0.7441, 0.7386, 0.7335, 0.7287, 0.7242,
    0.7199, 0.7159, 0.7121, 0.7084, 0.7050, 0.7017, 0.6986, 0.6955, 0.6927, 0.6899,
    0.6873, 0.6847, 0.6823, 0.6799, 0.6777, 0.6755, 0.6734, 0.6713, 0.6694, 0.6675,
    0.6657, 0.6639, 0.6622, 0.6605, 0.6589, 0.6574, 0.6559, 0.6544, 0.6530,
)
C4 = (
    0.7979, 0.8862, 0.9213, 0.9400, 0.9515, 0.9594, 0.9650, 0.9693, 0.9727, 0.9754,
    0.9776, 0.9794, 0.9810, 0.9823, 0.9835, 0.9845, 0.9854, 0.9862, 0.9869, 0.9876,
    0.9882, 0.9887, 0.9892, 0.9896, 0.9901, 0.9904, 0.9908, 0.9911, 0.9914, 0.9917,
    0.9920, 0.9922, 0.9925, 0.9927, 0.9929, 0.9931, 0.9933, 0.9935, 0.9936, 0.9938,
    0.9939, 0.9941, 0.9942, 0.9943, 0.9945, 0.9946, 0.9947, 0.9948, 0.9949,
)
C5 = (
    0.6028, 0.4633, 0.3889, 0.3412, 0.3076, 0.2820, 0.2622, 0.2459, 0.2321, 0.2202,
    0.2098, 0.2006, 0.1924, 0.1849, 0.1783, 0.1722, 0.1667, 0.1616, 0.1569, 0.1526,
    0.1485, 0.1448, 0.1413, 0.1380, 0.1349, 0.1320, 0.1292, 0.1266, 0.1242, 0.1219,
    0.1197, 0.1176, 0.1156, 0.1137, 0.1119, 0.1101, 0.1085, 0.1069, 0.1054, 0.1039,
    0.1025, 0.1012, 0.0999, 0.0987, 0.0975, 0.0963, 0.0952, 0.0942, 0.0932,
)
MEDIAN_MR_DIVISOR = 0.954

TABLES = {"d2": D2, "d3": D3, "c4": C4, "c5": C5}


def constant(name: str, n: int) -> float:
    if n < MIN_SIZE:
        raise ValueError(f"subgroup size must be at least {MIN_SIZE}, got {n}")
    return TABLES[name][min(n, MAX_SIZE) - MIN_SIZE]


def constant_of(name: str, n: Column) -> Column:
    """The constant for a size column: clamped above 50, null below 2."""
    table = F.array(*[F.lit(v) for v in TABLES[name]])
    position = F.least(n.cast("int"), F.lit(MAX_SIZE)) - (MIN_SIZE - 1)
    return F.when(n >= MIN_SIZE, F.element_at(table, position))


def d2(n: Column) -> Column:
    return constant_of("d2", n)


def d3(n: Column) -> Column:
    return constant_of("d3", n)


def c4(n: Column) -> Column:
    return constant_of("c4", n)


def c5(n: Column) -> Column:
    return constant_of("c5", n)


def limit_factors(n: Column) -> dict[str, Column]:
    """A2, A3, D3, D4, B3, B4 for a size column (D3 and B3 not below zero)."""
    spread = 3.0 * d3(n) / d2(n)
    scatter = 3.0 * c5(n) / c4(n)
    return {
        "a2": 3.0 / (d2(n) * F.sqrt(n)),
        "a3": 3.0 / (c4(n) * F.sqrt(n)),
        "lower_r": F.greatest(1.0 - spread, F.lit(0.0)),
        "upper_r": 1.0 + spread,
        "lower_s": F.greatest(1.0 - scatter, F.lit(0.0)),
        "upper_s": 1.0 + scatter,
    }
