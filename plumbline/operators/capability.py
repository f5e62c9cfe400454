"""Process capability from raw values and the chart's sigma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chart import Chart, measurements
from plumbline.operators.series import Roles, join_keys

NOT_CAPABLE_KINDS = ("hotelling_t2", "mewma", "run")
GOOD, MARGINAL = 1.33, 1.0


def capability(
    df: DataFrame, roles: Roles, chart: Chart, usl: float, lsl: float, *, missing: str = "drop"
) -> DataFrame:
    """cp, cpk, pp, ppk per key, rounded to 4 digits; null where undefined."""
    if chart.kind in NOT_CAPABLE_KINDS:
        raise ValueError(f"capability is not defined for chart {chart.kind}")
    raw = measurements(df, roles, missing=missing).groupBy(*roles.keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sigma_overall"),
        F.count("value").alias("n"),
    )
    sigma = chart.params.select(*chart.keys, F.col("sigma_hat").alias("sigma_within"))
    table = join_keys(raw, sigma, roles.keys)
    valid = (F.col("n") >= 2) & (F.col("sigma_within") > 0) & (F.col("sigma_overall") > 0)
    if usl <= lsl:
        valid = F.lit(False)

    def index(width: float, spread: Column) -> Column:
        return F.round(F.when(valid, width / spread), 4)

    def nearest(sigma: Column) -> Column:
        gap = F.least(usl - F.col("mean"), F.col("mean") - lsl)
        return F.round(F.when(valid, gap / (3.0 * sigma)), 4)

    within, overall = F.col("sigma_within"), F.col("sigma_overall")
    return table.withColumns(
        {
            "cp": index(usl - lsl, 6.0 * within),
            "cpk": nearest(within),
            "pp": index(usl - lsl, 6.0 * overall),
            "ppk": nearest(overall),
        }
    )


def grade(index: Column, good: float = GOOD, marginal: float = MARGINAL) -> Column:
    return (
        F.when(index >= good, "good").when(index >= marginal, "marginal")
        .when(index.isNotNull(), "poor")
    )
