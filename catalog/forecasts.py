"""Drift and forecasts: orders per day and values per event type."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from catalog.base import case, table
from catalog.charts import EVENT_VALUES, events
from plumbline.operators import forecast
from plumbline.operators.series import Roles, sequence

SERIES = "event_type phase"
SEQ = """
seq AS (
  SELECT event_type, 'all' AS phase, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m
  FROM events WHERE value IS NOT NULL)"""
DRIFT_SQL = SEQ + """,
sl AS (SELECT event_type, phase, count(*) AS n, regr_slope(value, idx) AS slope, stddev_samp(value) AS sigma
       FROM seq GROUP BY ALL),
dr AS (SELECT *, least(1, abs(slope) / (sigma / sqrt(n))) AS drift_score FROM sl)"""


def seq(spark, d):
    return forecast.observations(events(spark, d), EVENT_VALUES)


@case("season_length", "F1", f"{SERIES} n# best_acf~ period#", SEQ + """,
va AS (SELECT event_type, sum((value - m) ** 2) AS v FROM seq GROUP BY 1),
lg AS (SELECT *, idx - lag AS at FROM (SELECT event_type, phase, idx, n, value - m AS dev, unnest(range(4, 49)) AS lag FROM seq)),
ac AS (
  SELECT a.event_type, a.phase, a.n, a.lag, sum(a.dev * (b.value - b.m)) / any_value(v) AS acf
  FROM lg a JOIN seq b ON a.event_type = b.event_type AND b.idx = a.at JOIN va ON va.event_type = a.event_type
  WHERE a.lag <= a.n // 2 GROUP BY ALL),
bs AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY acf DESC, lag) = 1),
answer AS (SELECT *, acf AS best_acf, CASE WHEN acf > 0.3 THEN lag ELSE 1 END AS period FROM bs)""")
def season_length(spark, d):
    return forecast.season_length(seq(spark, d))


@case("trend_slope", "F2", f"{SERIES} n# slope~ sigma~", DRIFT_SQL + ", answer AS (SELECT * FROM sl)")
def trend_slope(spark, d):
    return forecast.slope(seq(spark, d))


@case("drift_scores", "F3", f"{SERIES} drift_score~ drift_label", DRIFT_SQL + """,
answer AS (SELECT *, CASE WHEN drift_score > 0.7 THEN 'High drift' WHEN drift_score > 0.3 THEN 'Approaching drift'
                          ELSE 'Low drift' END AS drift_label FROM dr)""")
def drift_scores(spark, d):
    return forecast.drift(seq(spark, d))


@case("observed_values", "F7", f"{SERIES} idx# value~", """
raw AS (SELECT event_type, event_id, TRY_CAST(CASE WHEN value < 20 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
        FROM events),
answer AS (SELECT event_type, 'all' AS phase, value,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx
           FROM raw WHERE value IS NOT NULL)""")
def observed_values(spark, d):
    text = F.when(F.col("value") < 20, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return forecast.observations(events(spark, d).withColumn("value", text), EVENT_VALUES).df


# -- the whole forecast ---------------------------------------------------------------------
Z = NormalDist().inv_cdf(0.975)
HORIZON = 12
MONTHLY_SALES = Roles("sales", "month", "o_orderpriority")


def monthly_sales(spark, d):
    orders = table(spark, d, "orders")
    month = F.date_trunc("month", F.col("o_orderdate"))
    return orders.groupBy("o_orderpriority", month.alias("month")).agg(
        F.sum("o_totalprice").alias("sales")
    )


def _fit_sql(name: str, size: str) -> str:
    """Every model fitted on the rows before ``size``."""
    return f"""
{name} AS (
  SELECT key, min_by(v, idx) AS first, max_by(v, idx) AS last, regr_slope(v, idx) AS slope,
         regr_intercept(v, idx) AS icept, max_by(level, idx) AS level, count(*) AS size
  FROM lev WHERE idx < {size} GROUP BY key)"""


def _said(fit: str, idx: str, season: str) -> list[tuple[str, str]]:
    return [
        ("naive", f"{fit}.last"),
        ("drift", f"{fit}.last + ({idx} - {fit}.size + 1) * ({fit}.last - {fit}.first) / ({fit}.size - 1)"),
        ("linear", f"{fit}.icept + {fit}.slope * ({idx})"),
        ("seasonal", season),
        ("smoothing", f"{fit}.level"),
    ]


FORECAST_SQL = """
mon AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS v
        FROM orders GROUP BY ALL),
num AS (
  SELECT key, v, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY key) AS n,
         avg(v) OVER (PARTITION BY key) AS m, first_value(v) OVER w AS v0
  FROM mon WINDOW w AS (PARTITION BY key ORDER BY month)),
lg AS (SELECT key, idx, n, v - m AS dev, unnest(range(4, 49)) AS lag FROM num),
ac AS (
  SELECT a.key, a.lag, any_value(a.n) AS n, sum(a.dev * (b.v - b.m)) / any_value(t.total) AS acf
  FROM lg a JOIN num b ON a.key = b.key AND b.idx = a.idx - a.lag
  JOIN (SELECT key, sum((v - m) ** 2) AS total FROM num GROUP BY key) t ON t.key = a.key
  WHERE a.lag <= a.n // 2 GROUP BY ALL),
per AS (
  SELECT key, n, least(CASE WHEN acf > 0.3 THEN lag ELSE 1 END, greatest(n // 3, 1)) AS period FROM ac
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY acf DESC, lag) = 1),
siz AS (SELECT *, n - greatest(least(period, n // 3), CAST(ceil(n / 5) AS BIGINT)) AS train FROM per),
ex AS (SELECT *, idx - j AS at FROM (SELECT key, idx, v0, unnest(range(120)) AS j FROM num)),
sm AS (
  SELECT a.key, a.idx, sum(0.3 * pow(0.7, a.j) * b.v) + pow(0.7, a.idx + 1) * any_value(a.v0) AS level
  FROM ex a JOIN num b ON a.key = b.key AND b.idx = a.at GROUP BY a.key, a.idx),
lev AS (
  SELECT num.*, level, period, train, lag(level) OVER (PARTITION BY num.key ORDER BY num.idx) AS lev0,
         lag(num.v) OVER (PARTITION BY num.key ORDER BY num.idx) AS v1
  FROM num JOIN sm USING (key, idx) JOIN siz USING (key)),""" + _fit_sql("tf", "train") + "," + _fit_sql("ff", "n") + """,
tail AS (
  SELECT t.key, t.idx, t.v, s.v AS season FROM lev t
  JOIN lev s ON s.key = t.key AND s.idx < t.train AND s.idx >= t.train - t.period AND s.idx % t.period = t.idx % t.period
  WHERE t.idx >= t.train),
err AS (
  """ + " UNION ALL ".join(
    f"SELECT tail.key, {i} AS rank, '{m}' AS model, avg(abs((v - ({e})) / v)) AS mape "
    f"FROM tail JOIN tf USING (key) GROUP BY tail.key"
    for i, (m, e) in enumerate(_said("tf", "tail.idx", "season"))
) + """),
best AS (SELECT * FROM err QUALIFY row_number() OVER (PARTITION BY key ORDER BY mape, rank) = 1),
res AS (
  SELECT l.key, stddev_samp(l.v - CASE model WHEN 'linear' THEN icept + slope * l.idx
           WHEN 'smoothing' THEN coalesce(l.lev0, l.v0) WHEN 'drift' THEN l.v1 + (last - first) / (size - 1)
           WHEN 'seasonal' THEN e.v ELSE l.v1 END) AS sr
  FROM lev l JOIN best USING (key) JOIN ff USING (key)
  LEFT JOIN lev e ON e.key = l.key AND e.idx = l.idx - l.period GROUP BY l.key),
fut AS (SELECT siz.*, h, n + h - 1 AS x FROM siz, (SELECT unnest(range(1, 13)) AS h)),
raw AS (
  SELECT fut.*, best.model, best.mape, ff.last, sr, CASE best.model """ + " ".join(
    f"WHEN '{m}' THEN {e}" for m, e in _said("ff", "fut.x", "s.v")
) + """ END AS y0
  FROM fut JOIN best USING (key) JOIN ff USING (key) JOIN res USING (key)
  JOIN lev s ON s.key = fut.key AND s.idx >= fut.n - fut.period AND s.idx % fut.period = fut.x % fut.period),
pro AS (
  SELECT *, y0 + last - first_value(y0) OVER (PARTITION BY key ORDER BY h) AS y,
         """ + repr(Z) + """ * sr * sqrt(1 + h / (n / 2.0)) AS width FROM raw)"""


@case("forecast_projection", "F5 F6", "o_orderpriority h# x# y~ upper~ lower~", FORECAST_SQL + """,
answer AS (SELECT key AS o_orderpriority, h, x, y, y + width AS upper, y - width AS lower FROM pro)""")
def forecast_projection(spark, d):
    return forecast.forecast(monthly_sales(spark, d), MONTHLY_SALES, horizon=HORIZON)[1]


@case("forecast_summary", "F4 F5", "o_orderpriority n# period# model mape~ residual_sigma~ steps_to_breach#",
      FORECAST_SQL + """,
lim AS (SELECT avg(v) + 2 * stddev_samp(v) AS u, avg(v) - 2 * stddev_samp(v) AS l FROM num),
answer AS (SELECT key AS o_orderpriority, any_value(n) AS n, any_value(period) AS period, any_value(model) AS model,
                  any_value(mape) AS mape, any_value(sr) AS residual_sigma,
                  min(h) FILTER (y >= u OR y <= l) AS steps_to_breach
           FROM pro, lim GROUP BY key)""")
def forecast_summary(spark, d):
    sales = monthly_sales(spark, d)
    mean, sd = sales.agg(F.avg("sales"), F.stddev_samp("sales")).first()
    return forecast.forecast(
        sales, MONTHLY_SALES, horizon=HORIZON, ucl=mean + 2 * sd, lcl=mean - 2 * sd
    )[0]


@case("forecast_against_own_limits", "F4", "o_orderpriority n# steps_to_breach# status", FORECAST_SQL + """,
lim AS (SELECT key, avg(v) + stddev_samp(v) AS u, avg(v) - stddev_samp(v) AS l FROM num GROUP BY key),
answer AS (SELECT key AS o_orderpriority, any_value(n) AS n, min(h) FILTER (y >= u OR y <= l) AS steps_to_breach,
                  'forecast' AS status
           FROM pro JOIN lim USING (key) GROUP BY key)""")
def forecast_against_own_limits(spark, d):
    sales = monthly_sales(spark, d)
    mean, sd = F.avg("sales"), F.stddev_samp("sales")
    limits = sales.groupBy("o_orderpriority").agg((mean + sd).alias("ucl"), (mean - sd).alias("lcl"))
    limits = limits.withColumn("phase", F.lit("all"))
    return forecast.forecast(sales, MONTHLY_SALES, horizon=HORIZON, limits=limits)[0]


@case("dense_positions", "O1", "l_orderkey# l_linenumber# l_partkey# l_suppkey# idx#", """
answer AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey,
           l_suppkey, l_shipdate, l_extendedprice) - 1 AS idx FROM lineitem)""")
def dense_positions(spark, d):
    """Positions by range partitioning, as for series too large for one task."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("l_returnflag", *order)
    return sequence(rows, "l_returnflag", order, block_rows=5000).df
