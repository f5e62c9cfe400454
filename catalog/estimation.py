"""Estimates without excluded rows, recursions over many blocks, and fits that iterate."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import case, table
from catalog.charts import CHI2_3, DAILY, EVENT_VALUES, LINE_ROLES, LINE_VALUES, MONTHLY, SERIES, T2_SQL, days, events, months
from catalog.fragments import CONSTANTS, smoothed
from plumbline.operators import compare, multivariate, time_weighted
from plumbline.operators.series import Roles
from plumbline.plans.recipe import Recipe, analyze

# -- excluded rows ---------------------------------------------------------------------------
EXCLUDED_EVENTS = """
seq AS (
  SELECT event_type, 'all' AS phase, event_id, value, value > 200 AS out,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events WHERE value IS NOT NULL),
used AS (SELECT *, row_number() OVER w - 1 AS place, lag(value) OVER w AS prev, lag(value, 2) OVER w AS prev2
         FROM seq WHERE NOT out WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
par AS (SELECT event_type, avg(value) AS center, avg(abs(value - prev)) / 1.128 AS s, count(prev) AS n_used,
               avg(greatest(value, prev, prev2) - least(value, prev, prev2)) FILTER (place >= 2) AS mr3 FROM used GROUP BY 1)"""


def marked(spark, d):
    return events(spark, d).withColumn("out", F.col("value") > 200)


@case("excluded_ewma", "T32 O2 C20", f"{SERIES} idx# value~ ucl~ cl~ lcl~ excluded", EXCLUDED_EVENTS + """,
sm AS """ + smoothed("seq", "event_type, phase", {"e": "value"}, 0.2, 180) + """,
ew AS (SELECT seq.*, e + pow(0.8, seq.idx + 1) * center AS level, center,
              3 * s * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (seq.idx + 1)))) AS half
       FROM seq JOIN sm USING (event_type, phase, idx) JOIN par USING (event_type)),
answer AS (SELECT event_type, phase, idx, level AS value, center + half AS ucl, center AS cl, center - half AS lcl,
                  out AS excluded FROM ew)""")
def excluded_ewma(spark, d):
    return analyze(marked(spark, d), Recipe("ewma", EVENT_VALUES, exclude="out")).points


@case("excluded_moving_range", "T32 C6", f"{SERIES} sigma_hat~ mr_bar~", EXCLUDED_EVENTS + """,
answer AS (SELECT event_type, 'all' AS phase, mr3 / 1.693 AS sigma_hat, mr3 AS mr_bar FROM par)""")
def excluded_moving_range(spark, d):
    """Ranges of three rows, over the gaps that excluded rows leave, by the path for giant series."""
    options = {"span": 3, "block_rows": 300}
    return analyze(marked(spark, d), Recipe("mr", EVENT_VALUES, options, exclude="out")).params


@case("exclusion_reviews", "T32 M6", "event_type label value~ check_text", EXCLUDED_EVENTS + """,
answer AS (SELECT event_type, CAST(event_id AS VARCHAR) AS label, value,
                  'Point ' || event_id || ' is left out of the estimates: confirm that the reason still holds.' AS check_text
           FROM seq WHERE out)""")
def exclusion_reviews(spark, d):
    points = analyze(marked(spark, d), Recipe("imr", EVENT_VALUES, exclude="out")).points
    return compare.exclusion_reviews(points).withColumnRenamed("check", "check_text")


EXCLUDED_MONTHS = CONSTANTS + """,
rows AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS subgroup, l_quantity > 45 OR month(l_shipdate) = 7 AS out FROM lineitem),
sub AS (
  SELECT l_returnflag, 'all' AS phase, subgroup, count(*) AS n, avg(l_quantity) AS mean, min(l_shipdate) AS first,
         count(*) FILTER (NOT out) AS kept_n, avg(l_quantity) FILTER (NOT out) AS used_mean,
         max(l_quantity) FILTER (NOT out) - min(l_quantity) FILTER (NOT out) AS used_range
  FROM rows GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY first, subgroup) - 1 AS idx FROM sub),
par AS (SELECT l_returnflag, avg(used_mean) AS center, avg(used_range / d2) FILTER (kept_n >= 2) AS s
        FROM num LEFT JOIN constants c ON c.n = least(kept_n, 50) GROUP BY 1)"""


@case("excluded_xbar", "T32 O2 C2", "l_returnflag phase idx# value~ ucl~ cl~ lcl~ excluded", EXCLUDED_MONTHS + """,
answer AS (SELECT num.*, mean AS value, center + 3 * s / sqrt(n) AS ucl, center AS cl, center - 3 * s / sqrt(n) AS lcl,
                  kept_n = 0 AS excluded FROM num JOIN par USING (l_returnflag))""")
def excluded_xbar(spark, d):
    """Some rows of most subgroups and all rows of every July are excluded."""
    rows = months(spark, d).withColumn("out", (F.col("l_quantity") > 45) | (F.month("l_shipdate") == 7))
    return analyze(rows, Recipe("xbar_r", MONTHLY, exclude="out")).points


EXCLUDED_DAYS = """
day AS (
  SELECT strftime(ts, '%Y-%m-%d') AS subgroup, min(event_id) AS first, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS x,
         CAST(nullif(count(*) FILTER (NOT out), 0) AS DOUBLE) AS un,
         CAST(count(*) FILTER (event_type = 'error' AND NOT out) AS DOUBLE) AS ux
  FROM (SELECT *, event_id % 11 = 0 OR day(ts) IN (5, 20) AS out FROM events) GROUP BY ALL),
num AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS idx FROM day),
tot AS (SELECT sum(ux) FILTER (un > 0) / sum(un) AS rate FROM num),
z AS (SELECT un, (ux / un - rate) / sqrt(rate * (1 - rate) / un) AS z, lag((ux / un - rate) / sqrt(rate * (1 - rate) / un)) OVER (ORDER BY idx) AS prev
      FROM num, tot WHERE un > 0),
lz AS (SELECT avg(abs(z - prev)) / 1.128 AS sigma_z FROM z)"""


def marked_days(spark, d):
    return days(spark, d).withColumn("out", (F.col("event_id") % 11 == 0) | F.dayofmonth("ts").isin(5, 20))


@case("excluded_p", "T32 C9", "idx# value~ ucl~ cl~ lcl~ excluded", EXCLUDED_DAYS + """,
answer AS (SELECT idx, x / n AS value, least(rate + 3 * sqrt(rate * (1 - rate) / n), 1) AS ucl, rate AS cl,
                  greatest(rate - 3 * sqrt(rate * (1 - rate) / n), 0) AS lcl, un IS NULL AS excluded FROM num, tot)""")
def excluded_p(spark, d):
    return analyze(marked_days(spark, d), Recipe("p", DAILY, exclude="out")).points


@case("excluded_laney_p", "T32 C13", "idx# value~ ucl~ lcl~ excluded", EXCLUDED_DAYS + """,
answer AS (SELECT idx, x / n AS value, least(rate + 3 * sigma_z * sqrt(rate * (1 - rate) / n), 1) AS ucl,
                  greatest(rate - 3 * sigma_z * sqrt(rate * (1 - rate) / n), 0) AS lcl, un IS NULL AS excluded FROM num, tot, lz)""")
def excluded_laney_p(spark, d):
    return analyze(marked_days(spark, d), Recipe("laney_p", DAILY, exclude="out")).points


#: 0.9973 quantile of chi-square with 64 degrees of freedom (a fixed value).
CHI2_64 = 99.97494270898326


@case("excluded_hotelling", "T32 C23", "l_returnflag phase idx# value^ ucl^ excluded",
      T2_SQL.replace("FROM src GROUP BY", "FROM src WHERE a <= 45 GROUP BY") + f""",
answer AS (SELECT t2.*, c0 + c1 + c2 AS value, {CHI2_3} AS ucl, x + ma > 45 AS excluded FROM t2)""")
def excluded_hotelling(spark, d):
    rows = table(spark, d, "lineitem").withColumn("out", F.col("l_quantity") > 45)
    options = {"columns": LINE_VALUES, "stage": 2}
    return analyze(rows, Recipe("hotelling_t2", LINE_ROLES, options, exclude="out")).points


# -- recursions over many blocks -----------------------------------------------------------------
RECURSIVE = "RECURSIVE " + EXCLUDED_EVENTS.strip().split(",\nused AS")[0]


@case("ewma_small_lambda_blocks", "C20 O1", f"{SERIES} idx# value~", RECURSIVE + """,
level AS (
  SELECT event_type, phase, idx, 90.0 + 1e-6 * (value - 90.0) AS value FROM seq WHERE idx = 0
  UNION ALL
  SELECT s.event_type, s.phase, s.idx, 1e-6 * s.value + (1 - 1e-6) * l.value
  FROM level l JOIN seq s ON s.event_type = l.event_type AND s.idx = l.idx + 1),
answer AS (SELECT * FROM level)""")
def ewma_small_lambda_blocks(spark, d):
    """Weights that hardly fade, over many blocks per series."""
    return time_weighted.ewma(events(spark, d), EVENT_VALUES, lam=1e-6, target=90.0, block_rows=150).points


@case("cusum_head_start_blocks", "C21 C22 O1", f"{SERIES} idx# c_plus^ c_minus^ total^", RECURSIVE + """,
z AS (SELECT event_type, phase, idx, (value - 100.0) / 37.0 AS z FROM seq),
state AS (
  SELECT event_type, phase, idx, greatest(0, 2.5 + z - 0.5) AS c_plus, least(0, -2.5 + z + 0.5) AS c_minus, z AS total
  FROM z WHERE idx = 0
  UNION ALL
  SELECT z.event_type, z.phase, z.idx, greatest(0, s.c_plus + z - 0.5), least(0, s.c_minus + z + 0.5), s.total + z
  FROM state s JOIN z ON z.event_type = s.event_type AND z.idx = s.idx + 1),
answer AS (SELECT * FROM state)""")
def cusum_head_start_blocks(spark, d):
    known = {"target": 100.0, "sigma": 37.0, "block_rows": 150}
    chart = time_weighted.cusum(events(spark, d), EVENT_VALUES, head_start=2.5, **known)
    return chart.sequence.df.withColumnRenamed("_total", "total")


# -- long vectors --------------------------------------------------------------------------------
def wide_sql(size: int) -> str:
    """Centred vectors ``dev``, their covariance ``cov`` and its inverse ``inv`` by Gauss and Jordan."""
    return f"""RECURSIVE
raw AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
dims AS (SELECT idx, unnest(range(1, {size} + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM raw),
dev AS (SELECT idx, i, x - avg(x) OVER (PARTITION BY i) AS d FROM dims),
cov AS (SELECT a.i, b.i AS j, sum(a.d * b.d) / (count(*) - 1) AS v FROM dev a JOIN dev b USING (idx) GROUP BY 1, 2),
gj AS (
  SELECT 0 AS k, i, j, v FROM cov
  UNION ALL SELECT 0, i, {size} + j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM cov
), steps AS (
  SELECT k, i, j, v FROM gj
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN r / top ELSE v - f * r / top END FROM (
    SELECT *, max(v) FILTER (i = k + 1) OVER (PARTITION BY j) AS r, max(v) FILTER (j = k + 1) OVER (PARTITION BY i) AS f,
           max(v) FILTER (i = k + 1 AND j = k + 1) OVER () AS top FROM steps) WHERE k < {size}),
inv AS (SELECT i, j - {size} AS j, v FROM steps WHERE k = {size} AND j > {size})"""


@case("mewma_chart", "C24", "phase idx# value^ ucl^ signal", wide_sql(64) + f""",
sm AS (SELECT a.idx, b.i, sum(0.2 * pow(0.8, a.idx - b.idx) * b.d) AS z
       FROM raw a JOIN dev b ON b.idx <= a.idx AND b.idx > a.idx - 180 GROUP BY 1, 2),
t2 AS (SELECT p.idx, sum(p.z * inv.v * q.z) / (0.2 / 1.8 * (1 - pow(0.8, 2 * (p.idx + 1)))) AS value
       FROM sm p JOIN inv ON inv.i = p.i JOIN sm q ON q.idx = p.idx AND q.i = inv.j GROUP BY 1),
answer AS (SELECT 'all' AS phase, idx, value, {CHI2_64} AS ucl, value > {CHI2_64} AS signal FROM t2)""")
def mewma_chart(spark, d):
    """All 64 dimensions of every vector."""
    return multivariate.mewma(table(spark, d, "embeddings"), Roles("embedding", "vec_id"), "embedding", size=64).points


@case("hotelling_long_vectors", "C23 A15", "phase idx# value^ share_0^ share_63^", wide_sql(64) + """,
part AS (SELECT p.idx, p.i, p.d * sum(inv.v * q.d) AS share
         FROM dev p JOIN inv ON inv.i = p.i JOIN dev q ON q.idx = p.idx AND q.i = inv.j GROUP BY p.idx, p.i, p.d),
answer AS (SELECT 'all' AS phase, idx, sum(share) AS value, max(share) FILTER (i = 1) AS share_0, max(share) FILTER (i = 64) AS share_63
           FROM part GROUP BY idx)""")
def hotelling_long_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    points = multivariate.hotelling_t2(rows, Roles("embedding", "vec_id"), "embedding", size=64, block_rows=200).points
    return points.select("*", *[F.get("contributions", i).alias(f"share_{i}") for i in (0, 63)])
