"""SQL shared by several checks: the same definitions written independently for DuckDB."""

from plumbline.functions.constants import C4, C5, D2, D3

CONSTANTS = "constants(n, d2, d3, c4, c5) AS (VALUES " + ", ".join(
    f"({n}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))"
    for n, a, b, c, d in zip(range(2, 51), D2, D3, C4, C5)
) + ")"

# Individuals: events.value per event_type in order of event_id, limits from moving ranges.
EVENTS = """
seq AS (
  SELECT event_type, 'all' AS phase, event_id, value,
         row_number() OVER w - 1 AS idx, lag(value) OVER w AS prev
  FROM events WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
par AS (
  SELECT event_type, phase, avg(value) AS center, avg(abs(value - prev)) AS mr_bar,
         avg(abs(value - prev)) / 1.128 AS sigma_hat, count(prev) AS n_used, count(*) AS n
  FROM seq GROUP BY ALL),
pts AS (
  SELECT seq.*, p.center, p.sigma_hat, p.center + 3 * p.sigma_hat AS ucl, p.center AS cl,
         p.center - 3 * p.sigma_hat AS lcl,
         abs(seq.value - seq.prev) AS mr
  FROM seq JOIN par p USING (event_type, phase))"""

# Subgroups: lineitem.l_quantity by month of shipping, series l_returnflag.
MONTHS = CONSTANTS + """,
sub AS (
  SELECT l_returnflag, 'all' AS phase, strftime(l_shipdate, '%Y-%m') AS subgroup,
         count(*) AS n, avg(l_quantity) AS mean, max(l_quantity) - min(l_quantity) AS range,
         coalesce(stddev_samp(l_quantity), 0) AS std, min(l_shipdate) AS first
  FROM lineitem GROUP BY ALL),
num AS (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY first, subgroup) - 1 AS idx
  FROM sub),
k AS (
  SELECT num.*, c.d2, c.d3, c.c4, c.c5
  FROM num LEFT JOIN constants c ON c.n = least(num.n, 50)),
sig AS (
  SELECT l_returnflag, phase, avg(mean) AS grand,
         avg(range / d2) AS sigma_r, avg(std / c4) AS sigma_s, count(d2) AS n_used,
         avg(range) AS r_bar, avg(std) AS s_bar, count(*) / sum(1.0 / n) AS h
  FROM k GROUP BY ALL)"""

# Days with errors: defects and defectives per day from events.
DAYS = """
day AS (
  SELECT 'all' AS phase, strftime(ts, '%Y-%m-%d') AS subgroup, min(event_id) AS first,
         CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS x
  FROM events GROUP BY ALL),
num AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS idx FROM day),
tot AS (SELECT sum(x) / sum(n) AS rate, avg(n) AS n_bar, count(*) AS n_used FROM num)"""

# Rule flags over pts(event_type, phase, idx, value, center, sigma_hat, ucl, lcl).
RULES = EVENTS + """,
z AS (
  SELECT *, sign(value - lag(value) OVER w) AS step,
         CASE WHEN value > center THEN 1 WHEN value < center THEN -1 ELSE 0 END AS side,
         CASE WHEN value >= center + 2 * sigma_hat THEN 1
              WHEN value <= center - 2 * sigma_hat THEN -1 ELSE 0 END AS zone_a,
         CASE WHEN value >= center + sigma_hat THEN 1
              WHEN value <= center - sigma_hat THEN -1 ELSE 0 END AS zone_b,
         CASE WHEN value > center + sigma_hat THEN 1
              WHEN value < center - sigma_hat THEN -1 ELSE 0 END AS beyond_1,
         CASE WHEN value > center + 2 * sigma_hat THEN 1
              WHEN value < center - 2 * sigma_hat THEN -1 ELSE 0 END AS beyond_2,
         CASE WHEN value > center - sigma_hat AND value < center + sigma_hat
              THEN 1 ELSE 0 END AS inside
  FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY idx)),
zz AS (
  SELECT *, CASE WHEN step <> 0 AND step = -lag(step) OVER (PARTITION BY event_type ORDER BY idx)
                 THEN 1 ELSE 0 END AS turn
  FROM z),
f AS (
  SELECT *,
    value > ucl OR value < lcl AS r1,
    idx >= 8 AND abs(sum(side) OVER (w ROWS 8 PRECEDING)) = 9 AS r2,
    idx >= 5 AND abs(sum(step) OVER (w ROWS 4 PRECEDING)) = 5 AS r3,
    idx >= 13 AND sum(turn) OVER (w ROWS 11 PRECEDING) = 12 AS r4,
    idx >= 2 AND zone_a <> 0
      AND sum(CASE zone_a WHEN 1 THEN 1 ELSE 0 END) OVER (w ROWS 2 PRECEDING)
          >= CASE zone_a WHEN 1 THEN 2 ELSE 0 END
      AND sum(CASE zone_a WHEN -1 THEN 1 ELSE 0 END) OVER (w ROWS 2 PRECEDING)
          >= CASE zone_a WHEN -1 THEN 2 ELSE 0 END AS r5,
    idx >= 4 AND zone_b <> 0
      AND sum(CASE zone_b WHEN 1 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING)
          >= CASE zone_b WHEN 1 THEN 4 ELSE 0 END
      AND sum(CASE zone_b WHEN -1 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING)
          >= CASE zone_b WHEN -1 THEN 4 ELSE 0 END AS r6,
    idx >= 14 AND sum(inside) OVER (w ROWS 14 PRECEDING) = 15 AS r7,
    idx >= 7 AND sum(inside) OVER (w ROWS 7 PRECEDING) = 0 AS r8,
    beyond_2 <> 0 AS w_1_2s,
    value > center + 3 * sigma_hat OR value < center - 3 * sigma_hat AS w_1_3s,
    idx >= 1 AND abs(sum(beyond_2) OVER (w ROWS 1 PRECEDING)) = 2 AS w_2_2s,
    coalesce(abs(value - prev) > 4 * sigma_hat, false) AS w_r_4s,
    idx >= 3 AND abs(sum(beyond_1) OVER (w ROWS 3 PRECEDING)) = 4 AS w_4_1s,
    idx >= 9 AND abs(sum(side) OVER (w ROWS 9 PRECEDING)) = 10 AS w_10_x
  FROM zz WINDOW w AS (PARTITION BY event_type ORDER BY idx)),
vio AS (
  SELECT event_type, phase, idx, value, test_id FROM (
    SELECT event_type, phase, idx, value, unnest([
      CASE WHEN r1 THEN '1' END, CASE WHEN r2 THEN '2' END, CASE WHEN r3 THEN '3' END,
      CASE WHEN r4 THEN '4' END, CASE WHEN r5 THEN '5' END, CASE WHEN r6 THEN '6' END,
      CASE WHEN r7 THEN '7' END, CASE WHEN r8 THEN '8' END,
      CASE WHEN w_1_2s THEN '1_2s' END, CASE WHEN w_1_3s THEN '1_3s' END,
      CASE WHEN w_2_2s THEN '2_2s' END, CASE WHEN w_r_4s THEN 'r_4s' END,
      CASE WHEN w_4_1s THEN '4_1s' END, CASE WHEN w_10_x THEN '10_x' END]) AS test_id FROM f)
  WHERE test_id IS NOT NULL),
vio5 AS (SELECT * FROM vio WHERE test_id IN ('1', '2', '3', '4', '5')),
vio8 AS (SELECT * FROM vio WHERE length(test_id) = 1)"""


def smoothed(source: str, keys: str, columns: dict[str, str], lam: float, reach: int) -> str:
    """Weighted sums over the last ``reach`` rows; (1 - lam)**reach is below 1e-16."""
    sums = ", ".join(
        f"sum({lam} * pow({1 - lam}, j.j) * b.{x}) AS {name}" for name, x in columns.items()
    )
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    head = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""(
  SELECT {head}, a.idx, {sums.replace("j.j", "a.j")}
  FROM (SELECT *, idx - j AS at FROM (SELECT {keys}, idx, unnest(range({reach})) AS j FROM {source})) a
  JOIN {source} b ON {on} AND b.idx = a.at
  GROUP BY {head}, a.idx)"""
