"""Rules, capability, findings and comparison of methods."""

from __future__ import annotations

from functools import cache

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.base import case, table
from catalog.charts import EVENT_VALUES, EWMA_SQL, MONTHLY, events, months
from catalog.fragments import EVENTS, MONTHS, RULES
from plumbline.operators import compare, findings, rules, time_weighted, variables
from plumbline.operators.capability import capability, grade
from plumbline.operators.profile import summary_statistics
from plumbline.operators.series import Roles
from plumbline.operators.subgroups import axis_labels, harmonic_size, phase_table, subgroups, typical_size
from plumbline.plans.recipe import Recipe, analyze

ALL_NELSON = tuple(range(1, 9))
SERIES = "event_type phase"


def chart(spark, d):
    return variables.imr(events(spark, d), EVENT_VALUES)


# -- one query per rule -------------------------------------------------------------
def _rule(name: str, row: str, nelson=(), westgard=(), test_id=""):
    @case(name, row, f"{SERIES} idx# value~ test_id",
          RULES + f", answer AS (SELECT * FROM vio WHERE test_id = '{test_id}')")
    def run(spark, d):
        return rules.violations(chart(spark, d), nelson, westgard)


NAMES = ("beyond_limits", "same_side", "trend", "alternating", "zone_a", "zone_b",
         "inside_zone_c", "outside_zone_c")
for _i, _name in enumerate(NAMES, start=1):
    _rule(f"nelson_{_i}_{_name}", f"R{_i}", nelson=(_i,), test_id=str(_i))
for _i, _name in enumerate(rules.WESTGARD):
    _rule(f"westgard_{_name}", f"R{9 + _i}", westgard=(_name,), test_id=_name)


@case("all_rules_at_once", "R15", f"{SERIES} idx# value~ test_id", RULES + ", answer AS (SELECT * FROM vio)")
def all_rules_at_once(spark, d):
    return rules.violations(chart(spark, d), ALL_NELSON, rules.WESTGARD)


@case("all_rules_blocks", "R15 O1", f"{SERIES} idx# value~ test_id", RULES + ", answer AS (SELECT * FROM vio)")
def all_rules_blocks(spark, d):
    blocks = variables.imr(events(spark, d), EVENT_VALUES, block_rows=400)
    return rules.violations(blocks, ALL_NELSON, rules.WESTGARD)


@case("default_rules_counts", "R15", f"{SERIES} test_id n_points# first_idx# last_idx#", RULES + """,
answer AS (SELECT event_type, phase, test_id, count(*) AS n_points, min(idx) AS first_idx,
                  max(idx) AS last_idx FROM vio5 GROUP BY ALL)""")
def default_rules_counts(spark, d):
    fired = rules.violations(chart(spark, d))
    return rules.violation_counts(fired, ["event_type", "phase"])


@case("rules_with_own_sizes", "R15", f"{SERIES} idx# test_id", RULES + """,
own AS (
  SELECT *, idx >= 5 AND abs(sum(side) OVER (w ROWS 5 PRECEDING)) = 6 AS own_2,
         idx >= 3 AND abs(sum(step) OVER (w ROWS 2 PRECEDING)) = 3 AS own_3
  FROM zz WINDOW w AS (PARTITION BY event_type ORDER BY idx)),
answer AS (
  SELECT event_type, phase, idx, '2' AS test_id FROM own WHERE own_2
  UNION ALL SELECT event_type, phase, idx, '3' FROM own WHERE own_3)""")
def rules_with_own_sizes(spark, d):
    return rules.violations(chart(spark, d), (2, 3), custom={2: {"n": 6}, 3: {"n": 4}})


@case("rules_per_point", "R16", f"{SERIES} idx# rules", RULES + """,
answer AS (SELECT event_type, phase, idx, string_agg(test_id, ',' ORDER BY test_id) AS rules
           FROM vio8 GROUP BY ALL)""")
def rules_per_point(spark, d):
    flagged = rules.with_rules(chart(spark, d), ALL_NELSON)
    points = rules.point_rules(flagged, [str(t) for t in ALL_NELSON])
    return points.withColumn("rules", F.array_join(F.sort_array("rules"), ","))


# -- subgroup summaries --------------------------------------------------------------
@case("subgroup_statistics", "A10", "l_returnflag phase subgroup idx# n# mean~ range~ std~",
      MONTHS + ", answer AS (SELECT * FROM num)")
def subgroup_statistics(spark, d):
    return subgroups(months(spark, d), MONTHLY).df


@case("rows_without_subgroup", "A10", "phase subgroup idx# n# mean~", """
src AS (SELECT event_id, value, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS g FROM events),
sub AS (
  SELECT 'all' AS phase, g AS subgroup, CASE WHEN g IS NULL THEN event_id END AS solo,
         min(event_id) AS first, count(*) AS n, avg(value) AS mean FROM src WHERE value IS NOT NULL GROUP BY ALL),
answer AS (SELECT *, row_number() OVER (ORDER BY first, subgroup) - 1 AS idx FROM sub)""")
def rows_without_subgroup(spark, d):
    rows = events(spark, d).withColumn("g", F.when(F.col("event_type") != "error", F.col("event_type")))
    return subgroups(rows, Roles("value", "event_id", subgroup="g"), ("mean",)).df


@case("phase_ranges", "A11", "event_type phase phase_rank# start_index# end_index#", """
src AS (SELECT *, CAST(month(ts) AS VARCHAR) AS phase FROM events),
ph AS (SELECT event_type, phase, min(event_id) AS first, count(value) AS n FROM src GROUP BY ALL),
answer AS (
  SELECT *, row_number() OVER w - 1 AS phase_rank, sum(n) OVER w - n AS start_index,
         sum(n) OVER w AS end_index
  FROM ph WINDOW w AS (PARTITION BY event_type ORDER BY first))""")
def phase_ranges(spark, d):
    rows = events(spark, d).withColumn("month", F.month("ts"))
    return phase_table(rows, Roles("value", "event_id", "event_type", phase="month"))


@case("default_phase", "A11", "phase n# center~", """
src AS (SELECT value, CASE WHEN event_type = 'error' OR event_type = 'view' THEN 'default'
                           ELSE event_type END AS phase FROM events WHERE value IS NOT NULL),
answer AS (SELECT phase, count(*) AS n, avg(value) AS center FROM src GROUP BY 1)""")
def default_phase(spark, d):
    kind = F.col("event_type")
    rows = events(spark, d).withColumn("p", F.when(kind == "view", "").when(kind != "error", kind))
    return variables.imr(rows, Roles("value", "event_id", phase="p")).params


@case("axis_labels", "A12", "l_returnflag phase idx# label", MONTHS + """,
answer AS (SELECT *, subgroup AS label FROM num)""")
def axis_label_query(spark, d):
    return axis_labels(variables.xbar_r(months(spark, d), MONTHLY).points, subgrouped=True)


@case("harmonic_and_typical_sizes", "A13 A14", "l_returnflag phase harmonic_n~ typical_n#", MONTHS + """,
freq AS (SELECT l_returnflag, n, count(*) AS many, min(idx) AS seen FROM num GROUP BY ALL),
answer AS (SELECT l_returnflag, 'all' AS phase, n AS typical_n, h AS harmonic_n
           FROM freq JOIN sig USING (l_returnflag)
           QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY many DESC, seen) = 1)""")
def harmonic_and_typical_sizes(spark, d):
    seq = subgroups(months(spark, d), MONTHLY, ("mean",))
    harmonic = seq.df.groupBy(*seq.keys).agg(harmonic_size().alias("harmonic_n"))
    return harmonic.join(typical_size(seq), seq.keys)


@case("constants_by_size", "K1 K2", "l_returnflag subgroup d2~ d3~ c4~ c5~ a2~ a3~ lower_r~ upper_r~ lower_s~ upper_s~",
      MONTHS + """,
answer AS (
  SELECT *, 3 / (d2 * sqrt(n)) AS a2, 3 / (c4 * sqrt(n)) AS a3, greatest(1 - 3 * d3 / d2, 0) AS lower_r,
         1 + 3 * d3 / d2 AS upper_r, greatest(1 - 3 * c5 / c4, 0) AS lower_s, 1 + 3 * c5 / c4 AS upper_s
  FROM k)""")
def constants_by_size(spark, d):
    from plumbline.functions import constants as k

    n = F.col("n")
    rows = subgroups(months(spark, d), MONTHLY, ("mean",)).df
    return rows.withColumns({"d2": k.d2(n), "d3": k.d3(n), "c4": k.c4(n), "c5": k.c5(n), **k.limit_factors(n)})


# -- capability -------------------------------------------------------------------------
CAP_SQL = EVENTS + """,
cap AS (
  SELECT event_type, phase, any_value(sigma_hat) AS sw, avg(value) AS m, stddev_samp(value) AS so
  FROM pts GROUP BY ALL),
able AS (
  SELECT event_type, phase, round(400 / (6 * sw), 4) AS cp,
         round(least(300 - m, m + 100) / (3 * sw), 4) AS cpk, round(400 / (6 * so), 4) AS pp,
         round(least(300 - m, m + 100) / (3 * so), 4) AS ppk FROM cap)"""


def able(spark, d):
    c = chart(spark, d)
    return c, capability(events(spark, d), EVENT_VALUES, c, usl=300.0, lsl=-100.0)


@case("capability_indices", "P1 P2", f"{SERIES} cp~ cpk~ pp~ ppk~ grade", CAP_SQL + """,
answer AS (SELECT *, CASE WHEN cpk >= 1.33 THEN 'good' WHEN cpk >= 1 THEN 'marginal' ELSE 'poor' END AS grade
           FROM able)""")
def capability_indices(spark, d):
    return able(spark, d)[1].withColumn("grade", grade(F.col("cpk")))


def only(spark, d, generator, **options):
    return findings.findings(findings.facts(chart(spark, d), **options), [generator])


# -- findings --------------------------------------------------------------------------------
FINDING = f"{SERIES} severity title metric_value~"


@case("finding_stability", "N1", FINDING, RULES + """,
t AS (SELECT event_type, phase, count(*) AS n FROM pts GROUP BY ALL),
v AS (SELECT event_type, phase, count(*) AS flags, count(DISTINCT test_id) AS kinds FROM vio5 GROUP BY ALL),
j AS (SELECT t.*, coalesce(flags, 0) AS flags, coalesce(kinds, 0) AS kinds FROM t LEFT JOIN v USING (event_type, phase)),
g AS (SELECT *, kinds <= 2 AND flags <= 3 AND flags / n * 100 <= 2 AS minor FROM j),
answer AS (
  SELECT *, CASE WHEN flags = 0 THEN 'good' WHEN minor THEN 'warning' ELSE 'danger' END AS severity,
         CASE WHEN flags = 0 THEN 'Process Stable' WHEN minor THEN 'Minor Instability'
              ELSE 'Process Unstable' END AS title, flags AS metric_value FROM g)""")
def finding_stability(spark, d):
    return only(spark, d, "stability")


@case("finding_per_rule", "N2", FINDING + " detail", RULES + """,
answer AS (
  SELECT event_type, phase, CASE WHEN test_id = '1' THEN 'danger' ELSE 'warning' END AS severity,
         'Rule ' || test_id AS title, count(*) AS metric_value,
         CASE test_id WHEN '1' THEN 'Point beyond control limits (Test 1)'
           WHEN '2' THEN '9 consecutive points on same side of CL (Test 2)'
           WHEN '3' THEN '6 consecutive points trending (Test 3)'
           WHEN '4' THEN '14 consecutive alternating points (Test 4)'
           WHEN '5' THEN '2 of 3 in Zone A or beyond, same side (Test 5)' END AS detail
  FROM vio5 GROUP BY event_type, phase, test_id)""")
def finding_per_rule(spark, d):
    return only(spark, d, "rule")


@case("finding_phase_shift", "N3", "o_orderpriority phase severity metric_value~", """
seq AS (
  SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS phase, o_orderkey, o_totalprice AS v,
         lag(o_totalprice) OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderkey) AS prev
  FROM orders),
par AS (
  SELECT o_orderpriority, phase, min(o_orderkey) AS first, avg(v) AS c, avg(abs(v - prev)) / 1.128 AS s
  FROM seq GROUP BY ALL),
l AS (
  SELECT *, c - lag(c) OVER w AS shift, lag(s) OVER w AS before
  FROM par WINDOW w AS (PARTITION BY o_orderpriority ORDER BY first)),
answer AS (
  SELECT *, shift AS metric_value, CASE WHEN before > 0 AND abs(shift) / before > 1.5 THEN 'danger'
         WHEN before > 0 AND abs(shift) / before > 0.5 THEN 'warning' ELSE 'info' END AS severity
  FROM l WHERE shift IS NOT NULL)""")
def finding_phase_shift(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    roles = Roles("o_totalprice", "o_orderkey", "o_orderpriority", phase="year")
    known = findings.facts(variables.imr(orders, roles), phases=phase_table(orders, roles))
    return findings.findings(known, ["phase_shift"])


@case("finding_capability", "N4", FINDING, CAP_SQL + """,
answer AS (
  SELECT *, cpk AS metric_value,
         CASE WHEN cpk >= 1.33 THEN 'good' WHEN cpk >= 1 THEN 'warning' ELSE 'danger' END AS severity,
         CASE WHEN cpk >= 1.33 THEN 'Capable' WHEN cpk >= 1 THEN 'Marginal Capability'
              ELSE 'Not Capable' END AS title FROM able)""")
def finding_capability(spark, d):
    c, indices = able(spark, d)
    return findings.findings(findings.facts(c, capability=indices), ["capability"])


@case("finding_centering", "N5", FINDING, CAP_SQL + """,
r AS (SELECT *, cpk / cp AS ratio FROM able),
answer AS (
  SELECT *, ratio AS metric_value,
         CASE WHEN ratio >= 0.9 THEN 'good' WHEN ratio >= 0.9 * 0.78 THEN 'warning' ELSE 'danger' END AS severity,
         CASE WHEN ratio >= 0.9 THEN 'Well Centered' WHEN ratio >= 0.9 * 0.78 THEN 'Off Center'
              ELSE 'Significantly Off Center' END AS title FROM r)""")
def finding_centering(spark, d):
    c, indices = able(spark, d)
    return findings.findings(findings.facts(c, capability=indices), ["centering"])


@case("finding_statistics", "N6 A9", f"{SERIES} metric_value~ detail", EVENTS + """,
answer AS (
  SELECT event_type, phase, count(*) AS metric_value,
         printf('N=%d, Mean=%.4f, Std=%.4f, Median=%.4f, Range=[%.4f, %.4f].', count(*), avg(value),
                stddev_samp(value), median(value), min(value), max(value)) AS detail
  FROM pts GROUP BY ALL)""")
def finding_statistics(spark, d):
    return only(spark, d, "statistics")


@case("finding_sigma_method", "N7", f"{SERIES} metric_value~ detail", EVENTS + """,
answer AS (
  SELECT event_type, phase, sigma_hat AS metric_value,
         printf('Estimated via moving_range using %d observations.', n_used) AS detail FROM par)""")
def finding_sigma_method(spark, d):
    return only(spark, d, "sigma_method")


@case("finding_zones", "N8", f"{SERIES} severity metric_value~", EVENTS + """,
z AS (SELECT event_type, phase, avg(CASE WHEN abs(value - center) / sigma_hat <= 1 THEN 1 ELSE 0 END) AS share
      FROM pts GROUP BY ALL),
answer AS (SELECT *, share AS metric_value,
                  CASE WHEN abs(share - 0.6827) > 0.2 THEN 'warning' ELSE 'info' END AS severity FROM z)""")
def finding_zones(spark, d):
    return only(spark, d, "zones")


@case("zone_counts", "N8", f"{SERIES} n# zone_a# zone_b# zone_c# beyond#", EVENTS + """,
z AS (SELECT *, abs(value - center) / sigma_hat AS dist FROM pts),
answer AS (
  SELECT event_type, phase, count(*) AS n, count(*) FILTER (dist <= 1) AS zone_c,
         count(*) FILTER (dist > 1 AND dist <= 2) AS zone_b,
         count(*) FILTER (dist > 2 AND dist <= 3) AS zone_a, count(*) FILTER (dist > 3) AS beyond
  FROM z GROUP BY ALL)""")
def zone_count_query(spark, d):
    rows = findings.facts(chart(spark, d)).df
    return rows.withColumn("n", F.col("zone_n"))


@case("finding_runs", "N9", FINDING, EVENTS + """,
s AS (SELECT *, value > center AS above, lag(value > center) OVER (PARTITION BY event_type ORDER BY idx) AS was FROM pts),
c AS (
  SELECT event_type, phase, CAST(count(*) FILTER (above) AS DOUBLE) AS a,
         CAST(count(*) FILTER (NOT above) AS DOUBLE) AS b,
         count(*) FILTER (was IS NULL OR was <> above) AS runs FROM s GROUP BY ALL),
y AS (
  SELECT *, (runs - (2 * a * b / (a + b) + 1))
         / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1))) AS z FROM c),
answer AS (
  SELECT *, runs AS metric_value, CASE WHEN abs(z) > 1.96 THEN 'warning' ELSE 'info' END AS severity,
         CASE WHEN z < -1.96 THEN 'Shift Pattern' WHEN z > 1.96 THEN 'Oscillation Pattern'
              ELSE 'Runs Normal' END AS title FROM y)""")
def finding_runs(spark, d):
    return only(spark, d, "runs")


@case("finding_patterns", "N10", FINDING, RULES + """,
answer AS (
  SELECT event_type, phase, 'warning' AS severity, count(*) AS metric_value,
         CASE test_id WHEN '3' THEN 'Trend Detected' WHEN '7' THEN 'Stratification'
              ELSE 'Mixture Pattern' END AS title
  FROM vio8 WHERE test_id IN ('3', '7', '8') GROUP BY event_type, phase, test_id)""")
def finding_patterns(spark, d):
    return only(spark, d, "patterns", nelson=ALL_NELSON)


@cache
def _recipe():
    return Recipe("imr", EVENT_VALUES, nelson=ALL_NELSON, usl=300.0, lsl=-100.0)


ANALYSIS_SQL = RULES + CAP_SQL[len(EVENTS):] + """,
t AS (SELECT event_type, phase, count(*) AS n FROM pts GROUP BY ALL),
v AS (SELECT event_type, phase, count(*) AS flags, count(DISTINCT test_id) AS kinds FROM vio8 GROUP BY ALL),
per AS (SELECT event_type, phase, test_id, count(*) AS n FROM vio8 GROUP BY ALL),
zs AS (SELECT event_type, phase, avg(CASE WHEN abs(value - center) / sigma_hat <= 1 THEN 1 ELSE 0 END) AS share
       FROM pts GROUP BY ALL),
rs AS (SELECT *, lag(value > center) OVER (PARTITION BY event_type ORDER BY idx) AS was FROM pts),
rc AS (
  SELECT event_type, phase, CAST(count(*) FILTER (value > center) AS DOUBLE) AS a,
         CAST(count(*) FILTER (NOT value > center) AS DOUBLE) AS b,
         count(*) FILTER (was IS NULL OR was <> (value > center)) AS runs FROM rs GROUP BY ALL),
ry AS (
  SELECT *, (runs - (2 * a * b / (a + b) + 1))
         / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1))) AS z FROM rc),
every AS (
  SELECT event_type, phase, 'stability' AS generator, 'stability' AS category,
         CASE WHEN flags IS NULL THEN 'good' WHEN kinds <= 2 AND flags <= 3 AND flags / n * 100 <= 2
              THEN 'warning' ELSE 'danger' END AS severity, coalesce(flags, 0) AS metric_value
  FROM t LEFT JOIN v USING (event_type, phase)
  UNION ALL SELECT event_type, phase, 'rule', 'stability',
         CASE WHEN test_id = '1' THEN 'danger' ELSE 'warning' END, n FROM per
  UNION ALL SELECT event_type, phase, 'statistics', 'statistical', 'info', n FROM t
  UNION ALL SELECT event_type, phase, 'sigma_method', 'statistical', 'info', sigma_hat FROM par
  UNION ALL SELECT event_type, phase, 'zones', 'statistical',
         CASE WHEN abs(share - 0.6827) > 0.2 THEN 'warning' ELSE 'info' END, share FROM zs
  UNION ALL SELECT event_type, phase, 'runs', 'pattern',
         CASE WHEN abs(z) > 1.96 THEN 'warning' ELSE 'info' END, runs FROM ry
  UNION ALL SELECT event_type, phase, CASE test_id WHEN '3' THEN 'trend' WHEN '7' THEN 'stratification'
         ELSE 'mixture' END, 'pattern', 'warning', n FROM per WHERE test_id IN ('3', '7', '8')
  UNION ALL SELECT event_type, phase, 'capability', 'capability',
         CASE WHEN cpk >= 1.33 THEN 'good' WHEN cpk >= 1 THEN 'warning' ELSE 'danger' END, cpk FROM able
  UNION ALL SELECT event_type, phase, 'centering', 'capability',
         CASE WHEN cpk / cp >= 0.9 THEN 'good' WHEN cpk / cp >= 0.9 * 0.78 THEN 'warning'
              ELSE 'danger' END, cpk / cp FROM able)"""


@case("all_findings", "N11 O2", f"{SERIES} generator category severity metric_value~",
      ANALYSIS_SQL + ", answer AS (SELECT * FROM every)")
def all_findings(spark, d):
    return analyze(events(spark, d), _recipe()).findings()


@case("health_summary", "N12", f"{SERIES} severity label n_danger# n_warning# ooc_count~ cpk~ n~", ANALYSIS_SQL + """,
h AS (
  SELECT event_type, phase, count(*) FILTER (severity = 'danger') AS n_danger,
         count(*) FILTER (severity = 'warning') AS n_warning,
         max(CASE severity WHEN 'danger' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst,
         max(metric_value) FILTER (generator = 'stability') AS ooc_count,
         max(metric_value) FILTER (generator = 'capability') AS cpk,
         max(metric_value) FILTER (generator = 'statistics') AS n FROM every GROUP BY ALL),
answer AS (
  SELECT *, CASE worst WHEN 3 THEN 'danger' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE 'good' END AS severity,
         CASE worst WHEN 3 THEN 'Critical' WHEN 2 THEN 'Attention' WHEN 1 THEN 'Normal' ELSE 'Healthy' END AS label
  FROM h)""")
def health_summary(spark, d):
    return analyze(events(spark, d), _recipe()).health()


@case("analysis_points", "O2 A11 A12", "event_type phase idx# global_idx# label value~ ucl~ lcl~", """
src AS (SELECT *, CAST(month(ts) AS VARCHAR) AS phase FROM events WHERE value IS NOT NULL),
seq AS (
  SELECT event_type, phase, event_id, value, row_number() OVER w - 1 AS idx, lag(value) OVER w AS prev
  FROM src WINDOW w AS (PARTITION BY event_type, phase ORDER BY event_id)),
par AS (
  SELECT event_type, phase, min(event_id) AS first, count(*) AS n, avg(value) AS c,
         avg(abs(value - prev)) / 1.128 AS s FROM seq GROUP BY ALL),
st AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY first) - n AS start FROM par),
answer AS (
  SELECT event_type, phase, idx, start + idx AS global_idx, CAST(event_id AS VARCHAR) AS label, value,
         c + 3 * s AS ucl, c - 3 * s AS lcl FROM seq JOIN st USING (event_type, phase))""")
def analysis_points(spark, d):
    rows = events(spark, d).withColumn("month", F.month("ts"))
    return analyze(rows, Recipe("imr", Roles("value", "event_id", "event_type", phase="month"))).points


@case("analysis_points_xbar", "O2 A11", "l_returnflag phase idx# global_idx# label value~", """
sub AS (SELECT l_returnflag, CAST(year(l_shipdate) AS VARCHAR) AS phase, strftime(l_shipdate, '%Y-%m') AS label,
               avg(l_quantity) AS value, min(l_shipdate) AS first FROM lineitem GROUP BY ALL),
answer AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, phase ORDER BY first) - 1 AS idx,
                  row_number() OVER (PARTITION BY l_returnflag ORDER BY first) - 1 AS global_idx FROM sub)""")
def analysis_points_xbar(spark, d):
    """Phases of subgrouped points: positions count subgroups, not rows."""
    rows = months(spark, d).withColumn("year", F.year("l_shipdate"))
    return analyze(rows, Recipe("xbar_r", replace(MONTHLY, phase="year"))).points


@case("phase_summary_subgroups", "M5", "l_returnflag phase total# start_index# end_index#", """
per AS (SELECT l_returnflag, CAST(year(l_shipdate) AS VARCHAR) AS phase,
               count(DISTINCT month(l_shipdate)) AS total FROM lineitem GROUP BY ALL),
answer AS (SELECT *, sum(total) OVER w AS end_index, sum(total) OVER w - total AS start_index
           FROM per WINDOW w AS (PARTITION BY l_returnflag ORDER BY phase))""")
def phase_summary_subgroups(spark, d):
    roles = replace(MONTHLY, phase="year")
    rows = months(spark, d).withColumn("year", F.year("l_shipdate"))
    c = variables.xbar_r(rows, roles)
    return compare.phase_summary(c, rules.violations(c), phase_table(rows, roles))


@case("analysis_with_exclusion", "O2 T32", f"{SERIES} idx# value~ ucl~ cl~ lcl~", """
seq AS (
  SELECT event_type, 'all' AS phase, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx
  FROM events WHERE value IS NOT NULL),
used AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM seq WHERE value <= 200),
par AS (SELECT event_type, avg(value) AS c, avg(abs(value - prev)) / 1.128 AS s FROM used GROUP BY 1),
answer AS (SELECT seq.*, c AS cl, c + 3 * s AS ucl, c - 3 * s AS lcl FROM seq JOIN par USING (event_type))""")
def analysis_with_exclusion(spark, d):
    rows = events(spark, d).withColumn("out", F.col("value") > 200)
    return analyze(rows, Recipe("imr", EVENT_VALUES, exclude="out")).points


# -- comparison of methods ---------------------------------------------------------------------
def two_methods(spark, d):
    charts = {"imr": chart(spark, d), "ewma": time_weighted.ewma(events(spark, d), EVENT_VALUES)}
    fired = {name: rules.violations(c, (1, 2)) for name, c in charts.items()}
    return charts, fired


TWO_SQL = RULES + EWMA_SQL[len(EVENTS):] + """,
el AS (
  SELECT event_type, phase, idx, value, center, sigma_hat,
         3 * sigma_hat * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) AS half,
         CASE WHEN value > center THEN 1 WHEN value < center THEN -1 ELSE 0 END AS side FROM ew),
ef AS (
  SELECT *, abs(value - center) > half AS r1,
         idx >= 8 AND abs(sum(side) OVER (PARTITION BY event_type ORDER BY idx ROWS 8 PRECEDING)) = 9 AS r2
  FROM el),
both_flags AS (
  SELECT 'imr' AS chart, event_type, phase, idx, test_id FROM vio WHERE test_id IN ('1', '2')
  UNION ALL SELECT 'ewma', event_type, phase, idx, '1' FROM ef WHERE r1
  UNION ALL SELECT 'ewma', event_type, phase, idx, '2' FROM ef WHERE r2),
pt AS (
  SELECT event_type, phase, idx, string_agg(DISTINCT chart, ',' ORDER BY chart) AS flagged_by,
         string_agg(DISTINCT chart || ':' || test_id, ',' ORDER BY chart || ':' || test_id) AS rules
  FROM both_flags GROUP BY ALL)"""


@case("method_summary", "M1", f"{SERIES} chart sigma_hat~ ucl~ cl~ lcl~ flags# rules#", TWO_SQL + """,
c AS (SELECT chart, event_type, phase, count(*) AS flags, count(DISTINCT test_id) AS rules FROM both_flags GROUP BY ALL),
m AS (
  SELECT 'imr' AS chart, event_type, phase, sigma_hat, ucl, cl, lcl FROM pts WHERE idx = 0
  UNION ALL SELECT 'ewma', event_type, phase, sigma_hat, center + half, center, center - half FROM el WHERE idx = 0),
answer AS (SELECT m.*, coalesce(flags, 0) AS flags, coalesce(rules, 0) AS rules
           FROM m LEFT JOIN c USING (chart, event_type, phase))""")
def method_summary(spark, d):
    return compare.method_summary(*two_methods(spark, d))


@case("method_disagreements", "M2", f"{SERIES} idx# flagged_by rules cleared_by", TWO_SQL + """,
answer AS (SELECT *, CASE flagged_by WHEN 'imr' THEN 'ewma' ELSE 'imr' END AS cleared_by
           FROM pt WHERE flagged_by <> 'ewma,imr')""")
def method_disagreements(spark, d):
    charts, fired = two_methods(spark, d)
    rows = compare.disagreements(fired, charts["imr"].keys)
    lists = ("flagged_by", "rules", "cleared_by")
    return rows.withColumns({c: F.array_join(c, ",") for c in lists})


@case("method_rule_counts", "M1", "event_type chart test_id n_points# rank#", TWO_SQL + """,
c AS (SELECT chart, event_type, test_id, count(*) AS n_points FROM both_flags GROUP BY ALL),
answer AS (SELECT *, row_number() OVER (PARTITION BY chart, event_type ORDER BY n_points DESC, test_id) AS rank FROM c)""")
def method_rule_counts(spark, d):
    charts, fired = two_methods(spark, d)
    return compare.method_rule_counts(fired, charts["imr"].keys)


@case("method_settings", "M1", f"{SERIES} chart k_sigma~ n_phases#", """
src AS (SELECT DISTINCT event_type, CAST(month(ts) AS VARCHAR) || '-' || CAST(day(ts) // 10 AS VARCHAR) AS phase FROM events WHERE value IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n_phases FROM src),
answer AS (SELECT *, 'imr' AS chart, 2.5 AS k_sigma FROM n UNION ALL SELECT *, 'levey_jennings', 3.0 FROM n)""")
def method_settings(spark, d):
    """What the compared charts were set to, over several phases."""
    phase = F.concat(F.month("ts").cast("string"), F.lit("-"), F.floor(F.dayofmonth("ts") / 10).cast("string"))
    rows, roles = events(spark, d).withColumn("tens", phase), replace(EVENT_VALUES, phase="tens")
    charts = {"imr": variables.imr(rows, roles, k_sigma=2.5), "levey_jennings": variables.levey_jennings(rows, roles)}
    return compare.method_summary(charts, {n: rules.violations(c, (1,)) for n, c in charts.items()})


@case("disagreement_points", "M2", f"{SERIES} idx# value~ label flagged_by", TWO_SQL + """,
answer AS (SELECT pt.event_type, pt.phase, pt.idx, pts.value, CAST(event_id AS VARCHAR) AS label, flagged_by
           FROM pt JOIN pts ON pts.event_type = pt.event_type AND pts.idx = pt.idx WHERE flagged_by <> 'ewma,imr')""")
def disagreement_points(spark, d):
    charts, fired = two_methods(spark, d)
    points = analyze(events(spark, d), Recipe("imr", EVENT_VALUES)).points
    rows = compare.disagreements(fired, charts["imr"].keys, points)
    return rows.withColumn("flagged_by", F.array_join("flagged_by", ","))


@case("disagreement_summary", "M2",
      f"{SERIES} total_points# disagreements# unanimous# only_imr# only_ewma# percent~", TWO_SQL + """,
n AS (SELECT event_type, phase, count(*) AS total_points FROM pts GROUP BY ALL),
c AS (
  SELECT event_type, phase, count(*) FILTER (flagged_by <> 'ewma,imr') AS disagreements,
         count(*) FILTER (flagged_by = 'ewma,imr') AS unanimous,
         count(*) FILTER (flagged_by = 'imr') AS only_imr,
         count(*) FILTER (flagged_by = 'ewma') AS only_ewma FROM pt GROUP BY ALL),
answer AS (
  SELECT n.*, coalesce(disagreements, 0) AS disagreements, coalesce(unanimous, 0) AS unanimous,
         coalesce(only_imr, 0) AS only_imr, coalesce(only_ewma, 0) AS only_ewma,
         coalesce(disagreements, 0) / total_points * 100 AS percent
  FROM n LEFT JOIN c USING (event_type, phase))""")
def disagreement_summary(spark, d):
    charts, fired = two_methods(spark, d)
    return compare.disagreement_summary(fired, charts["imr"].keys, charts["imr"].points)


@case("selection_summary", "M3", f"{SERIES} count# min~ max~ mean~ std~ range~ excluded#", EVENTS + """,
answer AS (
  SELECT event_type, phase, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean,
         stddev_samp(value) AS std, max(value) - min(value) AS range,
         count(*) FILTER (value > ucl) AS excluded
  FROM pts WHERE value > cl GROUP BY ALL)""")
def selection_summary(spark, d):
    above = F.col("value") > F.col("cl")
    return compare.selection_summary(chart(spark, d), above, F.col("value") > F.col("ucl"))


@case("violation_breakdown", "M4", f"{SERIES} total# ooc_count# in_control#", RULES + """,
n AS (SELECT event_type, phase, count(*) AS total FROM pts WHERE value > 60 GROUP BY ALL),
o AS (SELECT event_type, phase, count(DISTINCT idx) AS ooc FROM vio WHERE test_id = '1' AND value > 60 GROUP BY ALL),
answer AS (SELECT n.*, coalesce(ooc, 0) AS ooc_count, total - coalesce(ooc, 0) AS in_control
           FROM n LEFT JOIN o USING (event_type, phase))""")
def violation_breakdown(spark, d):
    c = chart(spark, d)
    return compare.violation_breakdown(c, rules.violations(c), F.col("value") > 60)[0]


@case("violation_breakdown_rules", "M4", f"{SERIES} test_id n_points#", RULES + """,
answer AS (SELECT event_type, phase, test_id, count(DISTINCT idx) AS n_points
           FROM vio5 WHERE value > 60 GROUP BY ALL)""")
def violation_breakdown_rules(spark, d):
    c = chart(spark, d)
    return compare.violation_breakdown(c, rules.violations(c), F.col("value") > 60)[1]


@case("phase_summary", "M5", "event_type phase total# ooc_count# start_index# end_index# ucl~ cl~ lcl~", """
src AS (SELECT *, CAST(month(ts) AS VARCHAR) AS phase FROM events WHERE value IS NOT NULL),
seq AS (
  SELECT event_type, phase, event_id, value,
         lag(value) OVER (PARTITION BY event_type, phase ORDER BY event_id) AS prev FROM src),
par AS (
  SELECT event_type, phase, min(event_id) AS first, count(*) AS total, avg(value) AS cl,
         avg(abs(value - prev)) / 1.128 AS s FROM seq GROUP BY ALL),
lim AS (SELECT *, cl + 3 * s AS ucl, cl - 3 * s AS lcl, sum(total) OVER (PARTITION BY event_type ORDER BY first) AS upto FROM par),
o AS (SELECT event_type, phase, count(*) AS ooc FROM seq JOIN lim USING (event_type, phase)
      WHERE value > ucl OR value < lcl GROUP BY ALL),
answer AS (SELECT lim.*, coalesce(ooc, 0) AS ooc_count, upto - total AS start_index, upto AS end_index
           FROM lim LEFT JOIN o USING (event_type, phase))""")
def phase_summary(spark, d):
    rows = events(spark, d).withColumn("month", F.month("ts"))
    roles = Roles("value", "event_id", "event_type", phase="month")
    c = variables.imr(rows, roles)
    return compare.phase_summary(c, rules.violations(c), phase_table(rows, roles))


@case("rule_totals", "M6", "event_type test_id n_points#", RULES + """,
answer AS (SELECT event_type, test_id, count(*) AS n_points FROM vio5 GROUP BY ALL)""")
def rule_totals(spark, d):
    c = chart(spark, d)
    return compare.rule_totals(rules.violations(c), c.keys)


@case("recommendations", "M6", f'{SERIES} check_text', RULES + """,
m AS (SELECT event_type, phase, max(test_id = '1') AS a, max(test_id = '2') AS b,
             max(test_id IN ('3', '5')) AS c FROM vio5 GROUP BY ALL),
x AS (
  SELECT p.event_type, p.phase, unnest([
    CASE WHEN a THEN 'Investigate points beyond control limits - check for assignable causes.' END,
    CASE WHEN b THEN '9+ consecutive points on same side of CL - possible process shift.' END,
    CASE WHEN c THEN 'Trending pattern detected - check for gradual process drift.' END,
    CASE WHEN a IS NULL THEN 'Process appears in statistical control. Continue monitoring.' END]) AS check_text
  FROM par p LEFT JOIN m USING (event_type, phase)),
answer AS (SELECT * FROM x WHERE check_text IS NOT NULL)""")
def recommendations(spark, d):
    c = chart(spark, d)
    rows = compare.recommendations(c.params, rules.violations(c), c.keys)
    return rows.withColumnRenamed("check", "check_text")


@case("comparison_strip", "M6", f"{SERIES} chart flags# rules# flags_tone rules_tone n_charts#", TWO_SQL + """,
c AS (SELECT chart, event_type, phase, count(*) AS flags, count(DISTINCT test_id) AS rules FROM both_flags GROUP BY ALL),
m AS (SELECT chart, event_type, phase FROM par, (VALUES ('imr'), ('ewma')) t(chart)),
j AS (SELECT m.*, coalesce(flags, 0) AS flags, coalesce(rules, 0) AS rules FROM m LEFT JOIN c USING (chart, event_type, phase)),
answer AS (
  SELECT *, CASE WHEN flags > 0 THEN 'critical' ELSE 'positive' END AS flags_tone,
         CASE WHEN rules > 0 THEN 'warning' ELSE 'positive' END AS rules_tone, 2 AS n_charts FROM j)""")
def comparison_strip(spark, d):
    charts, fired = two_methods(spark, d)
    return compare.comparison_strip(charts, fired, charts["imr"].keys)


@case("summary_statistics", "A9", "l_returnflag phase n# mean~ std~ min~ max~ median~ subgroup_count#", """
answer AS (
  SELECT l_returnflag, 'all' AS phase, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std,
         min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median,
         count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS subgroup_count FROM lineitem GROUP BY 1)""")
def summary_statistics_query(spark, d):
    return summary_statistics(months(spark, d), MONTHLY)
