"""Control charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import case, table
from catalog.fragments import CONSTANTS, DAYS, EVENTS, MONTHS, smoothed
from plumbline.functions.quantiles import NORMAL
from plumbline.operators import (
    attributes,
    multivariate,
    rare_events,
    short_run,
    time_weighted,
    variables,
)
from plumbline.operators.chart import MR_DIVISOR, zones
from plumbline.operators.series import Roles, sequence

EVENT_VALUES = Roles("value", "event_id", "event_type")
MONTHLY = Roles("l_quantity", "l_shipdate", "l_returnflag", subgroup="month")
DAILY = Roles("bad", "event_id", subgroup="day")
SERIES = "event_type phase"
#: 0.9973 quantile of chi-square with 3 degrees of freedom (a fixed value).
CHI2_3 = 14.156252500540928
LINES = "idx# value~ ucl~ cl~ lcl~"


def events(spark, d):
    return table(spark, d, "events")


def months(spark, d):
    return table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))


def days(spark, d):
    return events(spark, d).withColumns(
        {
            "day": F.date_format("ts", "yyyy-MM-dd"),
            "bad": (F.col("event_type") == "error").cast("double"),
        }
    )


# -- individuals ----------------------------------------------------------------
@case("individuals_chart", "C1 G11", f"{SERIES} {LINES} zone_a_upper~ zone_b_upper~ zone_b_lower~ zone_a_lower~",
      EVENTS + """,
answer AS (
  SELECT *, center + 2 * sigma_hat AS zone_a_upper, center + sigma_hat AS zone_b_upper,
         center - sigma_hat AS zone_b_lower, center - 2 * sigma_hat AS zone_a_lower FROM pts)""")
def individuals_chart(spark, d):
    return zones(variables.imr(events(spark, d), EVENT_VALUES).points)


@case("individuals_chart_blocks", "C1 O1", f"{SERIES} {LINES}", EVENTS + ", answer AS (SELECT * FROM pts)")
def individuals_chart_blocks(spark, d):
    """The same chart by the path for giant series."""
    return variables.imr(events(spark, d), EVENT_VALUES, block_rows=500).points


@case("individuals_moving_ranges", "C1", f"{SERIES} {LINES}", EVENTS + """,
answer AS (
  SELECT event_type, phase, idx - 1 AS idx, mr AS value, 1.128 * sigma_hat AS cl,
         1.128 * sigma_hat + 3 * 0.8525 * sigma_hat AS ucl,
         greatest(1.128 * sigma_hat - 3 * 0.8525 * sigma_hat, 0) AS lcl
  FROM pts WHERE idx >= 1)""")
def individuals_moving_ranges(spark, d):
    return variables.imr(events(spark, d), EVENT_VALUES).secondary_points


@case("individuals_median_moving_range", "C1 G4",
      f"{SERIES} center~ sigma_hat~ method n_used#", EVENTS + """,
answer AS (
  SELECT event_type, phase, avg(value) AS center, median(mr) / 0.954 AS sigma_hat,
         'median_moving_range' AS method, count(mr) AS n_used FROM pts GROUP BY ALL)""")
def individuals_median_moving_range(spark, d):
    return variables.imr(events(spark, d), EVENT_VALUES, sigma_method="median_moving_range").params


@case("individuals_by_phase", "C1 A11", f"o_orderpriority phase {LINES}", """
seq AS (
  SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS phase, o_totalprice AS value,
         row_number() OVER w - 1 AS idx, lag(o_totalprice) OVER w AS prev
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderkey)),
par AS (
  SELECT o_orderpriority, phase, avg(value) AS cl, avg(abs(value - prev)) / 1.128 AS s
  FROM seq GROUP BY ALL),
answer AS (SELECT seq.*, cl, cl + 3 * s AS ucl, cl - 3 * s AS lcl
           FROM seq JOIN par USING (o_orderpriority, phase))""")
def individuals_by_phase(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    roles = Roles("o_totalprice", "o_orderkey", "o_orderpriority", phase="year")
    return variables.imr(orders, roles).points


@case("individuals_of_subgroups_range", "C1 G1", f"l_returnflag phase {LINES}", MONTHS + """,
answer AS (
  SELECT num.l_returnflag, num.phase, idx, mean AS value, grand AS cl,
         grand + 3 * sigma_r AS ucl, grand - 3 * sigma_r AS lcl
  FROM num JOIN sig USING (l_returnflag, phase))""")
def individuals_of_subgroups_range(spark, d):
    return variables.imr(months(spark, d), MONTHLY, sigma_method="range").points


@case("individuals_of_subgroups_stddev", "C1 G2", "l_returnflag phase center~ sigma_hat~ n_used#",
      MONTHS + """,
answer AS (SELECT l_returnflag, phase, grand AS center, sigma_s AS sigma_hat, n_used FROM sig)""")
def individuals_of_subgroups_stddev(spark, d):
    return variables.imr(months(spark, d), MONTHLY, sigma_method="stddev").params


@case("levey_jennings_chart", "C7 G5", f"{SERIES} {LINES}", """
seq AS (
  SELECT event_type, 'all' AS phase, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events
  WHERE value IS NOT NULL),
par AS (SELECT event_type, avg(value) AS cl, stddev_samp(value) AS s FROM seq GROUP BY 1),
answer AS (SELECT seq.*, cl, cl + 3 * s AS ucl, cl - 3 * s AS lcl FROM seq JOIN par USING (event_type))""")
def levey_jennings_chart(spark, d):
    return variables.levey_jennings(events(spark, d), EVENT_VALUES).points


@case("moving_range_chart_span_3", "C6 G3",
      f"{SERIES} {LINES} zone_cl~ zone_sigma~", """
seq AS (
  SELECT event_type, 'all' AS phase, value, row_number() OVER w - 1 AS idx,
         max(value) OVER (w ROWS 2 PRECEDING) - min(value) OVER (w ROWS 2 PRECEDING) AS mr
  FROM events WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
par AS (SELECT event_type, avg(mr) AS mr_bar, avg(mr) / 1.693 AS s FROM seq WHERE idx >= 2 GROUP BY 1),
answer AS (
  SELECT event_type, phase, idx - 2 AS idx, mr AS value, 1.693 * s AS cl,
         1.693 * s + 3 * 0.8884 * s AS ucl, greatest(1.693 * s - 3 * 0.8884 * s, 0) AS lcl,
         mr_bar AS zone_cl, 0.8884 * s AS zone_sigma
  FROM seq JOIN par USING (event_type) WHERE idx >= 2)""")
def moving_range_chart_span_3(spark, d):
    return variables.mr(events(spark, d), EVENT_VALUES, span=3).points


RUN_SQL = EVENTS + """,
med AS (SELECT event_type, median(value) AS m FROM seq GROUP BY 1),
s AS (
  SELECT seq.event_type, phase, idx, CASE WHEN value > m THEN 1 ELSE -1 END AS side, m
  FROM seq JOIN med USING (event_type) WHERE value <> m),
t AS (
  SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY event_type ORDER BY idx) THEN 0 ELSE 1 END AS turn
  FROM s),
c AS (
  SELECT event_type, phase, any_value(m) AS center, sum(turn) AS n_runs,
         CAST(count(*) FILTER (side = 1) AS DOUBLE) AS a,
         CAST(count(*) FILTER (side = -1) AS DOUBLE) AS b FROM t GROUP BY ALL),
e AS (
  SELECT *, 2 * a * b / (a + b) + 1 AS expected_runs,
         2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1)) AS v FROM c),
y AS (SELECT *, (n_runs - expected_runs) / sqrt(v) AS z FROM e),
answer AS (
  SELECT *, a AS n_above, b AS n_below,
         1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n:
             pow(-1, n) * pow(abs(z) / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) AS p_value
  FROM y)"""


@case("run_chart_test", "C8",
      f"{SERIES} center~ n_above# n_below# n_runs# expected_runs~ z~ p_value~", RUN_SQL)
def run_chart_test(spark, d):
    return variables.run_chart(events(spark, d), EVENT_VALUES).params


@case("run_chart_points", "C8", f"{SERIES} {LINES}", EVENTS + """,
med AS (SELECT event_type, median(value) AS m FROM seq GROUP BY 1),
answer AS (
  SELECT p.event_type, phase, idx, value, m AS cl, m + 3 * sigma_hat AS ucl, m - 3 * sigma_hat AS lcl
  FROM pts p JOIN med USING (event_type))""")
def run_chart_points(spark, d):
    return variables.run_chart(events(spark, d), EVENT_VALUES).points


# -- subgroups ---------------------------------------------------------------------
SUB = "l_returnflag phase subgroup n#"


@case("xbar_r_chart", "C2 G1", f"{SUB} {LINES} zone_cl~ zone_sigma~", MONTHS + """,
answer AS (
  SELECT k.*, mean AS value, grand AS cl, grand + 3 * sigma_r / sqrt(n) AS ucl,
         grand - 3 * sigma_r / sqrt(n) AS lcl, grand AS zone_cl, sigma_r AS zone_sigma
  FROM k JOIN sig USING (l_returnflag, phase))""")
def xbar_r_chart(spark, d):
    return variables.xbar_r(months(spark, d), MONTHLY).points


@case("xbar_r_ranges", "C2 K1", f"l_returnflag phase {LINES}", MONTHS + """,
answer AS (
  SELECT k.*, range AS value, d2 * sigma_r AS cl, d2 * sigma_r + 3 * d3 * sigma_r AS ucl,
         greatest(d2 * sigma_r - 3 * d3 * sigma_r, 0) AS lcl
  FROM k JOIN sig USING (l_returnflag, phase))""")
def xbar_r_ranges(spark, d):
    return variables.xbar_r(months(spark, d), MONTHLY).secondary_points


@case("xbar_s_chart", "C3 G2", f"{SUB} {LINES}", MONTHS + """,
answer AS (
  SELECT k.*, mean AS value, grand AS cl, grand + 3 * sigma_s / sqrt(n) AS ucl,
         grand - 3 * sigma_s / sqrt(n) AS lcl
  FROM k JOIN sig USING (l_returnflag, phase))""")
def xbar_s_chart(spark, d):
    return variables.xbar_s(months(spark, d), MONTHLY).points


SPREAD_SQL = """,
freq AS (SELECT l_returnflag, n, count(*) AS many, min(idx) AS seen FROM k GROUP BY ALL),
typ AS (SELECT l_returnflag, n AS typical FROM freq
        QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY many DESC, seen) = 1),
answer AS (
  SELECT k.*, {value} AS value, {c} * {s} AS cl, {c} * {s} + 3 * {w} * {s} AS ucl,
         greatest({c} * {s} - 3 * {w} * {s}, 0) AS lcl, {bar} AS zone_cl, t.{w} * {s} AS zone_sigma
  FROM k JOIN sig USING (l_returnflag, phase) JOIN typ USING (l_returnflag)
  JOIN constants t ON t.n = least(typical, 50))"""


@case("range_chart", "C4 A14", f"{SUB} {LINES} zone_cl~ zone_sigma~",
      MONTHS + SPREAD_SQL.format(value="range", c="k.d2", w="d3", s="sigma_r", bar="r_bar").replace("* d3", "* k.d3"))
def range_chart(spark, d):
    return variables.r(months(spark, d), MONTHLY).points


@case("stddev_chart", "C5 A14", f"{SUB} {LINES} zone_cl~ zone_sigma~",
      MONTHS + SPREAD_SQL.format(value="std", c="k.c4", w="c5", s="sigma_s", bar="s_bar").replace("* c5", "* k.c5"))
def stddev_chart(spark, d):
    return variables.s(months(spark, d), MONTHLY).points


THREE_SQL = MONTHS + """,
mv AS (SELECT l_returnflag, avg(abs(mean - prev)) / 1.128 AS smr FROM (
  SELECT l_returnflag, mean, lag(mean) OVER (PARTITION BY l_returnflag ORDER BY idx) AS prev FROM num)
  GROUP BY 1),
p AS (
  SELECT sig.*, {sw} AS sw, sqrt(greatest(smr ** 2 - {sw} ** 2 / h, 0)) AS sb,
         sqrt({sw} ** 2 + greatest(smr ** 2 - {sw} ** 2 / h, 0)) AS sbw
  FROM sig JOIN mv USING (l_returnflag))"""


@case("three_way_chart", "C17 A13", f"{SUB} {LINES} zone_sigma~", THREE_SQL.format(sw="sigma_r") + """,
answer AS (
  SELECT num.*, mean AS value, grand AS cl, grand + 3 * sbw / sqrt(h) AS ucl,
         grand - 3 * sbw / sqrt(h) AS lcl, sbw AS zone_sigma FROM num JOIN p USING (l_returnflag, phase))""")
def three_way_chart(spark, d):
    return variables.three_way(months(spark, d), MONTHLY).points


@case("three_way_within", "C17", f"l_returnflag phase {LINES}", THREE_SQL.format(sw="sigma_s") + """,
answer AS (
  SELECT num.l_returnflag, num.phase, idx, std AS value, sw * c.c4 AS cl,
         sw * c.c4 + 3 * sw * sqrt(1 - c.c4 ** 2) AS ucl,
         greatest(sw * c.c4 - 3 * sw * sqrt(1 - c.c4 ** 2), 0) AS lcl
  FROM num JOIN p USING (l_returnflag, phase)
  JOIN constants c ON c.n = least(greatest(round_even(h, 0), 2), 50))""")
def three_way_within(spark, d):
    return variables.three_way(months(spark, d), MONTHLY, within_method="stddev").secondary_points


@case("three_way_parameters", "C17", "l_returnflag phase sigma_within~ sigma_between~ sigma_hat~ harmonic_n~",
      THREE_SQL.format(sw="sigma_r") + """,
answer AS (SELECT l_returnflag, phase, sw AS sigma_within, sb AS sigma_between, sbw AS sigma_hat,
                  h AS harmonic_n FROM p)""")
def three_way_parameters(spark, d):
    return variables.three_way(months(spark, d), MONTHLY).params


@case("presummarized_chart", "C19", f"{SUB} {LINES}", MONTHS + """,
answer AS (SELECT *, mean AS value, 25.0 AS cl, 25 + 3 * 14 / sqrt(n) AS ucl,
                  25 - 3 * 14 / sqrt(n) AS lcl FROM num)""")
def presummarized_chart(spark, d):
    return variables.presummarize(months(spark, d), MONTHLY, target=25.0, sigma=14.0).points


@case("presummarized_chart_median", "C19", f"{SUB} {LINES}", MONTHS + """,
med AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS subgroup, median(l_quantity) AS m
        FROM lineitem GROUP BY ALL),
answer AS (SELECT num.*, m AS value, 25.0 AS cl, 25 + 3 * 14 / sqrt(n) AS ucl,
                  25 - 3 * 14 / sqrt(n) AS lcl FROM num JOIN med USING (l_returnflag, subgroup))""")
def presummarized_chart_median(spark, d):
    return variables.presummarize(
        months(spark, d), MONTHLY, target=25.0, sigma=14.0, summary_stat="median"
    ).points


# -- attributes ----------------------------------------------------------------------
ATTRIBUTE = f"phase subgroup n~ {LINES}"


def _attribute(name, rows, kind, value, center, ucl, lcl, extra=""):
    @case(name, rows, ATTRIBUTE, DAYS + extra + f""",
answer AS (SELECT num.*, {value} AS value, {center} AS cl, {ucl} AS ucl, {lcl} AS lcl
           FROM num, tot{', adj' if extra else ''})""")
    def run(spark, d):
        return attributes.attribute(kind, days(spark, d), DAILY).points

    return run


P_HALF = "3 * sqrt(rate * (1 - rate) / n)"
U_HALF = "3 * sqrt(rate / n)"
_attribute("p_chart", "C9 G6 G9 G10", "p", "x / n", "rate", f"least(rate + {P_HALF}, 1)",
           f"greatest(rate - {P_HALF}, 0)")
_attribute("np_chart", "C10 G9", "np", "x", "n * rate",
           "least(n * rate + 3 * sqrt(n * rate * (1 - rate)), n)",
           "greatest(n * rate - 3 * sqrt(n * rate * (1 - rate)), 0)")
_attribute("c_chart", "C11 G9", "c", "x", "n * rate", "n * rate + 3 * sqrt(n * rate)",
           "greatest(n * rate - 3 * sqrt(n * rate), 0)")
_attribute("u_chart", "C12 G7 G9 G10", "u", "x / n", "rate", f"rate + {U_HALF}",
           f"greatest(rate - {U_HALF}, 0)")

LANEY = """,
res AS (
  SELECT idx, (x / n - rate) / CASE WHEN {s} > 0 THEN {s} ELSE 1 END AS z FROM num, tot),
adj AS (SELECT avg(abs(z - prev)) / 1.128 AS sz
        FROM (SELECT z, lag(z) OVER (ORDER BY idx) AS prev FROM res))"""
_attribute("laney_p_chart", "C13 G8", "laney_p", "x / n", "rate", f"least(rate + sz * {P_HALF}, 1)",
           f"greatest(rate - sz * {P_HALF}, 0)", LANEY.format(s="sqrt(rate * (1 - rate) / n)"))
_attribute("laney_u_chart", "C14 G8", "laney_u", "x / n", "rate", f"rate + sz * {U_HALF}",
           f"greatest(rate - sz * {U_HALF}, 0)", LANEY.format(s="sqrt(rate / n)"))


@case("attribute_parameters", "C9 C11 G6 G7", "chart rate~ center~ sigma_hat~ n_used#", DAYS + """,
m AS (SELECT avg(sqrt(rate * (1 - rate) / n)) AS sp, avg(sqrt(n * rate)) AS sc,
             avg(n * rate) AS cc FROM num, tot),
answer AS (
  SELECT 'p' AS chart, rate, rate AS center, sp AS sigma_hat, n_used FROM tot, m
  UNION ALL SELECT 'c', rate, cc, sc, n_used FROM tot, m)""")
def attribute_parameters(spark, d):
    def one(kind):
        return attributes.attribute(kind, days(spark, d), DAILY).params.select(
            F.lit(kind).alias("chart"), "rate", "center", "sigma_hat", "n_used"
        )

    return one("p").unionByName(one("c"))


@case("np_chart_fixed_trials", "C10", f"o_orderpriority phase subgroup {LINES}", """
sub AS (
  SELECT o_orderpriority, 'all' AS phase, strftime(o_orderdate, '%Y-%m') AS subgroup,
         min(o_orderdate) AS first, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS x
  FROM orders GROUP BY ALL),
num AS (SELECT *, 400.0 AS n,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY first, subgroup) - 1 AS idx FROM sub),
tot AS (SELECT o_orderpriority, sum(x) / sum(n) AS p FROM num GROUP BY 1),
answer AS (
  SELECT num.*, x AS value, n * p AS cl, least(n * p + 3 * sqrt(n * p * (1 - p)), n) AS ucl,
         greatest(n * p - 3 * sqrt(n * p * (1 - p)), 0) AS lcl FROM num JOIN tot USING (o_orderpriority))""")
def np_chart_fixed_trials(spark, d):
    orders = table(spark, d, "orders").withColumns(
        {
            "month": F.date_format("o_orderdate", "yyyy-MM"),
            "done": (F.col("o_orderstatus") == "F").cast("double"),
        }
    )
    roles = Roles("done", "o_orderdate", "o_orderpriority", subgroup="month")
    return attributes.attribute("np", orders, roles, n_trials=400).points


# -- rare events ------------------------------------------------------------------------
def gaps(spark, d):
    """Rows since the event of the same type before."""
    rows = events(spark, d).select("event_type", "event_id", "ts")
    seq = sequence(rows, "event_type", "event_id")
    seq = seq.frame(
        1,
        lambda w: {
            "gap": (F.col("event_id") - F.lag("event_id").over(w)).cast("double"),
            "seconds": F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1e6,
        },
    )
    return seq.df.where(F.col("gap").isNotNull()).drop("idx")


GAP = Roles("gap", "event_id", "event_type")
GAPS_SQL = """
g AS (
  SELECT event_type, 'all' AS phase, event_id,
         CAST(event_id - lag(event_id) OVER w AS DOUBLE) AS gap,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS seconds
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
num AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx
        FROM g WHERE gap IS NOT NULL)"""


@case("g_chart_parameters", "C15", f"{SERIES} center~ overdispersion~ freedom~ n_used#", GAPS_SQL + """,
p AS (SELECT event_type, phase, avg(gap) AS center,
             greatest(var_samp(gap) / avg(gap) - 1, 0) AS overdispersion, count(*) AS n_used
      FROM num GROUP BY ALL),
answer AS (SELECT *, 2 / (1 + overdispersion) AS freedom FROM p)""")
def g_chart_parameters(spark, d):
    return rare_events.g(gaps(spark, d), GAP).params


# The chi-square quantile with fractional degrees of freedom: bisection of the gamma series.
G_SQL = "RECURSIVE " + GAPS_SQL.strip() + """,
p AS (SELECT event_type, phase, avg(gap) AS center, greatest(var_samp(gap) / avg(gap) - 1, 0) + 1 AS scale FROM num GROUP BY ALL),
ask AS (SELECT event_type, phase, center, scale, 1 / scale AS a, tail
        FROM p, (VALUES (0.0013498980316300933), (0.9986501019683699)) t(tail)),
halved AS (
  SELECT *, 0 AS step, 0.0::DOUBLE AS low, 64.0::DOUBLE AS high FROM ask
  UNION ALL
  SELECT event_type, phase, center, scale, a, tail, step + 1, CASE WHEN below THEN (low + high) / 2 ELSE low END,
         CASE WHEN below THEN high ELSE (low + high) / 2 END FROM (
    SELECT *, list_sum(list_transform(range(300), lambda n: exp((a + n) * ln((low + high) / 2) - (low + high) / 2 - lgamma(a + n + 1)))) < tail AS below
    FROM halved WHERE step < 70)),
lim AS (SELECT event_type, phase, center, max((low + high) * scale - 1) FILTER (tail > 0.5) / 2 AS ucl,
               greatest(max((low + high) * scale - 1) FILTER (tail < 0.5) / 2, 0) AS lcl FROM halved WHERE step = 70 GROUP BY ALL)"""


@case("g_chart", "C15", f"{SERIES} {LINES}", G_SQL + """,
answer AS (SELECT num.event_type, num.phase, idx, gap AS value, ucl, center AS cl, lcl FROM num JOIN lim USING (event_type, phase))""")
def g_chart(spark, d):
    return rare_events.g(gaps(spark, d), GAP).points


# The shape by bisection of the likelihood's slope.
WEIBULL_SQL = "RECURSIVE " + GAPS_SQL.strip() + """,
w AS (SELECT event_type, seconds AS x FROM num WHERE seconds > 0),
s AS (SELECT event_type, max(x) AS top, avg(ln(x)) - ln(max(x)) AS mean FROM w GROUP BY 1),
v AS (SELECT event_type, x / top AS y, ln(x / top) AS ly, mean, top FROM w JOIN s USING (event_type)),
halved AS (
  SELECT event_type, 0 AS step, 0.01::DOUBLE AS low, 100.0::DOUBLE AS high FROM s
  UNION ALL
  SELECT event_type, step + 1, CASE WHEN slope > 0 THEN (low + high) / 2 ELSE low END,
         CASE WHEN slope > 0 THEN high ELSE (low + high) / 2 END FROM (
    SELECT h.event_type, step, low, high,
           2 / (low + high) + any_value(mean) - sum(pow(y, (low + high) / 2) * ly) / sum(pow(y, (low + high) / 2)) AS slope
    FROM halved h JOIN v USING (event_type) WHERE step < 60 GROUP BY h.event_type, step, low, high)),
fit AS (SELECT event_type, (low + high) / 2 AS shape, any_value(top) * pow(avg(pow(y, (low + high) / 2)), 2 / (low + high)) AS scale,
               true AS converged
        FROM halved JOIN v USING (event_type) WHERE step = 60 GROUP BY event_type, low, high)"""


_TAIL = NORMAL.cdf(-3.0)


@case("t_chart", "C16", f"{SERIES} {LINES}", WEIBULL_SQL + f""",
answer AS (
  SELECT num.event_type, phase, idx, seconds AS value, scale * pow(ln(2), 1 / shape) AS cl,
         scale * pow(-ln({_TAIL!r}), 1 / shape) AS ucl,
         scale * pow(-ln(1 - {_TAIL!r}), 1 / shape) AS lcl FROM num JOIN fit USING (event_type))""")
def t_chart(spark, d):
    return rare_events.t(gaps(spark, d), Roles("seconds", "event_id", "event_type")).points


@case("weibull_parameters", "C16", "event_type shape~ scale~ converged", WEIBULL_SQL + ", answer AS (SELECT * FROM fit)")
def weibull_parameters(spark, d):
    return rare_events.t(gaps(spark, d), Roles("seconds", "event_id", "event_type")).params


# -- short run ---------------------------------------------------------------------------
PRODUCTS = Roles("p_retailprice", "p_partkey", subgroup="p_type")
SHORT_SQL = """
seq AS (
  SELECT 'all' AS phase, p_type AS product, p_retailprice AS x,
         row_number() OVER (ORDER BY p_partkey) - 1 AS idx,
         lag(p_retailprice) OVER (PARTITION BY p_type ORDER BY p_partkey) AS prev FROM part),
prod AS (SELECT product, avg(x) AS target, coalesce(avg(abs(x - prev)) / 1.128, 0) AS s
         FROM seq GROUP BY 1),
tr AS (SELECT phase, product, idx, {transform} AS value FROM seq JOIN prod USING (product)),
mv AS (SELECT *, lag(value) OVER (ORDER BY idx) AS prev FROM tr),
par AS (SELECT {center} AS c, avg(abs(value - prev)) AS mr_bar, avg(abs(value - prev)) / 1.128 AS sigma FROM mv)"""


@case("short_run_centered", "C18", f"phase product {LINES}",
      SHORT_SQL.format(transform="x - target", center="avg(value)") + """,
answer AS (SELECT mv.*, c AS cl, c + 3 * sigma AS ucl, c - 3 * sigma AS lcl FROM mv, par)""")
def short_run_centered(spark, d):
    return short_run.short_run(table(spark, d, "part"), PRODUCTS).points


@case("short_run_standardized", "C18", f"phase product {LINES}",
      SHORT_SQL.format(transform="CASE WHEN s > 0 THEN (x - target) / s ELSE 0 END", center="0.0") + """,
answer AS (SELECT mv.*, c AS cl, c + 3 * sigma AS ucl, c - 3 * sigma AS lcl FROM mv, par)""")
def short_run_standardized(spark, d):
    return short_run.short_run(table(spark, d, "part"), PRODUCTS, scaling="standardized").points


@case("short_run_dispersion", "C18", f"phase {LINES}",
      SHORT_SQL.format(transform="x - target", center="avg(value)") + """,
answer AS (
  SELECT phase, idx - 1 AS idx, abs(value - prev) AS value, mr_bar AS cl,
         mr_bar * (1 + 3 * 0.8525 / 1.128) AS ucl,
         mr_bar * greatest(1 - 3 * 0.8525 / 1.128, 0) AS lcl FROM mv, par WHERE idx >= 1)""")
def short_run_dispersion(spark, d):
    return short_run.short_run(table(spark, d, "part"), PRODUCTS).secondary_points


# -- time weighted --------------------------------------------------------------------------
EWMA_SQL = EVENTS + ", sm AS " + smoothed("pts", "event_type, phase", {"e": "value"}, 0.2, 180) + """,
ew AS (
  SELECT p.event_type, p.phase, p.idx, p.value AS observed, sigma_hat, center,
         e + pow(0.8, p.idx + 1) * center AS value
  FROM pts p JOIN sm USING (event_type, phase, idx))"""


@case("ewma_chart", "C20 G3", f"{SERIES} {LINES} residual~ signal", EWMA_SQL + """,
ln AS (
  SELECT *, 3 * sigma_hat * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) AS half,
         observed - coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY idx), center) AS residual
  FROM ew),
answer AS (
  SELECT *, center AS cl, center + half AS ucl, center - half AS lcl,
         value > center + half OR value < center - half AS signal FROM ln)""")
def ewma_chart(spark, d):
    return time_weighted.ewma(events(spark, d), EVENT_VALUES).points


@case("ewma_chart_blocks", "C20 O1", f"{SERIES} idx# value~", EWMA_SQL + ", answer AS (SELECT * FROM ew)")
def ewma_chart_blocks(spark, d):
    return time_weighted.ewma(events(spark, d), EVENT_VALUES, block_rows=700).points


@case("ewma_of_subgroup_means", "C20 A10", f"l_returnflag phase {LINES}", MONTHS + """,
mv AS (SELECT *, lag(mean) OVER (PARTITION BY l_returnflag ORDER BY idx) AS prev FROM num),
par AS (SELECT l_returnflag, avg(mean) AS t, avg(abs(mean - prev)) / 1.128 AS s, avg(n) AS n_bar
        FROM mv GROUP BY 1),
sm AS """ + smoothed("num", "l_returnflag, phase", {"e": "mean"}, 0.3, 120) + """,
answer AS (
  SELECT num.l_returnflag, num.phase, num.idx, e + pow(0.7, num.idx + 1) * t AS value, t AS cl,
         t + 3 * s * sqrt(0.3 / 1.7 / n_bar) AS ucl, t - 3 * s * sqrt(0.3 / 1.7 / n_bar) AS lcl
  FROM num JOIN sm USING (l_returnflag, phase, idx) JOIN par ON par.l_returnflag = num.l_returnflag)""")
def ewma_of_subgroup_means(spark, d):
    return time_weighted.ewma(months(spark, d), MONTHLY, lam=0.3, exact_limits=False).points


@case("ewma_forecast", "C20", f"{SERIES} forecast~", EWMA_SQL + """,
answer AS (SELECT event_type, phase, max_by(value, idx) AS forecast FROM ew GROUP BY ALL)""")
def ewma_forecast(spark, d):
    return time_weighted.ewma(events(spark, d), EVENT_VALUES).note("forecast")


CUSUM_SQL = EVENTS + """,
cz AS (
  SELECT *, sum((value - center) / sigma_hat - 0.5) OVER w AS up,
         sum((value - center) / sigma_hat + 0.5) OVER w AS down,
         sum((value - center) / sigma_hat) OVER w AS total
  FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS UNBOUNDED PRECEDING)),
cs AS (
  SELECT *, up - least(0, min(up) OVER w) AS c_plus, down - greatest(0, max(down) OVER w) AS c_minus
  FROM cz WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


@case("cusum_chart", "C21", f"{SERIES} idx# value^ ucl~ cl~ lcl~ c_minus^ signal_upper signal_lower", CUSUM_SQL + """,
answer AS (
  SELECT event_type, phase, idx, c_plus AS value, c_minus, 5.0 AS ucl, 0.0 AS cl, -5.0 AS lcl,
         c_plus > 5 AS signal_upper, c_minus < -5 AS signal_lower FROM cs)""")
def cusum_chart(spark, d):
    return time_weighted.cusum(events(spark, d), EVENT_VALUES).points


@case("cusum_chart_blocks", "C21 O1", f"{SERIES} idx# value^ c_minus^", CUSUM_SQL + """,
answer AS (SELECT event_type, phase, idx, c_plus AS value, c_minus FROM cs)""")
def cusum_chart_blocks(spark, d):
    return time_weighted.cusum(events(spark, d), EVENT_VALUES, block_rows=300).points


@case("cusum_shift_starts", "C21", f"{SERIES} side signal_idx# shift_start#", CUSUM_SQL + """,
sd AS (
  SELECT event_type, phase, idx, 'upper' AS side, c_plus AS stat, c_plus > 3 AS sig FROM cs
  UNION ALL SELECT event_type, phase, idx, 'lower', c_minus, c_minus < -3 FROM cs),
lg AS (
  SELECT *, lag(sig) OVER w AS was,
         max(CASE WHEN stat = 0 THEN idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS zero
  FROM sd WINDOW w AS (PARTITION BY event_type, side ORDER BY idx)),
answer AS (SELECT *, idx AS signal_idx, coalesce(zero + 1, 0) AS shift_start FROM lg
           WHERE sig AND NOT coalesce(was, false))""")
def cusum_shift_starts(spark, d):
    return time_weighted.cusum(events(spark, d), EVENT_VALUES, h=3.0).note("shifts")


@case("cusum_vmask_chart", "C22", f"{SERIES} idx# value^ ucl~ cl~ lcl~ vertex_x~ vertex_y^ upper_slope~ lower_slope~ signal",
      CUSUM_SQL + """,
answer AS (
  SELECT event_type, phase, idx, total AS value, 5.0 AS ucl, 0.0 AS cl, -5.0 AS lcl, idx + 5.0 AS vertex_x,
         total AS vertex_y, 0.5 AS upper_slope, -0.5 AS lower_slope, c_plus > 5 OR c_minus < -5 AS signal
  FROM cs)""")
def cusum_vmask_chart(spark, d):
    return time_weighted.cusum_vmask(events(spark, d), EVENT_VALUES).points


# -- multivariate -----------------------------------------------------------------------------
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
              "l_extendedprice", "l_quantity", "l_discount")
LINE_ROLES = Roles("l_quantity", LINE_ORDER, "l_returnflag")
LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount"]


def _inverse_sql(source: str, key: str) -> str:
    """3 x 3 covariance and its inverse by cofactors."""
    return f"""
mom AS (
  SELECT {key}, phase, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
         covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac,
         covar_samp(b, b) AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) AS cc
  FROM {source} GROUP BY ALL),
det AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS dt FROM mom),
inv AS (
  SELECT *, (bb * cc - bc * bc) / dt AS iaa, (ac * bc - ab * cc) / dt AS iab,
         (ab * bc - ac * bb) / dt AS iac, (aa * cc - ac * ac) / dt AS ibb,
         (ac * ab - aa * bc) / dt AS ibc, (aa * bb - ab * ab) / dt AS icc FROM det)"""


T2_SQL = """
src AS (
  SELECT l_returnflag, 'all' AS phase, l_quantity AS a, l_extendedprice AS b, l_discount AS c,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey,
           l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount) - 1 AS idx
  FROM lineitem),""" + _inverse_sql("src", "l_returnflag") + """,
dev AS (SELECT src.l_returnflag, src.phase, idx, a - ma AS x, b - mb AS y, c - mc AS z, inv.* EXCLUDE (l_returnflag, phase)
        FROM src JOIN inv USING (l_returnflag, phase)),
t2 AS (
  SELECT *, x * (iaa * x + iab * y + iac * z) AS c0, y * (iab * x + ibb * y + ibc * z) AS c1,
         z * (iac * x + ibc * y + icc * z) AS c2 FROM dev)"""


@case("hotelling_t2_chart", "C23 A15", "l_returnflag phase idx# value^ ucl~ share_0^ share_1^ share_2^ signal",
      T2_SQL + f""",
answer AS (SELECT *, c0 + c1 + c2 AS value, c0 AS share_0, c1 AS share_1, c2 AS share_2,
                  {CHI2_3} AS ucl, c0 + c1 + c2 > {CHI2_3} AS signal FROM t2)""")
def hotelling_t2_chart(spark, d):
    points = multivariate.hotelling_t2(table(spark, d, "lineitem"), LINE_ROLES, LINE_VALUES, stage=2).points
    return points.select("*", *[F.get("contributions", i).alias(f"share_{i}") for i in range(3)])


# The F quantile depends on n, so only the statistic is compared.
@case("hotelling_t2_first_stage", "C23", "l_returnflag phase idx# value^", T2_SQL + """,
answer AS (SELECT *, c0 + c1 + c2 AS value FROM t2)""")
def hotelling_t2_first_stage(spark, d):
    return multivariate.hotelling_t2(table(spark, d, "lineitem"), LINE_ROLES, LINE_VALUES).points


# The F quantile by bisection of the series of the incomplete beta.
F_SQL = """RECURSIVE
n AS (SELECT l_returnflag, 'all' AS phase, count(*) AS n, (count(*) - 3) / 2 AS b FROM lineitem GROUP BY ALL),
halved AS (
  SELECT *, 0 AS step, 0.0::DOUBLE AS low, least(1.0, 40.0 / b)::DOUBLE AS high FROM n
  UNION ALL
  SELECT l_returnflag, phase, n, b, step + 1, CASE WHEN below THEN (low + high) / 2 ELSE low END,
         CASE WHEN below THEN high ELSE (low + high) / 2 END FROM (
    SELECT *, list_sum(list_transform(range(400), lambda k: exp(lgamma(1.5 + b + k) - lgamma(b) - lgamma(2.5 + k)
                       + (1.5 + k) * ln((low + high) / 2) + b * ln(1 - (low + high) / 2)))) < 0.9973 AS below
    FROM halved WHERE step < 80 AND low + high < 2)),
lim AS (SELECT *, (low + high) / 2 AS y FROM halved WHERE step = 80)"""


@case("hotelling_t2_limits", "C23", "l_returnflag phase n# t2_limit^", F_SQL + """,
answer AS (SELECT *, 3 * (n - 1) * (n + 1) / (n * (n - 3)) * (n - 3) / 3 * y / (1 - y) AS t2_limit FROM lim)""")
def hotelling_t2_limits(spark, d):
    params = multivariate.hotelling_t2(table(spark, d, "lineitem"), LINE_ROLES, LINE_VALUES).params
    return params.withColumnRenamed("limit", "t2_limit")


@case("covariance_parameters", "A15", "l_returnflag phase n# m0~ m1~ v00~ v01~ v11~",
      """src AS (SELECT l_returnflag, 'all' AS phase, l_quantity AS a, l_discount AS b FROM lineitem),
answer AS (SELECT l_returnflag, phase, count(*) AS n, avg(a) AS m0, avg(b) AS m1, covar_samp(a, a) AS v00,
                  covar_samp(a, b) AS v01, covar_samp(b, b) AS v11 FROM src GROUP BY ALL)""")
def covariance_parameters(spark, d):
    seq, p = multivariate.variables(table(spark, d, "lineitem"), LINE_ROLES, ["l_quantity", "l_discount"])
    cov = [F.get("covariance", i) for i in (0, 1, 3)]
    return multivariate.moments(seq, p).select(
        "l_returnflag", "phase", "n", F.get("mean_vector", 0).alias("m0"),
        F.get("mean_vector", 1).alias("m1"), cov[0].alias("v00"), cov[1].alias("v01"), cov[2].alias("v11"),
    )


__all__ = ["CONSTANTS", "MR_DIVISOR"]
