"""Sources, sinks, preparation steps and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import case, scratch, table
from plumbline.operators import prep, profile, variables
from plumbline.operators.series import Roles
from plumbline.plans.steps import replay
from plumbline.sources import tables

PART = "p_partkey# p_name p_brand p_type"
EVENT = "event_id# event_type value~"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def sparse(spark, d):
    """Events whose small values were not recorded."""
    return events(spark, d).withColumn("value", F.when(F.col("value") >= 20, F.col("value")))


SPARSE = "sparse AS (SELECT * REPLACE (CASE WHEN value >= 20 THEN value END AS value) FROM events)"


def part(spark, d):
    return table(spark, d, "part")


# -- sources and sinks --------------------------------------------------------------
@case("csv_round_trip", "S1 S10", "p_partkey p_name p_brand p_type p_size p_retailprice", """
answer AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
                  CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part)""")
def csv_round_trip(spark, d):
    path = scratch(spark)
    tables.write_csv(part(spark, d), path)
    return tables.read_csv(spark, path)


@case("csv_preview", "S2", "o_orderkey# o_totalprice~", """
answer AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)""")
def csv_preview(spark, d):
    return tables.preview(tables.ordered_rows(table(spark, d, "orders"), "o_orderkey"))


def _type_sql(columns: list[str], source: str = "events") -> str:
    parts = [
        f"""SELECT '{c}' AS name, {i} AS ordinal, count(v) AS present,
  count(TRY_CAST(v AS DOUBLE)) AS numbers, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL AND
  regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}:\\d{{2}}.*)?$')) AS dates
  FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {source})"""
        for i, c in enumerate(columns)
    ]
    return (
        "counted AS ("
        + " UNION ALL ".join(parts)
        + """), typed AS (SELECT name, ordinal, CASE WHEN numbers / present > 0.8 THEN 'numeric'
  WHEN dates / present > 0.8 THEN 'datetime' ELSE 'text' END AS dtype FROM counted)"""
    )


COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@case("column_types", "S3", "name ordinal# dtype", _type_sql(COLUMNS) + ", answer AS (SELECT * FROM typed)")
def column_types(spark, d):
    return tables.column_types(events(spark, d))


LATE = "late AS (SELECT event_id, CASE WHEN event_id < 50 THEN CAST(value AS VARCHAR) ELSE event_type END AS reading FROM events), "


@case("late_text_column", "S3", "name ordinal# dtype", LATE + _type_sql(["event_id", "reading"], "late") + """,
answer AS (SELECT * FROM typed)""")
def late_text_column(spark, d):
    """A column that holds numbers in its first rows only."""
    reading = F.when(F.col("event_id") < 50, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return tables.column_types(events(spark, d).select("event_id", reading.alias("reading")))


@case("role_suggestions", "S4", "name ordinal# dtype role", _type_sql(COLUMNS) + """,
answer AS (SELECT *, CASE WHEN name = 'value' THEN 'value' END AS role FROM typed)""")
def role_suggestions(spark, d):
    return tables.schema_profile(events(spark, d))


@case("role_fallback", "S4", "name ordinal# dtype role", "staged AS (SELECT *, o_orderpriority AS stage FROM orders), "
      + _type_sql(["o_orderkey", "o_orderstatus", "stage", "o_orderdate"], "staged") + """,
answer AS (
  SELECT *, CASE WHEN ordinal = (SELECT min(ordinal) FROM typed WHERE dtype = 'numeric') THEN 'value'
                 WHEN name = 'stage' THEN 'phase' END AS role FROM typed)""")
def role_fallback(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("stage"), "o_orderdate"
    )
    return tables.schema_profile(rows)


@case("typed_table", "S5", "c_custkey~ c_name c_mktsegment~ c_acctbal~", """
answer AS (SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_mktsegment, c_acctbal FROM customer)""")
def typed_table(spark, d):
    text = table(spark, d, "customer").select(
        *[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")]
    )
    return tables.typed_table(text, {"c_custkey": "numeric", "c_mktsegment": "numeric", "c_acctbal": "numeric"})


def documents_of_suppliers(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tables.ingest_rows(rows, "s_suppkey", "suppliers")


@case("ingested_documents", "S6 S8", "dataset_id sequence_index# raw_json", """
answer AS (
  SELECT 'suppliers' AS dataset_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS sequence_index,
         '{"s_suppkey":"' || s_suppkey || '","s_name":"' || s_name || '","s_acctbal":"' || s_acctbal || '"}'
           AS raw_json FROM supplier)""")
def ingested_documents(spark, d):
    return tables.ordered_rows(documents_of_suppliers(spark, d), "sequence_index")


@case("document_measurements", "S7", "event_id# value~", """
answer AS (SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS value FROM events
           WHERE value IS NOT NULL)""")
def document_measurements(spark, d):
    return tables.extract_measurements(events(spark, d).drop("value"), "props", "k")


@case("document_export", "S10 S7", "sequence_index# s_suppkey s_name s_acctbal", """
answer AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS sequence_index,
                  CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_acctbal AS VARCHAR) AS s_acctbal
           FROM supplier)""")
def document_export(spark, d):
    return tables.document_table(documents_of_suppliers(spark, d), "raw_json", "sequence_index")


@case("dataset_list", "S9", "dataset_id# point_count#", """
answer AS (SELECT c_custkey AS dataset_id, count(o_orderkey) AS point_count
           FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def dataset_list(spark, d):
    datasets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_acctbal").alias("created_at")
    )
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"))
    return tables.dataset_list(datasets, rows)


@case("latest_analysis", "S11", "dataset_id event_type center~ n#", """
answer AS (SELECT 'events' AS dataset_id, event_type, avg(value) AS center, count(*) AS n
           FROM events WHERE value IS NOT NULL GROUP BY ALL)""")
def latest_analysis(spark, d):
    path = scratch(spark)
    roles = Roles("value", "event_id", "event_type")
    older = variables.imr(events(spark, d).where(F.col("value") > 50), roles)
    newer = variables.imr(events(spark, d), roles)
    tables.save_analysis(older.params, path, "events", "2024-01-01 00:00:00")
    tables.save_analysis(newer.params, path, "events", "2024-02-01 00:00:00")
    return tables.latest_analysis(spark.read.parquet(path))


@case("saved_table", "S12 T11", EVENT, "answer AS (SELECT * FROM events WHERE value >= 20)")
def saved_table(spark, d):
    path = scratch(spark)
    tables.save_table(prep.handle_missing(sparse(spark, d), "value", "remove"), path)
    return spark.read.parquet(path)


@case("charted_points", "S13", "id label subgroup_label phase_id value~ excluded", SPARSE + """,
answer AS (SELECT 'pt-' || event_id AS id, 'pt-' || event_id AS label, event_type AS subgroup_label,
                  CAST(NULL AS VARCHAR) AS phase_id, coalesce(value, 0) AS value, false AS excluded FROM sparse)""")
def charted_points(spark, d):
    return tables.chart_points(sparse(spark, d), "event_id", "value", subgroup="event_type")


# -- filters ------------------------------------------------------------------------------
def _filter(name, rows, column, operator, value, where):
    @case(name, rows, EVENT, SPARSE + f", answer AS (SELECT * FROM sparse WHERE {where})")
    def run(spark, d):
        return prep.filter_rows(sparse(spark, d), column, operator, value)


_filter("filter_equal", "T1", "event_type", "eq", "error", "event_type = 'error'")
_filter("filter_not_equal", "T1", "value", "neq", 25.5, "value IS DISTINCT FROM 25.5")
_filter("filter_greater", "T2", "value", "gt", "50", "value > 50")
_filter("filter_less_or_equal", "T2", "value", "lte", 50, "value <= 50")
_filter("filter_timestamp", "T2", "ts", "gte", "2024-01-15 12:00:00", "ts >= TIMESTAMP '2024-01-15 12:00:00'")
_filter("filter_contains", "T3", "event_type", "contains", "ic", "contains(event_type, 'ic')")
_filter("filter_not_contains", "T3", "event_type", "not_contains", "ic", "NOT contains(event_type, 'ic')")
_filter("filter_between", "T4", "value", "between", (30, 60), "value BETWEEN 30 AND 60")
_filter("filter_null", "T5", "value", "is_null", None, "value IS NULL")
_filter("filter_not_null", "T5", "value", "is_not_null", None, "value IS NOT NULL")


@case("sorted_rows", "T6", EVENT, SPARSE + ", answer AS (SELECT * FROM sparse)")
def sorted_rows(spark, d):
    return prep.sort_rows(sparse(spark, d), [("event_type", "asc"), ("value", "desc"), ("event_id", "asc")])


@case("page_of_rows", "T21 T6", EVENT, SPARSE + """,
answer AS (SELECT * FROM sparse ORDER BY event_type, event_id LIMIT 50 OFFSET 500)""")
def page_of_rows(spark, d):
    return prep.page(sparse(spark, d), ["event_type", "event_id"], 500, 50)


@case("duplicates_with_map", "T10", EVENT + " user_id# first_key", """
answer AS (SELECT *, 'k' || event_id % 3 AS first_key FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""")
def duplicates_with_map(spark, d):
    """Rows with a map column, which cannot be ordered; the last row of each user."""
    rows = events(spark, d).withColumns({
        "tags": F.create_map(F.concat(F.lit("k"), F.col("event_id") % 3), F.lit(1)), "back": -F.col("event_id")})
    return prep.remove_duplicates(rows, ["user_id"], "back").withColumn("first_key", F.map_keys("tags")[0])


@case("first_of_duplicates", "T10", EVENT + " user_id#", """
answer AS (SELECT * FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)""")
def first_of_duplicates(spark, d):
    return prep.remove_duplicates(events(spark, d), ["user_id", "event_type"], "event_id")


# -- missing values ------------------------------------------------------------------------
def _missing(name, rows, strategy, value, expression):
    @case(name, rows, EVENT, SPARSE + f", answer AS (SELECT * REPLACE ({expression} AS value) FROM sparse)")
    def run(spark, d):
        return prep.handle_missing(sparse(spark, d), "value", strategy, value, order="event_id")


_missing("fill_mean", "T12", "fill_mean", None, "coalesce(value, (SELECT avg(value) FROM sparse))")
_missing("fill_median", "T12", "fill_median", None, "coalesce(value, (SELECT median(value) FROM sparse))")
_missing("fill_zero", "T13", "fill_zero", None, "coalesce(value, 0)")
_missing("fill_custom", "T13", "fill_custom", -1.5, "coalesce(value, -1.5)")
_missing("fill_down", "T14", "fill_down", None, "last_value(value IGNORE NULLS) OVER (ORDER BY event_id)")
_missing("fill_up", "T15", "fill_up", None,
         "first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@case("fill_down_blocks", "T14 O1", EVENT, SPARSE + """,
answer AS (SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value) FROM sparse)""")
def fill_down_blocks(spark, d):
    return prep.handle_missing(sparse(spark, d), "value", "fill_down", order="event_id", block_rows=1000)


@case("missing_removed", "T11", EVENT, SPARSE + ", answer AS (SELECT * FROM sparse WHERE value IS NOT NULL)")
def missing_removed(spark, d):
    return prep.handle_missing(sparse(spark, d), "value", "remove")


# -- text -------------------------------------------------------------------------------------
def _text(name, rows, sql, change):
    @case(name, rows, PART, f"answer AS (SELECT * REPLACE ({sql}) FROM part)")
    def run(spark, d):
        return change(part(spark, d))


_text("replace_first", "T7",
      "CASE WHEN instr(p_name, 'e') > 0 THEN left(p_name, instr(p_name, 'e') - 1) || 'E' || "
      "substr(p_name, instr(p_name, 'e') + 1) ELSE p_name END AS p_name",
      lambda df: prep.find_replace(df, "p_name", "e", "E"))
_text("replace_pattern", "T8", r"regexp_replace(p_name, '(\w+) (\w+)', '\2-\1', 'g') AS p_name",
      lambda df: prep.find_replace(df, "p_name", r"(\w+) (\w+)", "$2-$1", regex=True))
_text("upper_text", "T16", "upper(p_name) AS p_name", lambda df: prep.clean_text(df, "p_name", "upper"))
_text("lower_text", "T16", "lower(p_brand) AS p_brand", lambda df: prep.clean_text(df, "p_brand", "lower"))
_text("title_text", "T17",
      "array_to_string(list_transform(string_split(p_name, ' '), "
      "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS p_name",
      lambda df: prep.clean_text(df, "p_name", "title"))


@case("trim_text", "T16", "doc_id# text", r"""
answer AS (SELECT doc_id, regexp_replace(text, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS text FROM documents)""")
def trim_text(spark, d):
    return prep.clean_text(table(spark, d, "documents"), "text", "trim")


@case("trim_every_text_column", "T18", "n_nationkey# n_name", """
answer AS (SELECT n_nationkey, n_name FROM nation)""")
def trim_every_text_column(spark, d):
    padded = table(spark, d, "nation").withColumn("n_name", F.concat(F.lit("  "), "n_name", F.lit(" \t")))
    return prep.trim_columns(padded)


@case("replace_everywhere", "T9", "event_id event_type value props", """
answer AS (SELECT replace(CAST(event_id AS VARCHAR), '1', 'x') AS event_id, replace(event_type, '1', 'x') AS event_type,
                  replace(CAST(value AS VARCHAR), '1', 'x') AS value, replace(props, '1', 'x') AS props FROM events)""")
def replace_everywhere(spark, d):
    rows = events(spark, d).drop("ts", "user_id")
    return prep.find_replace(rows, "__all__", "1", "x", regex=True)


# -- columns -------------------------------------------------------------------------------------
@case("reordered_columns", "T19", "p_type p_partkey# p_name", "answer AS (SELECT p_type, p_partkey, p_name FROM part)")
def reordered_columns(spark, d):
    return prep.reorder_columns(part(spark, d), ["p_type", "p_partkey"])


@case("visible_columns", "T20", "p_partkey# p_size#", "answer AS (SELECT p_partkey, p_size FROM part)")
def visible_columns(spark, d):
    return prep.select_columns(part(spark, d), ["p_partkey", "p_size"])


@case("renamed_column", "T22", "p_partkey# product", "answer AS (SELECT p_partkey, p_name AS product FROM part)")
def renamed_column(spark, d):
    return prep.rename_column(part(spark, d), "p_name", "product")


@case("changed_types", "T23", "p_partkey p_size p_brand_number~", """
answer AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size,
                  TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS p_brand_number FROM part)""")
def changed_types(spark, d):
    rows = part(spark, d).withColumn("p_brand_number", F.split_part("p_brand", F.lit("#"), F.lit(2)))
    for column in ("p_partkey", "p_size"):
        rows = prep.change_type(rows, column, "text")
    return prep.change_type(rows, "p_brand_number", "numeric")


@case("conversion_preview", "T24", "convertible# total#", """
v AS (SELECT CASE WHEN value > 50 THEN event_type ELSE CAST(value AS VARCHAR) END AS x FROM events),
answer AS (SELECT count(TRY_CAST(x AS DOUBLE)) AS convertible, count(x) AS total FROM v)""")
def conversion_preview(spark, d):
    mixed = F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return prep.preview_conversion(events(spark, d).withColumn("x", mixed), "x", "numeric")


@case("calculated_large_round", "T25", "o_orderkey# high low~ up", """
answer AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * 1e9 * 1e9 AS high, floor(-CAST(o_totalprice AS DOUBLE) / 3) AS low,
                  ceil(CAST(o_totalprice AS DOUBLE) * 1e17) AS up FROM orders)""")
def calculated_large_round(spark, d):
    """Doubles beyond 64-bit integers keep their value when they are rounded."""
    rows = table(spark, d, "orders")
    rows = prep.calculated_column(rows, "high", "round([o_totalprice] * 1000000000 * 1000000000)")
    rows = prep.calculated_column(rows, "low", "floor((0 - [o_totalprice]) / 3)")
    return prep.calculated_column(rows, "up", "ceil([o_totalprice] * 100000000000000000)")


@case("calculated_column", "T25", "l_orderkey# l_linenumber# net~ ratio~ shape~", """
answer AS (
  SELECT l_orderkey, l_linenumber,
         floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 0.5) AS net,
         l_extendedprice / nullif(l_discount, 0) AS ratio,
         sqrt(abs(least(l_quantity, 25) - greatest(l_tax, l_discount) * 2)) + ln(l_quantity + 1)
           / nullif(pow(l_quantity, 2) - 1, 0) AS shape FROM lineitem)""")
def calculated_column(spark, d):
    rows = table(spark, d, "lineitem")
    rows = prep.calculated_column(rows, "net", "round([l_extendedprice] * (1 - [l_discount]) * (1 + [l_tax]))")
    rows = prep.calculated_column(rows, "ratio", "[l_extendedprice] / [l_discount]")
    return prep.calculated_column(
        rows, "shape",
        "sqrt(abs(min([l_quantity], 25) - max([l_tax], [l_discount]) * 2))"
        " + log([l_quantity] + 1) / (pow([l_quantity], 2) - 1)",
    )


@case("recoded_values", "T26", "event_id# event_type kind", """
answer AS (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good'
                  ELSE event_type END AS kind FROM events)""")
def recoded_values(spark, d):
    return prep.recode(events(spark, d), "event_type", {"error": "bad", "purchase": "good"}, "kind")


@case("recoded_from_table", "T26", "s_suppkey# nation", """
answer AS (SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def recoded_from_table(spark, d):
    mapping = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("from"), F.col("n_name").alias("to")
    )
    return prep.recode(table(spark, d, "supplier"), "s_nationkey", mapping, "nation")


@case("equal_width_bins", "T27", "o_orderkey# bin", """
m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders),
b AS (SELECT floor((lo + w) * 1e6 + 0.5) / 1e6 AS b1, floor((lo + w * 2) * 1e6 + 0.5) / 1e6 AS b2,
             floor((lo + w * 3) * 1e6 + 0.5) / 1e6 AS b3, floor((lo + w * 4) * 1e6 + 0.5) / 1e6 AS b4 FROM m),
answer AS (
  SELECT o_orderkey, CASE WHEN o_totalprice <= b1 THEN 'bin_1' WHEN o_totalprice <= b2 THEN 'bin_2'
         WHEN o_totalprice <= b3 THEN 'bin_3' WHEN o_totalprice <= b4 THEN 'bin_4' ELSE 'bin_5' END AS bin
  FROM orders, b)""")
def equal_width_bins(spark, d):
    return prep.bin_column(table(spark, d, "orders"), "o_totalprice", 5, "bin")


@case("custom_bins", "T27", "event_id# bin", SPARSE + """,
answer AS (SELECT event_id, CASE WHEN value <= 30 THEN 'bin_1' WHEN value <= 60 THEN 'bin_2'
                  WHEN value > 60 THEN 'bin_3' END AS bin FROM sparse)""")
def custom_bins(spark, d):
    return prep.bin_column(sparse(spark, d), "value", new_column="bin", breaks=[30, 60])


@case("split_columns", "T28", "p_partkey# p_name_1 p_name_2 p_name_3", """
answer AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS p_name_1, string_split(p_name, ' ')[2] AS p_name_2,
                  string_split(p_name, ' ')[3] AS p_name_3 FROM part)""")
def split_columns(spark, d):
    return prep.split_column(part(spark, d), "p_name", " ", 3)


@case("joined_columns", "T29", "event_id# joined", SPARSE + """,
answer AS (SELECT event_id, event_type || '|' || coalesce(CAST(value AS VARCHAR), '') || '|' || user_id AS joined
           FROM sparse)""")
def joined_columns(spark, d):
    return prep.concat_columns(sparse(spark, d), ["event_type", "value", "user_id"], "|", "joined")


RULES = {
    "value": {"type": "range", "min": 25, "max": 150},
    "event_type": {"type": "allowed", "values": ["click", "view", "signup"]},
    "props": {"type": "regex", "pattern": r"\d{2}"},
}


@case("invalid_range", "T30", EVENT, SPARSE + ", answer AS (SELECT * FROM sparse WHERE value < 25 OR value > 150)")
def invalid_range(spark, d):
    return prep.validate_column(sparse(spark, d), "value", RULES["value"])


@case("invalid_allowed", "T30", EVENT, "answer AS (SELECT * FROM events WHERE event_type NOT IN ('click', 'view', 'signup'))")
def invalid_allowed(spark, d):
    return prep.validate_column(events(spark, d), "event_type", RULES["event_type"])


@case("invalid_pattern", "T30", EVENT, r"answer AS (SELECT * FROM events WHERE NOT regexp_matches(props, '\d{2}'))")
def invalid_pattern(spark, d):
    return prep.validate_column(events(spark, d), "props", RULES["props"])


@case("all_validations", "T31", "event_id# column_name", SPARSE + r""",
answer AS (
  SELECT event_id, 'value' AS column_name FROM sparse WHERE value < 25 OR value > 150
  UNION ALL SELECT event_id, 'event_type' FROM sparse WHERE event_type NOT IN ('click', 'view', 'signup')
  UNION ALL SELECT event_id, 'props' FROM sparse WHERE NOT regexp_matches(props, '\d{2}'))""")
def all_validations(spark, d):
    return prep.validate_all(sparse(spark, d), RULES, "event_id").withColumnRenamed("column", "column_name")


@case("excluded_rows", "T32", "event_id# excluded", """
answer AS (SELECT event_id, value > 200 AS excluded FROM events)""")
def excluded_rows(spark, d):
    rows = events(spark, d)
    return prep.mark_excluded(rows, rows.where(F.col("value") > 200), "event_id")


STEPS = [
    {"type": "missing", "params": {"column": "value", "strategy": "fill_down"}},
    {"type": "filter", "params": {"column": "value", "operator": "gte", "value": 25}},
    {"type": "find_replace", "params": {"column": "event_type", "find": "ie", "replace": "IE"}},
    {"type": "trim", "params": {"columns": ["props"]}},
    {"type": "rename", "params": {"old": "event_type", "new": "kind"}},
    {"type": "recode", "params": {"column": "kind", "mapping": {"error": "fault"}}},
    {"type": "calculated", "params": {"name": "half", "expression": "[value] / 2"}},
    {"type": "bin", "params": {"column": "value", "new_column": "level", "breaks": [50, 100]}},
    {"type": "split", "params": {"column": "props", "delimiter": ":", "parts": 2}},
    {"type": "concat", "params": {"columns": ["kind", "level"], "separator": "/", "new_column": "tag"}},
    {"type": "change_type", "params": {"column": "user_id", "target": "text"}},
    {"type": "dedup", "params": {"keys": ["user_id", "kind"]}},
    {"type": "sort", "params": {"by": [("event_id", "asc")]}},
]


@case("replayed_steps", "T33", "event_id# user_id kind half~ level props_2 tag", SPARSE + """,
a AS (SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value) FROM sparse),
b AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, value / 2 AS half,
         CASE event_type WHEN 'error' THEN 'fault' WHEN 'view' THEN 'vIEw' ELSE event_type END AS kind,
         CASE WHEN value <= 50 THEN 'bin_1' WHEN value <= 100 THEN 'bin_2' ELSE 'bin_3' END AS level,
         trim(string_split(props, ':')[2]) AS props_2 FROM a WHERE value >= 25),
answer AS (SELECT *, kind || '/' || level AS tag FROM b
           QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) = 1)""")
def replayed_steps(spark, d):
    return replay(sparse(spark, d), STEPS, order="event_id")


# -- profiles -------------------------------------------------------------------------------------
@case("column_statistics", "A1", "count# mean~ std~ min~ max~ median~ missing#", SPARSE + """,
answer AS (SELECT count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
                  max(value) AS max, median(value) AS median, count(*) - count(value) AS missing FROM sparse)""")
def column_statistics(spark, d):
    return profile.column_stats(sparse(spark, d), "value")


@case("profile_base", "A2", "column_name count# missing# missing_pct~ distinct_values#", SPARSE + """,
answer AS (
  SELECT 'value' AS column_name, count(*) AS count, count(*) - count(value) AS missing,
         (count(*) - count(value)) / count(*) * 100 AS missing_pct, count(DISTINCT value) AS distinct_values FROM sparse
  UNION ALL SELECT 'event_type', count(*), 0, 0, count(DISTINCT event_type) FROM sparse
  UNION ALL SELECT 'props', count(*), 0, 0, count(DISTINCT props) FROM sparse)""")
def profile_base(spark, d):
    rows = profile.profile_base(sparse(spark, d), ["value", "event_type", "props"])
    return rows.withColumnsRenamed({"column": "column_name", "distinct": "distinct_values"})


BY = ["l_returnflag"]
MOMENTS = """
m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std,
             min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1),
mm AS (
  SELECT m.*, avg(((l_extendedprice - mean) / std) ** 3) OVER w AS skewness,
         avg(((l_extendedprice - mean) / std) ** 4) OVER w - 3 AS kurtosis, std / abs(mean) * 100 AS cv
  FROM lineitem JOIN m USING (l_returnflag)
  WINDOW w AS (PARTITION BY l_returnflag) QUALIFY row_number() OVER w = 1)"""


@case("numeric_profile", "A3 A8", "l_returnflag n# mean~ std~ min~ max~ skewness~ kurtosis~ cv~ label", MOMENTS + """,
answer AS (SELECT *, CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal'
                          WHEN abs(skewness) < 1 AND abs(kurtosis) < 2 THEN 'mild' ELSE 'non-normal' END AS label FROM mm)""")
def numeric_profile(spark, d):
    rows = profile.numeric_moments(table(spark, d, "lineitem"), "l_extendedprice", BY)
    return rows.withColumn("label", profile.normality(F.col("skewness"), F.col("kurtosis")))


RANKED = """
r AS (SELECT l_returnflag, l_extendedprice AS v,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k,
             count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)"""


@case("shared_profile", "A2 A4 A7", "column_name count# missing# distinct_values# q1~ p90~ median~ tops", SPARSE + """,
long AS (
  SELECT 'value' AS column_name, CAST(value AS VARCHAR) AS v, CAST(value AS DOUBLE) AS x FROM sparse
  UNION ALL SELECT 'event_type', event_type, NULL FROM sparse
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), user_id FROM sparse),
base AS (SELECT column_name, count(*) AS count, count(*) - count(v) AS missing, count(DISTINCT v) AS distinct_values, median(x) AS median
         FROM long GROUP BY 1),
r AS (SELECT column_name, x, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY column_name) AS n
      FROM long WHERE x IS NOT NULL WINDOW w AS (PARTITION BY column_name ORDER BY x)),
q AS (SELECT column_name, max(x) FILTER (k = floor(n * 0.25)) AS q1, max(x) FILTER (k = floor(n * 0.9)) AS p90 FROM r GROUP BY 1),
c AS (SELECT column_name, v, count(*) AS n FROM long WHERE v IS NOT NULL AND column_name <> 'value' GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS place FROM c),
tops AS (SELECT column_name, string_agg(v || ':' || n, ' ' ORDER BY place) AS tops FROM t WHERE place <= 3 GROUP BY 1),
answer AS (SELECT base.*, q1, p90, tops FROM base LEFT JOIN q USING (column_name) LEFT JOIN tops USING (column_name))""")
def shared_profile(spark, d):
    """Three columns profiled from one table of value counts."""
    rows = profile.shared_profile(sparse(spark, d), ["value", "event_type", "user_id"], top=3)
    tops = F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit(":"), t["count"].cast("string"))), " ")
    rows = rows.withColumn("tops", F.when(F.col("column") != "value", tops))
    return rows.withColumnsRenamed({"column": "column_name", "distinct": "distinct_values"})


@case("profile_quantiles", "A4", "l_returnflag q1~ q3~ p10~ p90~ median~", RANKED + """,
answer AS (
  SELECT l_returnflag, max(v) FILTER (k = floor(n * 0.25)) AS q1, max(v) FILTER (k = floor(n * 0.75)) AS q3,
         max(v) FILTER (k = floor(n * 0.1)) AS p10, max(v) FILTER (k = floor(n * 0.9)) AS p90,
         median(v) AS median FROM r GROUP BY 1)""")
def profile_quantiles(spark, d):
    return profile.quantiles(table(spark, d, "lineitem"), "l_extendedprice", BY)


@case("profile_outliers", "A5", "event_type outliers#", """
m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1),
answer AS (SELECT event_type, count(*) FILTER (abs(value - mean) > 3 * std) AS outliers
           FROM events JOIN m USING (event_type) GROUP BY 1)""")
def profile_outliers(spark, d):
    return profile.outlier_count(events(spark, d), "value", ["event_type"])


@case("profile_histogram", "A6", "event_type bin# count# height~", """
m AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM events GROUP BY 1),
c AS (SELECT event_type, CAST(least(floor((value - lo) / w), 11) AS BIGINT) AS bin, count(*) AS count
      FROM events JOIN m USING (event_type) WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT event_type, unnest(range(12)) AS bin FROM m),
answer AS (SELECT g.event_type, g.bin, coalesce(count, 0) AS count,
                  coalesce(count, 0) / max(count) OVER (PARTITION BY g.event_type) AS height
           FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.bin = g.bin)""")
def profile_histogram(spark, d):
    return profile.histogram(events(spark, d), "value", ["event_type"])


@case("text_profile", "A7", "min_length# max_length# empty_strings# balance_ratio~", """
c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1),
answer AS (SELECT min(length(v)) AS min_length, max(length(v)) AS max_length,
                  coalesce(sum(n) FILTER (trim(v) = ''), 0) AS empty_strings, max(n) / min(n) AS balance_ratio FROM c)""")
def text_profile(spark, d):
    return profile.text_profile(part(spark, d), "p_name")


@case("top_values", "A7", "rank# value count# share~", """
c AS (SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1),
answer AS (SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count,
                  count / (SELECT sum(count) FROM c) AS share FROM c
           QUALIFY rank <= 10)""")
def top_values(spark, d):
    return profile.top_values(part(spark, d), "p_name")


@case("covariance_matrix", "A15", "l_returnflag left_name right_name mean_left~ covariance~", """
answer AS (
  SELECT l_returnflag, 'l_quantity' AS left_name, 'l_quantity' AS right_name, avg(l_quantity) AS mean_left,
         var_samp(l_quantity) AS covariance FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'l_quantity', 'l_tax', avg(l_quantity), covar_samp(l_quantity, l_tax) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'l_tax', 'l_tax', avg(l_tax), var_samp(l_tax) FROM lineitem GROUP BY 1)""")
def covariance_matrix(spark, d):
    rows = profile.covariance_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], BY)
    return rows.withColumnsRenamed({"left": "left_name", "right": "right_name"})
