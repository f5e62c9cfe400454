"""Row and column operators that prepare a measurement table.

Each takes a DataFrame first and returns a DataFrame, so they chain with
``df.transform``.  Operators that depend on row order take the order columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from collections.abc import Sequence as Listing

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import calculated
from plumbline.operators.series import IDX, listed, medians_of, sequence

# Up to this many rows a page is served by a top-k; deeper pages use row positions.
TOP_ROWS = 100_000


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _check_columns(df: DataFrame, columns: Listing[str]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or an empty string."""
    c = F.col(column)
    return c.isNull() | (c == "") if _types(df)[column] == "string" else c.isNull()


# -- rows ---------------------------------------------------------------------
def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """eq, neq, gt, lt, gte, lte, contains, not_contains, between, is_null, is_not_null.

    Values are compared as the column's own type: numbers as doubles, dates, timestamps
    and booleans as such (text such as "2023-01-01" is cast).  Ordered comparisons of a
    text column read its texts as numbers.  Nulls never pass a comparison, but pass neq
    and not_contains.
    """
    _check_columns(df, [column])
    c, kind = F.col(column), _types(df)[column]
    text, own = kind == "string", kind in ("boolean", "date") or kind.startswith("timestamp")
    number = c.try_cast("double") if text else c

    def compared(v) -> Column:
        return F.lit(v).cast(kind) if own else F.lit(float(v))

    if operator in ("eq", "neq"):
        same = c.eqNullSafe(F.lit(value) if text else compared(value))
        return df.where(same if operator == "eq" else ~same)
    if operator == "gt":
        return df.where(number > compared(value))
    if operator == "lt":
        return df.where(number < compared(value))
    if operator == "gte":
        return df.where(number >= compared(value))
    if operator == "lte":
        return df.where(number <= compared(value))
    if operator == "between":
        low, high = value
        return df.where(number.between(compared(low), compared(high)))
    if operator == "contains":
        return df.where(c.cast("string").contains(value))
    if operator == "not_contains":
        return df.where(c.isNull() | ~c.cast("string").contains(value))
    if operator == "is_null":
        return df.where(is_missing(df, column))
    if operator == "is_not_null":
        return df.where(~is_missing(df, column))
    raise ValueError(f"unknown filter operator {operator!r}")


def sort_rows(df: DataFrame, by: Listing[tuple[str, str]]) -> DataFrame:
    """Sort by (column, "asc" | "desc") pairs, nulls last."""
    if not by:
        return df
    _check_columns(df, [c for c, _ in by])
    return df.orderBy(
        *[
            F.desc_nulls_last(c) if direction == "desc" else F.asc_nulls_last(c)
            for c, direction in by
        ]
    )


def remove_duplicates(df: DataFrame, keys: Listing[str], order: str | Listing[str]) -> DataFrame:
    """The first row of each key in the given order, which must be unique within a key.

    Only keys and order are reduced, by ``min`` on both sides of the shuffle, so a key
    that holds much of the table moves one small row per task, and columns of any type
    may stand beside them.  The whole rows meet the first ones in a semi-join.
    """
    order = listed(order)
    _check_columns(df, [*keys, *order])
    names = {c: f"_k{i}" for i, c in enumerate(dict.fromkeys([*keys, *order]))}
    first = df.groupBy(*[F.col(c).alias(names[c]) for c in keys]).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.withColumns({names[c]: F.col(f"_first.{c}") for c in order if c not in keys}).drop("_first")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.join(first, same, "left_semi")


def page(df: DataFrame, order: str | Listing[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset .. offset + limit in the given order."""
    order = listed(order)
    if offset + limit <= TOP_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    seq = sequence(df.withColumn("_all", F.lit("all")), "_all", order)
    inside = F.col(IDX).between(offset, offset + limit - 1)
    return seq.df.where(inside).select(*df.columns).orderBy(*order)


# -- missing values -------------------------------------------------------------
def handle_missing(
    df: DataFrame,
    column: str,
    strategy: str,
    value=None,
    *,
    order: str | Listing[str] | None = None,
    within: str | Listing[str] = (),
    **sizing,
) -> DataFrame:
    """remove, fill_mean, fill_median, fill_zero, fill_custom, fill_down, fill_up.

    Means and medians are those of the whole column.  fill_down and fill_up also
    treat empty strings as missing and need ``order`` (``within`` keeps fills inside
    groups).
    """
    _check_columns(df, [column])
    c = F.col(column)
    if strategy == "remove":
        return df.where(~is_missing(df, column))
    if strategy in ("fill_mean", "fill_median"):
        if strategy == "fill_mean":
            fill = df.agg(F.avg(c))
        else:
            whole = df.select(F.lit("all").alias("_all"), c.cast("double").alias(column))
            fill = medians_of(whole, ["_all"], column, "median").select("median")
        return df.withColumn(column, F.coalesce(c.cast("double"), fill.scalar()))
    if strategy in ("fill_zero", "fill_custom"):
        fill = F.lit(0 if strategy == "fill_zero" else value).cast(_types(df)[column])
        return df.withColumn(column, F.coalesce(c, fill))
    if strategy in ("fill_down", "fill_up"):
        if not order:
            raise ValueError(f"{strategy} needs order columns")
        keys = listed(within) or ["_all"]
        rows = df if within else df.withColumn("_all", F.lit("all"))
        seq = sequence(rows, keys, listed(order), **sizing)
        known = F.when(~is_missing(df, column), c)
        fill = seq.last_known if strategy == "fill_down" else seq.next_known
        return fill(**{column: known}).df.select(*df.columns)
    raise ValueError(f"unknown strategy {strategy!r}")


# -- text -----------------------------------------------------------------------
def replaced(column: Column, find: str, replacement: str, regex: bool) -> Column:
    """Literal: the first occurrence.  Regex: every occurrence, $1 and $& allowed."""
    text = column.cast("string")
    if regex:
        java = replacement.replace("\\", "\\\\").replace("$&", "$0")
        return F.regexp_replace(text, F.lit(find), F.lit(java))
    at = F.instr(text, F.lit(find))
    return F.when(
        at > 0, F.overlay(text, F.lit(replacement), at, F.lit(len(find)))
    ).otherwise(text)


def find_replace(
    df: DataFrame, column: str, find: str, replacement: str, regex: bool = False
) -> DataFrame:
    """Replace in one column, or in every column with ``column="__all__"``."""
    columns = df.columns if column == "__all__" else [column]
    _check_columns(df, columns)
    return df.withColumns({c: replaced(F.col(c), find, replacement, regex) for c in columns})


# The white space that trimming removes.
SPACE = (
    " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def titled(text: Column) -> Column:
    """Lower case, then the first character of every run of ASCII word characters upper-cased."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))

    def headed(part: Column) -> Column:
        upper = F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))
        return F.when(part.rlike("^[A-Za-z0-9_]"), upper).otherwise(part)

    return F.array_join(F.transform(parts, headed), "")


CLEANERS = {"trim": trimmed, "lower": F.lower, "upper": F.upper, "title": titled}


def clean_text(df: DataFrame, column: str, operation: str = "trim") -> DataFrame:
    if operation not in CLEANERS:
        raise ValueError(f"unknown clean operation {operation!r}")
    _check_columns(df, [column])
    return df.withColumn(column, CLEANERS[operation](F.col(column).cast("string")))


def trim_columns(df: DataFrame, columns: Listing[str] | None = None) -> DataFrame:
    """Trim the given columns, by default every text column."""
    if columns is None:
        columns = [c for c, t in df.dtypes if t == "string"]
    _check_columns(df, columns)
    return df.withColumns({c: trimmed(F.col(c).cast("string")) for c in columns})


# -- columns ----------------------------------------------------------------------
def reorder_columns(df: DataFrame, order: Listing[str]) -> DataFrame:
    _check_columns(df, order)
    return df.select(*order, *[c for c in df.columns if c not in order])


def select_columns(df: DataFrame, columns: Listing[str]) -> DataFrame:
    _check_columns(df, columns)
    return df.select(*columns)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _check_columns(df, [old])
    return df.withColumnRenamed(old, new)


def change_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """numeric or text; what does not convert becomes null."""
    _check_columns(df, [column])
    c = F.col(column)
    if target == "numeric":
        return df.withColumn(column, numeric(c))
    if target == "text":
        return df.withColumn(column, c.cast("string"))
    raise ValueError(f"unknown target type {target!r}")


def numeric(column: Column) -> Column:
    """A number, or null; not-a-number is null too."""
    return F.nullif(column.try_cast("double"), F.lit(float("nan")))


def preview_conversion(df: DataFrame, column: str, target: str) -> DataFrame:
    """How many of the present values convert."""
    _check_columns(df, [column])
    c = F.col(column)
    if target == "numeric":
        good = F.count_if(numeric(c).isNotNull())
    elif target == "text":
        good = F.count(c)
    else:
        raise ValueError(f"unknown target type {target!r}")
    return df.agg(good.alias("convertible"), F.count(c).alias("total"))


def calculated_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, calculated(expression, df.columns))


def recode(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str] | DataFrame,
    new_column: str | None = None,
) -> DataFrame:
    """Replace values by a mapping; what is not in it stays, what maps to None becomes null.

    A mapping of any size may come as a table (from, to); of rows that repeat ``from``
    the smallest ``to`` counts.
    """
    _check_columns(df, [column])
    target = new_column or column
    text = F.col(column).cast("string")
    if not isinstance(mapping, DataFrame):
        if not mapping:
            return df.withColumn(target, F.col(column))
        pairs = [(str(k), None if v is None else str(v)) for k, v in mapping.items()]
        mapping = df.sparkSession.createDataFrame(pairs, "`from` string, `to` string")
    table = mapping.where(F.col("from").isNotNull()).groupBy(F.col("from").alias("_from")).agg(F.min("to").alias("_to"))
    joined = df.join(table, text == F.col("_from"), "left")
    hit = F.when(F.col("_from").isNotNull(), F.col("_to")).otherwise(text)
    return joined.withColumn(target, hit).drop("_from", "_to")


def bin_column(
    df: DataFrame,
    column: str,
    bins: int = 5,
    new_column: str = "bin",
    breaks: Listing[float] | None = None,
) -> DataFrame:
    """bin_1 .. bin_k, right-closed; equal width unless breaks are given."""
    _check_columns(df, [column])
    c = F.col(column)
    if breaks is None:
        if bins < 1:
            raise ValueError(f"bins must be positive, got {bins}")
        ends = df.agg(
            F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
        ).scalar()
        low, width = ends["low"], (ends["high"] - ends["low"]) / bins
        # break points are rounded to six digits, half up
        breaks = [F.round(low + width * i, 6) for i in range(1, bins)]
    label = F.lit(f"bin_{len(breaks) + 1}")
    for i, upper in reversed(list(enumerate(breaks, start=1))):
        label = F.when(c <= upper, f"bin_{i}").otherwise(label)
    return df.withColumn(new_column, F.when(c.isNotNull(), label))


def split_column(df: DataFrame, column: str, delimiter: str, parts: int = 2) -> DataFrame:
    """column_1 .. column_k, trimmed; surplus parts are dropped."""
    _check_columns(df, [column])
    if not delimiter:
        raise ValueError("delimiter must not be empty")
    pieces = F.split(F.col(column).cast("string"), java_quote(delimiter))
    return df.withColumns(
        {f"{column}_{i + 1}": trimmed(F.get(pieces, i)) for i in range(parts)}
    )


def java_quote(literal: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)


def concat_columns(
    df: DataFrame, columns: Listing[str], separator: str, new_column: str
) -> DataFrame:
    """Join values as text, nulls as empty strings."""
    _check_columns(df, columns)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn(new_column, F.concat_ws(separator, *texts))


# -- validation ---------------------------------------------------------------------
def invalid(column: str, rule: Mapping) -> Column:
    """True where a present value breaks the rule (range, allowed, regex)."""
    c = F.col(column)
    kind = rule.get("type")
    if kind == "range":
        number = numeric(c)
        broken = number.isNull()
        if rule.get("min") is not None:
            broken = broken | (number < float(rule["min"]))
        if rule.get("max") is not None:
            broken = broken | (number > float(rule["max"]))
    elif kind == "allowed":
        broken = ~c.cast("string").isin([str(v) for v in rule["values"]])
    elif kind == "regex":
        try:
            re.compile(rule["pattern"])
            broken = ~c.cast("string").rlike(rule["pattern"])
        except re.error:
            broken = F.lit(True)
    else:
        raise ValueError(f"unknown validation rule {kind!r}")
    return c.isNotNull() & broken


def validate_column(df: DataFrame, column: str, rule: Mapping) -> DataFrame:
    """The rows whose value breaks the rule."""
    _check_columns(df, [column])
    return df.where(invalid(column, rule))


def validate_all(
    df: DataFrame, rules: Mapping[str, Mapping], order: str | Listing[str]
) -> DataFrame:
    """(column, order) of every broken value, found in one pass."""
    order = listed(order)
    _check_columns(df, [*rules, *order])
    broken = F.array_compact(
        F.array(*[F.when(invalid(c, r), F.lit(c)) for c, r in rules.items()])
    )
    return df.select(*order, F.explode(broken).alias("column"))


def mark_excluded(df: DataFrame, excluded: DataFrame, on: str | Listing[str]) -> DataFrame:
    """An ``excluded`` flag from a table of excluded rows."""
    on = listed(on)
    marks = excluded.select(*on).distinct().withColumn("_marked", F.lit(True))
    return (
        df.join(marks, on, "left")
        .withColumn("excluded", F.coalesce("_marked", F.lit(False)))
        .drop("_marked")
    )
