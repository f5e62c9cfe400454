"""Reading, profiling and writing measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.prep import numeric, trimmed
from plumbline.operators.series import IDX, listed, sequence

MAX_COLUMNS = 10_000
MAJORITY = 0.8

# Date shapes that count as a datetime, and names that suggest a role.
DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$",
)
ROLE_NAMES = {
    "value": (
        "thickness", "value", "measurement", "result", "reading", "weight", "length", "width",
        "height", "diameter", "temperature", "pressure", "concentration",
    ),
    "subgroup": (
        "hour", "subgroup", "batch", "sample", "group", "lot", "shift", "operator", "machine",
        "cavity", "stream",
    ),
    "phase": ("phase", "period", "stage", "run"),
    "label": ("label", "id", "name", "serial", "part"),
}


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header; every cell stays text.  Empty files are errors.

    ``multi_line`` allows line breaks inside quotes; such files cannot be split
    between tasks.
    """
    options = {"header": True, "inferSchema": False, "multiLine": multi_line, "escape": '"'}
    df = spark.read.options(**options).csv(path)
    if not df.columns:
        raise ValueError("the file has no header")
    first = df.columns[0]
    if first.startswith("\ufeff"):
        df = df.withColumnRenamed(first, first.lstrip("\ufeff"))
    if df.isEmpty():
        raise ValueError("the file has no rows")
    return df


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def column_types(
    df: DataFrame, order: str | list[str] | None = None, sample: int | None = None
) -> DataFrame:
    """(name, ordinal, dtype) from all rows: numeric, datetime or text.

    ``sample`` looks at that many first rows only; ``order`` says what "first" means,
    and without it the reader's order is taken.
    """
    looked_at = df
    if sample is not None:
        looked_at = (df.orderBy(*listed(order)) if order else df).limit(sample)
    entries = []
    for ordinal, name in enumerate(df.columns):
        text = trimmed(F.col(name).cast("string"))
        present = text.isNotNull() & (text != "")
        number = present & numeric(text).isNotNull()
        date = F.lit(False)
        for shape in DATE_SHAPES:
            date = date | text.rlike(shape)
        entries.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(ordinal).cast("long").alias("ordinal"),
                F.count_if(present).alias("present"),
                F.count_if(number).alias("numbers"),
                F.count_if(present & ~number & date).alias("dates"),
            )
        )
    counts = looked_at.agg(F.array(*entries).alias("_c")).select(F.inline("_c"))
    dtype = (
        F.when(F.col("present") == 0, "text")
        .when(F.col("numbers") / F.col("present") > MAJORITY, "numeric")
        .when(F.col("dates") / F.col("present") > MAJORITY, "datetime")
        .otherwise("text")
    )
    return counts.select("name", "ordinal", dtype.alias("dtype"))


def schema_profile(
    df: DataFrame, order: str | list[str] | None = None, sample: int | None = None
) -> DataFrame:
    """Types with suggested roles; at most one value, by name or the first numeric column."""
    lower = F.lower(F.trim("name"))
    named = F.lit(None).cast("string")
    for role, names in ROLE_NAMES.items():
        named = F.when(lower.isin(list(names)), role).otherwise(named)
    table = column_types(df, order, sample).withColumn("_named", named)
    # one row per column of a table: a single small partition
    everything = Window.partitionBy(F.lit(1))
    first_value = F.min(F.when(F.col("_named") == "value", F.col("ordinal"))).over(everything)
    first_number = F.min(F.when(F.col("dtype") == "numeric", F.col("ordinal"))).over(everything)
    chosen = F.coalesce(first_value, first_number)
    role = F.when(F.col("ordinal") == chosen, "value").when(
        F.col("_named") != "value", F.col("_named")
    )
    return table.select("name", "ordinal", "dtype", role.alias("role"))


def typed_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Numeric columns as numbers (null where empty or unparsable), the rest as text."""
    return df.select(
        *[
            (numeric(F.nullif(F.col(c).cast("string"), F.lit(""))) if types.get(c) == "numeric"
             else F.col(c).cast("string")).alias(c)
            for c in df.columns
        ]
    )


def ingest_rows(df: DataFrame, order: str | list[str], dataset: str, **sizing) -> DataFrame:
    """Number the rows of a dataset and keep each as one JSON document."""
    document = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]),
                         {"ignoreNullFields": "false"})
    rows = df.select(F.lit(dataset).alias("dataset_id"), *listed(order), document.alias("raw_json"))
    seq = sequence(rows, ["dataset_id"], order, **sizing)
    return seq.df.select("dataset_id", F.col(IDX).alias("sequence_index"), "raw_json")


def document_fields(raw: str | Column, fields: list[str]) -> list[Column]:
    """Fields of a JSON document as text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    table = F.from_json(raw, "map<string,string>")
    return [F.try_element_at(table, F.lit(f)).alias(f) for f in fields]


def extract_measurements(
    df: DataFrame, raw: str, value: str, subgroup: str | None = None, *, missing: str = "drop"
) -> DataFrame:
    """value (number) and subgroup (text) out of JSON documents."""
    rows = df.withColumn("_fields", F.from_json(raw, "map<string,string>"))
    number = F.try_element_at("_fields", F.lit(value)).try_cast("double")
    out = rows.withColumns(
        {
            "value": F.coalesce(number, F.lit(0.0)) if missing == "zero" else number,
            "subgroup": F.try_element_at("_fields", F.lit(subgroup)) if subgroup
            else F.lit(None).cast("string"),
        }
    ).drop("_fields")
    return out if missing == "zero" else out.where(F.col("value").isNotNull())


def ordered_rows(df: DataFrame, order: str | list[str]) -> DataFrame:
    return df.orderBy(*listed(order))


def dataset_list(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """Datasets with their number of rows, newest first.

    Rows are counted per dataset before the join.
    """
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("point_count"))
    return (
        datasets.join(counts, "dataset_id", "left")
        .na.fill(0, ["point_count"])
        .orderBy(F.desc("created_at"), "dataset_id")
    )


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """CSV with a header; nulls are empty, quotes doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def document_columns(df: DataFrame, raw: str, order: str) -> list[str]:
    """Union of the keys of all documents, in order of first appearance.

    They become columns, so they are few; more than MAX_COLUMNS is an error.
    """
    keys = F.posexplode(F.json_object_keys(raw))
    table = df.select(F.col(order).alias("_at"), keys.alias("_pos", "key"))
    first = table.groupBy("key").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    names = [r["key"] for r in first.orderBy("_first").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"the documents have more than {MAX_COLUMNS} distinct keys")
    return names


def document_table(df: DataFrame, raw: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """Documents as a flat text table, one column per key."""
    columns = columns or document_columns(df, raw, order)
    return df.select(order, *document_fields(raw, columns))


def save_analysis(
    params: DataFrame, path: str, dataset: str, created_at: str, *, mode: str = "append"
) -> None:
    """Append an analysis, partitioned by dataset."""
    stamped = params.withColumns(
        {"dataset_id": F.lit(dataset), "created_at": F.lit(created_at).cast("timestamp")}
    )
    stamped.write.mode(mode).partitionBy("dataset_id").parquet(path)


def latest_analysis(
    analyses: DataFrame, dataset: str = "dataset_id", created_at: str = "created_at"
) -> DataFrame:
    """The rows of each dataset's latest analysis.

    The latest time per dataset is aggregated first; no dataset is sorted.
    """
    latest = analyses.groupBy(F.col(dataset).alias("_d")).agg(F.max(created_at).alias("_t"))
    same = (F.col(dataset) == F.col("_d")) & (F.col(created_at) == F.col("_t"))
    return analyses.join(latest, same, "left_semi")


def save_table(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A cleaned table as a dataset of its own, with its types."""
    df.write.mode(mode).parquet(path)


def chart_points(
    df: DataFrame,
    index: str,
    value: str,
    *,
    subgroup: str | None = None,
    label: str | None = None,
    phase: str | None = None,
) -> DataFrame:
    """Rows as charted points by role: missing values are 0, names default to pt-i."""
    name = F.concat(F.lit("pt-"), F.col(index).cast("string"))

    def text(column: str | None, default: Column) -> Column:
        return default if column is None else F.coalesce(F.col(column).cast("string"), default)

    return df.select(
        name.alias("id"),
        text(label, name).alias("label"),
        text(subgroup, name).alias("subgroup_label"),
        text(phase, F.lit(None).cast("string")).alias("phase_id"),
        F.coalesce(numeric(F.col(value)), F.lit(0.0)).alias("value"),
        F.lit(False).alias("excluded"),
    )
