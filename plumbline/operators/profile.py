"""Column profiles and summary statistics."""

from __future__ import annotations

from collections.abc import Callable
from collections.abc import Sequence as Listing

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.chart import measurements
from plumbline.operators.prep import is_missing, numeric
from plumbline.operators.series import (
    Roles,
    attach_row,
    join_keys,
    largest_group,
    medians_of,
    order_statistics,
    ranked_counts,
)
from plumbline.session import block_rows, durable

ALL = "_all"
BINS = 12


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, max, median, missing."""
    rows = df.select(F.lit("all").alias(ALL), F.col(column).cast("double").alias("v"))
    stats = rows.groupBy(ALL).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.count_if(F.col("v").isNull()).alias("missing"),
    )
    return attach_row(stats, medians_of(rows, [ALL], "v", "median").drop(ALL)).drop(ALL)


def frequencies(df: DataFrame, columns: Listing[str]) -> DataFrame:
    """column, value (as text; null if missing or empty) and count, of all columns in one scan.

    Rows are unpivoted into pairs of column and value, which are counted on both sides
    of one shuffle.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), F.col(c).cast("string")).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def profile_base(df: DataFrame, columns: Listing[str], *, approximate: bool = False) -> DataFrame:
    """One row per column: count, missing (null or empty), missing_pct, distinct.

    All columns share one scan.  ``approximate`` estimates distinct values by sketches.
    """
    if approximate:
        entries = [
            F.struct(
                F.lit(name).alias("column"), F.count(F.lit(1)).alias("count"), F.count_if(is_missing(df, name)).alias("missing"),
                F.approx_count_distinct(F.when(~is_missing(df, name), F.col(name).cast("string"))).alias("distinct"),
            )
            for name in columns
        ]
        return _with_share(df.agg(F.array(*entries).alias("_columns")).select(F.inline("_columns")))
    return _with_share(_base_of(frequencies(df, columns), columns))


def _base_of(counts: DataFrame, columns: Listing[str]) -> DataFrame:
    found = counts.groupBy("column").agg(
        F.sum("count").alias("count"),
        F.sum(F.when(F.col("value").isNull(), F.col("count"))).alias("missing"),
        F.count("value").alias("distinct"),
    )
    names = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(found, "column", "left").na.fill(0, ["count", "missing", "distinct"])


def _with_share(base: DataFrame) -> DataFrame:
    share = F.when(F.col("count") > 0, F.col("missing") / F.col("count") * 100.0).otherwise(0.0)
    return base.withColumn("missing_pct", share)


def shared_profile(df: DataFrame, columns: Listing[str], *, top: int = 10) -> DataFrame:
    """One row per column from one table of value counts: base figures, quantiles, the ``top`` values.

    Quantiles are those of the values that are numbers, null where none is.  ``top_values``
    lists value and count, the most frequent first, ties by value.
    """
    counts = durable(frequencies(df, columns))
    present = counts.where(F.col("value").isNotNull())
    parsed = present.select("column", numeric(F.col("value")).alias("_v"), "count").where(F.col("_v").isNotNull())
    parsed = parsed.groupBy("column", "_v").agg(F.sum("count").alias("_n"))
    size = block_rows(df.sparkSession)
    blocked = largest_group(present.select("column"), ["column"]) > size
    found = ranked_counts(parsed, ["column"], _ranks(), blocked=blocked, block_rows=size)
    found = found.withColumn("median", (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")
    place = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    best = present.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= top)
    listed_ = F.sort_array(F.collect_list(F.struct("_rank", "value", "count")))
    best = best.groupBy("column").agg(F.transform(listed_, lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))
    return _with_share(_base_of(counts, columns)).join(found, "column", "left").join(best, "column", "left")


def _beside(rows: DataFrame, small: DataFrame, by: Listing[str]) -> DataFrame:
    """Per-group figures on every row; without groups they are one row."""
    if not by:
        return attach_row(rows, small.drop(ALL))
    return join_keys(rows, small.drop(ALL), list(by))


def numbers(df: DataFrame, column: str, by: Listing[str] = ()) -> DataFrame:
    rows = df.select(F.lit("all").alias(ALL), *by, numeric(F.col(column)).alias("v"))
    return rows.where(F.col("v").isNotNull())


def numeric_moments(df: DataFrame, column: str, by: Listing[str] = ()) -> DataFrame:
    """mean, population std, min, max, skewness, excess kurtosis, cv %."""
    std, mean = F.stddev_pop("v"), F.avg("v")
    return (
        numbers(df, column, by)
        .groupBy(ALL, *by)
        .agg(
            F.count("v").alias("n"),
            mean.alias("mean"),
            std.alias("std"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.when(std > 0, F.skewness("v")).otherwise(0.0).alias("skewness"),
            F.when(std > 0, F.kurtosis("v")).otherwise(0.0).alias("kurtosis"),
        )
        .withColumn("cv", F.try_divide(F.col("std"), F.abs("mean")) * 100.0)
        .drop(ALL)
    )


# Rank of each quantile is floor(n * share).
QUANTILES = {"q1": 0.25, "q3": 0.75, "p10": 0.10, "p90": 0.90}


def _ranks() -> dict[str, Callable[[Column], Column]]:
    """0-based rank of each quantile among n values, and of the two in the middle."""
    ranks = {name: (lambda n, share=share: F.floor(n * share)) for name, share in QUANTILES.items()}
    return {**ranks, "_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)}


def quantiles(df: DataFrame, column: str, by: Listing[str] = ()) -> DataFrame:
    """q1, q3, p10, p90 at rank floor(n * share); the median averages the middle two."""
    table = order_statistics(numbers(df, column, by), [ALL, *by], "v", _ranks())
    return table.withColumn("median", (F.col("_lo") + F.col("_hi")) / 2.0).drop(ALL, "_lo", "_hi")


def outlier_count(df: DataFrame, column: str, by: Listing[str] = ()) -> DataFrame:
    """Values farther than 3 population standard deviations from the mean."""
    rows = numbers(df, column, by)
    keys = [ALL, *by]
    moments = rows.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    far = F.abs(F.col("v") - F.col("_m")) > 3.0 * F.col("_s")
    return (
        _beside(rows, moments, by).groupBy(*keys).agg(F.count_if(far).alias("outliers"))
    ).drop(ALL)


def histogram(df: DataFrame, column: str, by: Listing[str] = (), *, bins: int = BINS) -> DataFrame:
    """Equal-width counts, empty bins included, and their share of the fullest bin."""
    rows = numbers(df, column, by)
    keys = [ALL, *by]
    ends = rows.groupBy(*keys).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    span = F.col("_high") - F.col("_low")
    ends = ends.withColumn("_width", F.when(span == 0, 1.0).otherwise(span) / bins)
    at = F.least(F.floor((F.col("v") - F.col("_low")) / F.col("_width")), F.lit(bins - 1))
    counted = (
        _beside(rows, ends, by).groupBy(*keys, at.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # one array per key instead of one row per bin: bins are few and fixed
    wide = counted.groupBy(*keys).agg(
        F.max("count").alias("_top"),
        *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("count"))), F.lit(0)).alias(f"_b{i}")
          for i in range(bins)],
    )
    return wide.select(
        *by,
        "_top",
        F.posexplode(F.array(*[f"_b{i}" for i in range(bins)])).alias("bin", "count"),
    ).select(*by, "bin", "count", (F.col("count") / F.col("_top")).alias("height"))


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """Lengths, blank strings and the balance of frequencies, from counts per value."""
    counts = value_counts(df, column)
    size = F.length("value")
    return counts.agg(
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.coalesce(
            F.sum(F.when(F.trim("value") == "", F.col("count"))), F.lit(0)
        ).alias("empty_strings"),
        (F.max("count") / F.min("count")).alias("balance_ratio"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("string")
    return (
        df.where(~is_missing(df, column)).groupBy(c.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with rank and share; ties go by value."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count")).scalar()
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    # at most k rows from here on
    best = F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "value"))),
        lambda s, i: F.struct(
            (i + 1).cast("long").alias("rank"), s["value"].alias("value"), (-s["c"]).alias("count")
        ),
    )
    return (
        top.agg(best.alias("_top"))
        .select(F.inline("_top"))
        .withColumn("share", F.col("count") / total)
    )


def normality(skewness: Column, kurtosis: Column) -> Column:
    """normal, mild or non-normal from the size of skewness and excess kurtosis."""
    s, k = F.abs(skewness), F.abs(kurtosis)
    return (
        F.when((s < 0.5) & (k < 1.0), "normal").when((s < 1.0) & (k < 2.0), "mild")
        .otherwise("non-normal")
    )


def summary_statistics(df: DataFrame, roles: Roles) -> DataFrame:
    """n, mean, sample std, min, max, median and number of subgroups per series."""
    rows = measurements(df, roles)
    label = F.col("subgroup").cast("string") if roles.subgroup else F.lit(None).cast("string")
    stats = rows.groupBy(*roles.keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_distinct(F.nullif(label, F.lit(""))).alias("subgroup_count"),
    )
    return join_keys(stats, medians_of(rows, roles.keys, "value", "median"), roles.keys)


def covariance_matrix(df: DataFrame, columns: Listing[str], by: Listing[str] = ()) -> DataFrame:
    """Mean vector and sample covariances, long form: (i, j, covariance), i <= j."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    v = [F.col(c).cast("double") for c in columns]
    entries = [
        F.struct(
            F.lit(columns[i]).alias("left"),
            F.lit(columns[j]).alias("right"),
            F.avg(v[i]).alias("mean_left"),
            F.covar_samp(v[i], v[j]).alias("covariance"),
        )
        for i, j in pairs
    ]
    rows = df.dropna(subset=list(columns))
    return rows.groupBy(*by).agg(F.array(*entries).alias("_m")).select(*by, F.inline("_m"))
