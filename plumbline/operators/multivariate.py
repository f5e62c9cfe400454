"""Multivariate charts: Hotelling T-squared and MEWMA.

Mean vector and covariances are grouped aggregations; for long vectors the products
are summed as matrices in tasks.  The inverse and the quantiles are computed once per
key.  The statistic is a column expression, or for long vectors a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Listing

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import chi2_quantile, f_quantile_of
from plumbline.operators.chart import EXCLUDED, Chart, excluded_flag, order_of, positive, zone_lines
from plumbline.operators.series import IDX, PHASE, Roles, Sequence, join_keys, phase_column, sequence
from plumbline.operators.time_weighted import grown_share
from plumbline.session import durable

#: Vectors up to this length stay column expressions; longer ones go through matrices in tasks.
UNROLLED = 10
#: Rows of one key whose statistics one task computes together, and matrices it holds at a time.
WIDE_ROWS = 50_000
HELD_CELLS = 8_000_000


def variables(
    df: DataFrame, roles: Roles, columns: Listing[str] | str, size: int | None = None, **sizing
) -> tuple[Sequence, int]:
    """Numbered rows with the vector as columns ``v0 .. v(p-1)``; incomplete rows are dropped.

    ``columns`` is a list of numeric columns, or one array column with ``size`` elements used.
    """
    if isinstance(columns, str):
        if not size:
            raise ValueError("size is needed for an array column")
        vector = [F.get(F.col(columns), i).cast("double") for i in range(size)]
    else:
        vector = [F.col(c).cast("double") for c in columns]
    p = len(vector)
    if p < 2:
        raise ValueError("a multivariate chart needs at least two variables")
    rows = df.select(
        *roles.series_columns,
        phase_column(df, roles.phase).alias(PHASE),
        *([excluded_flag(roles).alias(EXCLUDED)] if roles.excluded else []),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(roles.order_columns)],
        *[c.alias(f"v{i}") for i, c in enumerate(vector)],
    )
    # one condition per variable: the optimizer doubles a joint one for each of them
    for i in range(p):
        rows = rows.where(F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}"))
    return sequence(rows, roles.keys, order_of(roles), single=roles.single, **sizing), p


def moments(
    seq: Sequence,
    p: int,
    known_mean: Listing[float] | None = None,
    known_cov: Listing[Listing[float]] | None = None,
) -> DataFrame:
    """n, mean vector and covariance matrix (row by row) of the rows that are not excluded, and its inverse, per key."""
    some = ~F.col(EXCLUDED) if EXCLUDED in seq.held.columns else F.lit(True)
    used = [F.when(some, F.col(f"v{i}")) for i in range(p)]
    aggregates = [
        F.count_if(some).alias("n"), F.max(IDX).alias("_last"), F.array(*[F.avg(v) for v in used]).alias("mean_vector"),
    ]
    if known_cov is not None or p > UNROLLED:
        table = seq.df.groupBy(*seq.keys).agg(*aggregates)
    else:
        # upper triangle only
        upper = [F.covar_samp(used[i], used[j]).alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)]
        full = F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
        table = seq.df.groupBy(*seq.keys).agg(*aggregates, *upper)
        table = table.select(*seq.keys, "n", "_last", "mean_vector", full.alias("covariance"))
    if known_cov is not None:
        flat = [float(v) for row in known_cov for v in row]
        table = table.withColumn("covariance", F.array(*[F.lit(v) for v in flat]))
    elif p > UNROLLED:
        # one row per key, read in several places: written once
        table = durable(table)
        table = join_keys(table, gram(seq, table, some, p), seq.keys)
        table = table.withColumn("covariance", F.transform("_gram", lambda v: F.try_divide(v, F.col("n") - 1.0))).drop("_gram")
    if known_mean is not None:
        table = table.withColumn("mean_vector", F.array(*[F.lit(float(v)) for v in known_mean]))
    # as many observations as variables, or fewer, do not determine the inverse
    enough = F.col("n") > p if known_cov is None else F.lit(True)
    table = table.withColumn("inverse", F.when(enough, _inverse(p)(F.col("covariance"))))
    return durable(table) if p > UNROLLED else table


def gram(seq: Sequence, means: DataFrame, some: Column, p: int) -> DataFrame:
    """Sums of products of deviations from the mean, as one flat matrix per key.

    Every task adds up one matrix per key it meets; the cells of these partial matrices
    are summed by (key, cell) and put together again.
    """
    keys = seq.keys
    vector = F.array(*[F.col(f"v{i}") for i in range(p)])
    deviations = F.zip_with(vector, F.col("mean_vector"), lambda v, m: v - m)
    rows = seq.beside(means.select(*keys, "_last", "mean_vector")).df.where(some).select(*keys, deviations.alias("_d"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keys], T.StructField("_part", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        names: dict[tuple, pa.Table] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, matrix in held.items():
                cells = pa.ListArray.from_arrays(pa.array([0, p * p], pa.int32()), pa.array(matrix.ravel()))
                yield from names[key].append_column("_part", cells).to_batches()
            held.clear()
            names.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            vectors = batch.column(batch.schema.get_field_index("_d")).flatten().to_numpy().reshape(-1, p)
            of_key = list(zip(*[table[k].to_pylist() for k in keys]))
            place: dict[tuple, int] = {}
            which = np.array([place.setdefault(k, len(place)) for k in of_key], np.int64)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(place) + 1))
            for key, a, b in zip(place, cuts, cuts[1:]):
                d = vectors[order[a:b]]
                if key not in held:
                    held[key], names[key] = np.zeros((p, p)), table.select(keys).slice(int(order[a]), 1).combine_chunks()
                held[key] += d.T @ d
            if len(held) * p * p > HELD_CELLS:
                yield from out()
        yield from out()

    cells = rows.mapInArrow(partial, schema).select(*keys, F.posexplode("_part").alias("_cell", "_value"))
    sums = cells.groupBy(*keys, "_cell").agg(F.sum("_value").alias("_value"))
    packed = F.array_sort(F.collect_list(F.struct("_cell", "_value")))
    return sums.groupBy(*keys).agg(F.transform(packed, lambda c: c["_value"]).alias("_gram"))


def _inverse(p: int):
    """Inverses of flat matrices, a batch at a time; singular ones are null."""

    @F.pandas_udf("array<double>")
    def inverse(flat: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(flat), dtype=object)
        whole = [k for k, v in enumerate(flat) if v is not None and len(v) == p * p and np.isfinite(np.asarray(v, float)).all()]
        if not whole:
            return out
        stack = np.stack([np.asarray(flat.iloc[k], float).reshape(p, p) for k in whole])
        sound = np.linalg.slogdet(stack)[0] != 0
        for k, matrix in zip(np.array(whole)[sound], np.linalg.inv(stack[sound])):
            out[int(k)] = matrix.ravel().tolist()
        return out

    return inverse


def quadratic_form(deviations: list[Column]) -> tuple[Column, Column]:
    """(contributions d_j (S^-1 d)_j as an array, their sum T^2)."""
    p, parts = len(deviations), []
    for j in range(p):
        row = sum(
            (F.get("inverse", j * p + i) * deviations[i] for i in range(1, p)),
            F.get("inverse", j * p) * deviations[0],
        )
        parts.append(deviations[j] * row)
    return F.array(*parts), sum(parts[1:], parts[0])


def with_quadratic_form(seq: Sequence, params: DataFrame, deviations: list[Column]) -> Sequence:
    """Rows with ``_shares`` and ``_square``, the contributions to T^2 and T^2 itself.

    For long vectors the rows of a key meet its inverse in groups of ``WIDE_ROWS``, once
    per group instead of once per row.
    """
    p = len(deviations)
    if p <= UNROLLED:
        rows = seq.beside(params.select(*seq.keys, "_last", "inverse"))
        shares, square = quadratic_form(deviations)
        return rows.with_columns({"_shares": shares, "_square": square}).drop("inverse")
    home = F.floor(F.col(IDX) / WIDE_ROWS)
    rows = seq.df.withColumns({"_d": F.array(*deviations), "_home": home})
    homes = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / WIDE_ROWS))
    names = [f"_key{i}" for i in range(len(seq.keys))]
    inverses = params.select(*[F.col(k).alias(n) for k, n in zip(seq.keys, names)], "inverse", F.explode(homes).alias("_group"))
    found = [T.StructField("_shares", T.ArrayType(T.DoubleType())), T.StructField("_square", T.DoubleType())]
    kept = [f for f in rows.schema.fields if f.name not in ("_d", "_home")]

    def squares(rows: pa.Table, inverse: pa.Table) -> pa.Table:
        out = rows.select([f.name for f in kept])
        flat = inverse["inverse"][0].as_py() if inverse.num_rows else None
        if not out.num_rows or flat is None:
            none = [pa.nulls(out.num_rows, t) for t in (pa.list_(pa.float64()), pa.float64())]
            return out.append_column("_shares", none[0]).append_column("_square", none[1])
        d = rows["_d"].combine_chunks().flatten().to_numpy().reshape(-1, p)
        shares = d * (d @ np.array(flat).reshape(p, p))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(d) * p + 1, p), pa.int32()), pa.array(shares.ravel()))
        return out.append_column("_shares", lists).append_column("_square", pa.array(shares.sum(1)))

    together = rows.groupBy(*seq.keys, "_home").cogroup(inverses.groupBy(*names, "_group"))
    return seq.with_df(together.applyInArrow(squares, T.StructType([*kept, *found])))


def _check_alpha(alpha: float) -> None:
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be in [0, 1], got {alpha}")


def _lines(k_sigma: float) -> list[dict]:
    return [
        {"ucl": F.col("limit"), "cl": F.lit(0.0), "lcl": F.lit(0.0)},
        {
            "signal": F.col("value") > F.col("ucl"),
            **zone_lines(F.lit(0.0), F.col("ucl") / k_sigma),
        },
    ]


def _params(params: DataFrame, method: str, k_sigma: float) -> DataFrame:
    return params.withColumns(
        {
            "center": F.lit(0.0),
            "sigma_hat": F.col("limit") / k_sigma,
            "method": F.lit(method),
            "n_used": F.col("n"),
        }
    )


def hotelling_t2(
    df: DataFrame,
    roles: Roles,
    columns: Listing[str] | str,
    *,
    size: int | None = None,
    alpha: float = 0.0027,
    stage: int = 1,
    known_mean: Listing[float] | None = None,
    known_cov: Listing[Listing[float]] | None = None,
    k_sigma: float = 3.0,
    **sizing,
) -> Chart:
    """T-squared of each row; the limit is from F in stage 1, chi-square in stage 2."""
    positive(k_sigma, "k_sigma")
    _check_alpha(alpha)
    if stage not in (1, 2):
        raise ValueError(f"stage must be 1 or 2, got {stage}")
    seq, p = variables(df, roles, columns, size, **sizing)
    params = moments(seq, p, known_mean, known_cov)
    if stage == 1:
        n = F.col("n").cast("double")
        spread = n - p
        factor = F.try_divide(p * (n - 1) * (n + 1), n * spread)
        limit = factor * f_quantile_of(1.0 - alpha, F.lit(float(p)), spread)
    else:
        limit = F.lit(chi2_quantile(1.0 - alpha, p))
    params = _params(params.withColumn("limit", limit), "hotelling_t2", k_sigma)
    rows = seq.beside(params.drop("inverse", "covariance"))
    rows = with_quadratic_form(rows, params, [F.col(f"v{i}") - F.get("mean_vector", i) for i in range(p)])
    rows = rows.with_columns({"contributions": F.col("_shares"), "value": F.col("_square")}, *_lines(k_sigma))
    return Chart("hotelling_t2", seq.keys, params, rows, k_sigma,
                 extra_columns=("contributions", "signal"))


def mewma(
    df: DataFrame,
    roles: Roles,
    columns: Listing[str] | str,
    *,
    size: int | None = None,
    lam: float = 0.2,
    alpha: float = 0.0027,
    exact_covariance: bool = True,
    known_mean: Listing[float] | None = None,
    known_cov: Listing[Listing[float]] | None = None,
    k_sigma: float = 3.0,
    **sizing,
) -> Chart:
    """T-squared of the smoothed vector.

    The covariance of the smoothed vector is a scalar times that of the data, so one
    inverse serves all rows.
    """
    positive(k_sigma, "k_sigma")
    _check_alpha(alpha)
    if not 0 < lam <= 1:
        raise ValueError(f"lam must be in (0, 1], got {lam}")
    seq, p = variables(df, roles, columns, size, **sizing)
    params = moments(seq, p, known_mean, known_cov)
    limit = F.lit(chi2_quantile(1.0 - alpha, p))
    params = _params(params.withColumn("limit", limit), "mewma", k_sigma)
    rows = seq.beside(params.drop("inverse", "covariance")).smoothed(
        lam,
        {f"z{i}": (F.col(f"v{i}") - F.get("mean_vector", i), F.lit(0.0)) for i in range(p)},
    )
    scale = F.lit(lam / (2.0 - lam))
    if exact_covariance:
        scale = scale * grown_share(lam)
    rows = with_quadratic_form(rows, params, [F.col(f"z{i}") for i in range(p)])
    value = F.when(scale < 1e-15, 0.0).otherwise(F.col("_square") / scale)
    smoothed = F.array(*[F.col(f"z{i}") + F.get("mean_vector", i) for i in range(p)])
    rows = rows.with_columns({"smoothed": smoothed, "value": value}, *_lines(k_sigma))
    return Chart("mewma", seq.keys, params, rows, k_sigma, extra_columns=("smoothed", "signal"))
