"""Operator 4: exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.chunks import ship

QUERY_ROWS, SHARD_ROWS, FAN_IN = 2048, 8192, 16
LIMIT = float(1 << 53)


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LIMIT))
    return F.when(fine & (F.size(vector) > 0), F.transform(F.when(fine, made), lambda x: x.cast("long")))


def _tiles(rows: DataFrame, tile: str, tiles: int) -> DataFrame:
    """dim, tile and one row per tile: its ids in order and their vectors as bytes."""
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        flat = table["v"].combine_chunks().flatten().to_numpy().astype("<i8")
        return pa.table({"dim": [key[0].as_py()], tile: [key[1].as_py()], "ids": [table["id"].to_numpy().astype("<i8").tobytes()],
                         "vectors": [flat.tobytes()]}, schema=pa.schema([("dim", pa.int32()), (tile, pa.int64()),
                                                                         ("ids", pa.binary()), ("vectors", pa.binary())]))

    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(tiles)).alias(tile), "id", "v")
    return dealt.groupBy("dim", tile).applyInArrow(pack, f"dim int, {tile} long, ids binary, vectors binary")


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of each row, ties to the smaller column; NaN takes no part."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > k:
        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((scores >= limit) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """The ``k`` largest inner products of every query with all other vectors of its length.

    Components become floor(scale * x).  Queries lie in tiles, candidates in shards, by
    hash of the id; every tile meets every shard in one matrix product, of which each
    query keeps its best ``k``.  These lists are merged as a tree, ``FAN_IN`` shards at a
    time.  Products are exact: in doubles while every sum is below 2**53, else in integers.

    Result: query_id, rank (from 1), vec_id, score; score descending, ties to the smaller
    id.  Rows without id, null vectors, vectors with null or non-finite components or
    components of 2**53 and more after scaling, and empty vectors take no part.  Of rows
    that repeat an id the smallest vector counts.  A query without a partner has no rows.
    Other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), integers(vector, scale).alias("v"), queries.alias("q"))
    rows = rows.where("v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, tiles = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = _tiles(rows.where("q"), "tile", tiles).withColumn("shard", every(shards))
    right = _tiles(rows, "shard", shards).withColumn("tile", every(tiles))

    def product(key: tuple[pa.Scalar, ...], asked: pa.Table, shard: pa.Table) -> pa.Table:
        found: Iterable[np.ndarray] = [np.zeros(0, np.int64)] * 3
        if asked.num_rows and shard.num_rows:
            read = lambda t, c: np.frombuffer(t[c][0].as_py(), "<i8")
            a, b, dim = read(asked, "ids"), read(shard, "ids"), key[0].as_py()
            x, y = read(asked, "vectors").reshape(-1, dim), read(shard, "vectors").reshape(-1, dim)
            largest = float(np.abs(x).max()) * float(np.abs(y).max()) * dim
            exact = x.astype(np.float64) @ y.T.astype(np.float64) if largest < LIMIT else x @ y.T
            scores = np.where(a[:, None] == b[None, :], np.nan, exact)
            row, column = best(scores, k)
            found = a[row], b[column], np.rint(exact[row, column]).astype(np.int64)
        names = ("query_id", "vec_id", "score")
        return pa.table({**dict(zip(names, found)), "shard": np.full(len(found[0]), key[2].as_py(), np.int64)})

    cell = ("dim", "tile", "shard")
    lists = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(product, "query_id long, vec_id long, score long, shard long")
    while True:
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).drop("rank")
