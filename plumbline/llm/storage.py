"""Tables written once to the folder that all executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    A lost executor then costs a read, not the work before it.  A local session
    without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for every node of an edge.

    Alternates two rewirings: every larger neighbour of a node is tied to the node's
    smallest neighbour, then every smaller one; the edges end as stars around the labels.
    Each round is a grouped minimum and a join, and is stored.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    pairs = stored(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = stored(larger.distinct())
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(
            F.inline(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u"), F.col("m").alias("v")),
            ))
        )
        pairs = stored(smaller.where("u <> v").distinct())
        after = state(pairs)
        if after == before:
            break
        before = after
    stars = pairs.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
