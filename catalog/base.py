"""Registered queries: a Spark plan, the columns it answers with, and SQL that must agree.

``columns`` names the result columns in both languages.  A trailing ``~`` rounds
to six digits, ``^`` to four (sums of doubles differ in the last bits), ``#`` casts
to a 64 bit integer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    name: str
    rows: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}
DIGITS = {"~": 6, "^": 4}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base}/{uuid.uuid4().hex}"


def _split(spec: str) -> tuple[str, str]:
    return (spec[:-1], spec[-1]) if spec[-1] in "~^#" else (spec, "")


def _spark_column(spec: str) -> Column:
    name, kind = _split(spec)
    c = F.col(name)
    if kind in DIGITS:
        return (F.round(c.cast("double"), DIGITS[kind]) + F.lit(0.0)).alias(name)
    return (c.cast("long") if kind == "#" else c).alias(name)


def _sql_column(spec: str) -> str:
    name, kind = _split(spec)
    if kind in DIGITS:
        return f"round(CAST({name} AS DOUBLE), {DIGITS[kind]}) + CAST(0 AS DOUBLE) AS {name}"
    return f"CAST({name} AS BIGINT) AS {name}" if kind == "#" else name


def case(name: str, rows: str, columns: str, sql: str | None):
    """Register a query.  ``sql`` is a WITH list or a query; its last table is ``answer``."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        specs = columns.split()

        def query(spark: SparkSession, folder: str) -> DataFrame:
            return run(spark, folder).select(*[_spark_column(s) for s in specs])

        text = None
        if sql is not None:
            picked = ", ".join(_sql_column(s) for s in specs)
            text = f"WITH {sql.strip()}\nSELECT {picked} FROM answer"
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = Case(name, tuple(rows.split()), query, text)
        return run

    return register
