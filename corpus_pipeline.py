"""A cleaning pipeline over documents: toxic texts, copies, benchmark leaks and secrets out, tokens at the end.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to
the shared folder and reads again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import bpe, digests
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.minhash import keep_one_of_each
from plumbline.llm.secret_scan import redacted
from plumbline.llm.storage import stored
from plumbline.llm.toxicity import toxicity


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for rejected ids; a row that shares its id with a rejected one goes too, rows without id stay."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, toxicity(docs, labels).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate(docs, items).where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def _ids(ids, first, at, decoded, bounds) -> list[pa.Array]:
    n_tokens, _, decoded_sha256 = digests(ids, first, at, decoded, bounds)
    return [n_tokens, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), decoded_sha256]


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the bytes that the ids decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe(docs, ranks, finish=_ids, schema="doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: Models, components and merges have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
