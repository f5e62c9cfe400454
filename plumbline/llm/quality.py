"""Operator 7: quality by perplexity under a Kneser-Ney model of trusted text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ngram_model import scored
from plumbline.llm.storage import stored


def surprise(data: np.ndarray, offsets: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
    """Negative log-probability per byte."""
    total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
    n = np.diff(offsets)
    return {"bytes": n.astype(np.float64), "surprise": -(total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)}


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
            label: str = "quality", keep: float = 0.99, accuracy: int = 10_000) -> DataFrame:
    """Perplexity per byte of every text, and whether it stays below its language's threshold.

    The model counts six-byte n-grams of all trusted texts (label 1) but those with
    crc32(id as text) mod 5 = 0.  Those are unseen, and the ``keep`` quantile of their
    perplexities, per language, is the threshold; a language without such texts, and a
    null language, takes the quantile over all languages.

    Result: doc_id, lang, perplexity, threshold, kept, held_out.  One row per distinct id:
    of rows that repeat an id, the largest perplexity and smallest language count; rows
    without id are returned each.  Null and empty texts have perplexity 1 and are not
    kept.  Without trusted texts the model is uniform, thresholds are null and nothing
    is kept.  An empty table gives no rows.
    """
    part = F.crc32(F.col("id").cast("string")) % 5
    trusted = labels.where(F.col(id).isNotNull() & (F.col(label) == 1)).select(
        F.col(id).cast("long").alias("id"), F.lit(0).alias("label")).distinct()
    values = stored(scored(docs, trusted.where(part != 0), 1, surprise, "id long, bytes double, surprise double", id, text, lower=False))
    values = values.select("id", "bytes", F.exp("surprise").alias("perplexity"))
    langs = docs.select(F.col(id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"))
    one = values.where("id is not null").groupBy("id").agg(F.max("bytes").alias("bytes"), F.max("perplexity").alias("perplexity"))
    rows = stored(one.join(langs.where("id is not null").groupBy("id").agg(F.min("lang").alias("lang")), "id").unionByName(
        values.where("id is null").withColumn("lang", F.lit(None).cast("string"))))
    unseen = rows.where((part == 0) & (F.col("bytes") > 0)).join(trusted.select("id"), "id", "left_semi")
    limit = F.percentile_approx("perplexity", keep, accuracy)
    by_lang = unseen.where("lang is not null").groupBy("lang").agg(limit.alias("own"))
    overall = unseen.agg(limit.alias("all")).first()["all"]
    placed = rows.join(by_lang, "lang", "left").withColumn(
        "threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = (F.col("bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return placed.select(F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", kept.alias("kept"),
                         F.coalesce(part == 0, F.lit(False)).alias("held_out"))
