"""Operator 10: toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ngram_model import scored
from plumbline.llm.storage import stored
from plumbline.llm.words import split

#: At most so many labelled rows, those with the smallest hashes of their ids, fit the three weights.
FIT_ROWS = 20_000
FEATURES = ("mean", "peak", "top")
TOP = 5


def ratios(data: np.ndarray, offsets: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
    """Log-ratio per byte of each text, of its most toxic word, and of its five most toxic words on average."""
    texts, n = len(offsets) - 1, np.diff(offsets)
    total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
    mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
    words = split(data, offsets)
    after = np.minimum(words.ends + 1, offsets[1:][words.text])
    value = total[after] - total[words.starts]
    order = np.lexsort((-value, words.text))
    rank = np.arange(len(value)) - words.first[:-1][words.text]
    best = rank < TOP
    top = np.bincount(words.text[best], value[order][best], texts) / np.maximum(np.minimum(words.counts(), TOP), 1)
    peak = np.zeros(texts)
    peak[words.text[rank == 0]] = value[order][rank == 0]
    return {"mean": mean, "peak": peak, "top": top}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights and intercept by Newton's method; stops when a step is below 1e-9."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = penalty * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
             label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every text between a toxic and an ordinary model.

    Each model counts the n-grams of three to six bytes of its class's lower-cased texts;
    both share the continuation counts of one and two bytes.  Rows are dealt by crc32(id as text) mod 5: 0 is held out,
    1 to 3 are counted, and 4, which the models have not seen, fits a logistic curve
    through the length-normalised log-ratios (mean per byte, most toxic word, top five
    words) of at most ``fit_rows`` rows.

    Result: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5) and the
    three ratios.  One row per input row; a null or empty text has ratios of zero and the
    score that follows from them.  Rows of equal id and text get equal scores; a row
    without id is scored and not held out.  An id labelled twice counts as toxic if any
    of its labels does.  If the fitting rows have one class or none, the score is the
    logistic function of the most toxic word's ratio less 5.  An empty table gives no rows.
    """
    part = F.crc32(F.col("id").cast("string")) % 5
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    counted, fitted = known.where(part.isin(1, 2, 3)), known.where(part == 4)
    schema = "id long, mean double, peak double, top double"
    values = stored(scored(docs, counted, 2, ratios, schema, id, text))
    sample = values.join(fitted, "id").orderBy(F.xxhash64("id"), "id", *FEATURES).limit(fit_rows)
    rows = np.array([[float(v) for v in r] for r in sample.select(*FEATURES, "label").collect()]).reshape(-1, 4)
    if 0 < rows[:, 3].sum() < len(rows):
        weights = logistic(rows[:, :3], rows[:, 3])
    else:
        weights = np.array([0.0, 1.0, 0.0, -5.0])
    z = F.lit(float(weights[3]))
    for w, feature in zip(weights, FEATURES):
        z = z + F.lit(float(w)) * F.col(feature)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    held = F.coalesce(part == 0, F.lit(False))
    return values.select(F.col("id").alias("doc_id"), held.alias("held_out"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("predicted"), *FEATURES)
