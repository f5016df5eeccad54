"""What the two label-trained operators share: bounded labelled samples and a small calibrated regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id's text falls into the held-out remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out part, chosen by a hash of their ids.

    The sample's ids are bounded by ``rows``, so they are broadcast and the documents aren't shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the intercept first) of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = probability(x @ w)
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
