"""Bounded samples of labelled rows, and a small logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_labelled(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_bytes: int = 64_000_000
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_label`` (text, label) pairs of each label value, and how many rows have each.

    ``usable`` is a condition over ``id`` that says which rows may be learned from.  The rows are
    those whose id hashes lowest, so the sample doesn't depend on how the tables are stored; the
    first ones of each label with ``label_bytes`` of whole texts in all are taken.  A document with
    several label rows takes the largest label, an identifier with several texts the smallest text;
    null ids and labels take no part.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(usable)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    rows = {int(r["label"]): int(r["count"]) for r in marked.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        some = marked.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_label rows: a broadcast of proven size
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    # windows over the chosen rows, per_label at most
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= label_bytes).drop("bytes").collect()
    found.sort(key=lambda r: (r["id"], r["text"]))
    return [(r["text"], int(r["label"])) for r in found], rows


def fold(id_col: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(parts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model (the last is the intercept), by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = ridge * np.r_[np.ones(x.shape[1]), 0.0] * weight.sum() / max(1, len(x)) + 1e-9
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (weight * (p - y)) + keep * w
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
