"""Follow-the-regularised-leader training of sparse logistic models, and the labelled rows that they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def remainder(row_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_ids(labels: DataFrame, label: str, row_id: str, learns: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id among those for which ``learns`` holds.

    An id with several labels gets the largest; labels other than 0 and 1 and null ids are left out.
    """
    return (
        labels.where(learns)
        .where(F.col(row_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(row_id).alias("label_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id", F.lit(7)), "label_id")
        .limit(rows)
    )


def sample(docs: DataFrame, chosen: DataFrame, row_id: str, text: str, max_bytes: int) -> DataFrame:
    """``label_id, label, text`` of the ids in ``chosen`` that ``docs`` has: one row an id, at most ``max_bytes`` of text in all.

    Of rows with one id the text of the smallest hash counts. Ids are taken by their hash while there is room; a text too
    large for what is left is passed over. Only sizes, at most as many as ``chosen`` has rows, come to the driver.
    """
    rows = docs.select(F.col(row_id).alias("label_id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "label_id")
    one = rows.groupBy("label_id").agg(F.min("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))).alias("first"))
    sizes = one.select("label_id", "label", "first.*").orderBy(F.xxhash64("label_id", F.lit(7)), "label_id").collect()
    kept, total = [], 0
    for r in sizes:
        if total + r["size"] <= max_bytes:
            total += r["size"]
            kept.append((r["label_id"], r["label"], r["h"]))
    known = docs.sparkSession.createDataFrame(kept, f"label_id {dict(chosen.dtypes)['label_id']}, label int, h long")
    texts = docs.select(F.col(row_id).alias("label_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return texts.join(F.broadcast(known), ["label_id", "h"]).groupBy("label_id", "h").agg(F.min("label").alias("label"), F.first("text").alias("text")).select("label_id", "label", "text")


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    size: int,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.0,
    l2: float = 1.0,
    epochs: int = 40,
    least_gain: float = 0.02,
    seed: int = 1,
) -> np.ndarray:
    """Weights of FTRL-proximal over ``(indices, values)`` rows with targets in [0, 1].

    Passes go on until one lowers the mean loss by less than a share ``least_gain``, at most ``epochs``.
    """
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)
    before = np.inf
    for _ in range(epochs):
        loss = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = sigmoid(float(w @ x))
            loss -= targets[i] * np.log(p) + (1 - targets[i]) * np.log(1 - p)
            g = (p - targets[i]) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
        if loss > (1 - least_gain) * before:
            break
        before = loss
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


ship_by_value(__name__)
