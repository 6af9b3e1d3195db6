"""Follow-the-regularised-leader (proximal) for sparse softmax regression, and
the bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import materialize

Sparse = tuple[np.ndarray, np.ndarray]  # feature numbers (distinct), values


class Ftrl:
    """Elastic-net softmax regression; weights follow from the sums z and n, so L1 keeps them sparse."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, x: Sparse, y: int) -> None:
        i, v = x
        z, n = self.z[i], self.n[i]
        w, b = self.weights(z, n, self.l1), self.weights(self.bias_z, self.bias_n, 0.0)
        err = softmax(v @ w + b)
        err[y] -= 1
        g = v[:, None] * err
        g2 = n + g * g
        self.z[i] = z + g - (np.sqrt(g2) - np.sqrt(n)) / self.alpha * w
        self.n[i] = g2
        b2 = self.bias_n + err * err
        self.bias_z += err - (np.sqrt(b2) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n = b2

    def fit(self, xs: list[Sparse], ys: np.ndarray, epochs: int, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(xs)):
                self.step(xs[k], int(ys[k]))
        return self

    def solved(self) -> tuple[np.ndarray, np.ndarray]:
        return self.weights(self.z, self.n, self.l1), self.weights(self.bias_z, self.bias_n, 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bounded_sample(docs: DataFrame, labels: DataFrame, classes: list[str], per_class: int) -> DataFrame:
    """(doc_id, text, <classes>) of at most ``per_class`` documents of every combination of labels,
    the ones whose ids hash lowest.

    labels: doc_id and label columns.  Ids with a null label or contradictory
    labels are left out, and repeated ids count once.  The chosen ids are at
    most ``per_class`` times the number of combinations; they are broadcast
    while that is under 50,000.
    """
    clean = labels.dropna(subset=["doc_id", *classes]).groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in classes], *[F.max(c).alias(f"__{c}") for c in classes])
    for c in classes:
        clean = clean.where(F.col(c) == F.col(f"__{c}"))
    # A first cut by the hash itself leaves about twice as many as are wanted, however many rows
    # a combination has, so the ranking below never gathers a large group.
    clean = clean.select("doc_id", *classes)
    part = F.least(F.lit(1.0), F.lit(2.0 * per_class + 100) / F.col("__n"))
    place = F.xxhash64("doc_id").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    few = clean.join(clean.groupBy(*classes).agg(F.count(F.lit(1)).alias("__n")), classes).where(place <= part).drop("__n")
    rank = F.row_number().over(Window.partitionBy(*classes).orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = materialize(few.withColumn("__r", rank).where(F.col("__r") <= per_class).drop("__r"), "sample-ids")
    side = F.broadcast(ids) if ids.count() <= 50_000 else ids
    return docs.select("doc_id", "text").join(side, "doc_id").dropDuplicates(["doc_id"])


def train_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], dict]) -> dict:
    """Run ``fit`` on the whole (bounded) sample in one task; its dict of arrays comes back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            buf = io.BytesIO()
            np.savez(buf, **fit(pd.concat(parts, ignore_index=True).sort_values("doc_id", ignore_index=True)))
            yield pd.DataFrame({"model": [buf.getvalue()]})

    got = sample.repartition(1).mapInPandas(run, "model binary").collect()
    if not got:
        return {}
    with np.load(io.BytesIO(got[0][0])) as f:
        return {k: f[k] for k in f.files}
