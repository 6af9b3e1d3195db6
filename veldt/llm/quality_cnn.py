"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes slide over
the whole text, and each overlapping chunk (two blocks of ``BLOCK`` bytes, the
next one starting a block later) keeps every filter's maximum.  The mean and
the maximum over all chunks go through one logistic unit to one probability.

Scoring works on tables: embedding and filters of two neighbouring bytes are
summed up once for all 65,536 pairs, so a position costs two look-ups.

Training takes at most ``PER_CLASS`` labelled documents of each class; both
training and scoring read every byte of a text.  Blocks go through in pieces,
of which only each filter's maximum, and in training its place, is kept.

Defined cases: null and empty texts are scored like a text of zero bytes; rows
with a null doc_id are held out; repeated rows each get their own score;
without labelled rows every score is 0.5; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C
from veldt.llm.ftrl import bounded_sample, train_in_task

WIDTH = 4
EMBED = 8
FILTERS = 16
BLOCK = 256
PER_CLASS = 1000
STEPS = 700
BATCH = 32
RATE = 0.01
#: blocks that training and scoring hold at once
_PIECE = 128


# ------------------------------------------------------------- training

def blocks_of(text: bytes) -> np.ndarray:
    """All blocks as rows of BLOCK + WIDTH - 1 bytes (the next block's first bytes, zero padded)."""
    blocks = max(1, -(-len(text) // BLOCK))
    buf = np.frombuffer(text + bytes(BLOCK + WIDTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, BLOCK + WIDTH - 1)[:blocks * BLOCK:BLOCK]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [x or "" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.encode() for t in got], pa.binary())],
                                         names=["doc_id", "label", "bytes"])


def _tops(docs: list[np.ndarray], tab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every block, each filter's maximum and the WIDTH bytes (blocks, WIDTH, FILTERS) it was found at."""
    raws, bytes_ = [], []
    for doc in docs:
        for a in range(0, len(doc), _PIECE):
            x = doc[a:a + _PIECE]
            n, rows = x.shape[1] - WIDTH + 1, np.arange(len(x))[:, None]
            act = tab[0][x[:, :n]]
            for j in range(1, WIDTH):
                act += tab[j][x[:, j:j + n]]
            at = act.argmax(axis=1)
            raws.append(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0])
            bytes_.append(np.stack([x[rows, at + j] for j in range(WIDTH)], axis=1))
    return np.concatenate(raws), np.concatenate(bytes_)


def fit(docs: list[np.ndarray], y: np.ndarray, prior: float | None = None, steps: int = STEPS, seed: int = 11) -> dict:
    """Adam on the mean log loss; docs: all blocks of each text.  Gradients reach only the positions that held a maximum."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "W": rng.normal(0, 0.5, (WIDTH, EMBED, FILTERS)), "c": np.zeros(FILTERS),
         "u": rng.normal(0, 0.1, 2 * FILTERS), "v": np.zeros(1)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    m1, m2, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    share = max(1e-6, float(np.mean(y)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1e-6, 1 - share))
    for _ in range(-(-steps * BATCH // max(1, len(docs)))):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            take = order[a:a + BATCH]
            tab = np.einsum("be,jef->jbf", p["E"], p["W"])
            raw, x = _tops([docs[k] for k in take], tab)
            # a chunk is a block and the next one, a lone block is a chunk
            size = np.array([len(docs[k]) for k in take])
            block = np.concatenate([s + np.arange(max(1, n - 1)) for s, n in zip(np.cumsum(size) - size, size, strict=True)])
            owner = np.repeat(np.arange(len(take)), np.maximum(1, size - 1))
            first = np.searchsorted(owner, np.arange(len(take)))
            after = (block + (size[owner] > 1))[:, None]
            src = np.where(np.take_along_axis(raw, np.broadcast_to(after, (len(block), FILTERS)), axis=0) > raw[block], after, block[:, None])
            raw = np.take_along_axis(raw, src, axis=0) + p["c"]
            top = np.maximum(raw, 0)
            count = np.bincount(owner)[:, None]
            mean = np.add.reduceat(top, first, axis=0) / count
            peak = np.maximum.reduceat(top, first, axis=0)
            out = 1 / (1 + np.exp(-np.clip(np.concatenate([mean, peak], axis=1) @ p["u"] + p["v"], -30, 30)))
            err = ((out - y[take]) * weight[take] / len(take)).astype(np.float32)
            g = {"u": np.concatenate([mean, peak], axis=1).T @ err, "v": np.array([err.sum()], np.float32)}
            back = err[:, None] * p["u"]
            d = (back[:, :FILTERS] / count)[owner]
            d = d + np.where(top == peak[owner], back[:, FILTERS:][owner], 0)
            d = np.where(raw > 0, d, 0).astype(np.float32)
            g["c"], dtab, each = d.sum(axis=0), np.zeros_like(tab), np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                np.add.at(dtab[j], (x[src, j, each], each), d)
            g["E"] = np.einsum("jbf,jef->be", dtab, p["W"])
            g["W"] = np.einsum("be,jbf->jef", p["E"], dtab)
            t += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    if prior is not None:
        p["v"] = p["v"] + np.log(np.clip(prior, 1e-4, 1 - 1e-4) / (1 - np.clip(prior, 1e-4, 1 - 1e-4)))
    return {k: x.astype(np.float32) for k, x in p.items()}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          per_class: int = PER_CLASS) -> dict:
    """Network fitted on a bounded sample of the labelled rows, with the label's share among all of them as prior."""
    C.small_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    prior, = lab.agg(F.avg("label")).first()
    rows = bounded_sample(d, lab, ["label"], per_class).select("doc_id", "text", "label").mapInArrow(
        _featurize, "doc_id long, label int, bytes binary")

    def one(s: pd.DataFrame) -> dict:
        return fit([blocks_of(t) for t in s["bytes"]], s["label"].to_numpy().astype(np.float32), prior)

    return train_in_task(rows, one)


# ------------------------------------------------------------- scoring

class Scorer:
    def __init__(self, model: dict):
        tab = np.einsum("be,jef->jbf", model["E"], model["W"]).astype(np.float32)
        self.pair = [np.ascontiguousarray((tab[j][:, None, :] + tab[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in (0, 2)]
        self.c, self.u, self.v = model["c"], model["u"], float(model["v"][0])

    def __call__(self, text: np.ndarray) -> float:
        """text: bytes.  Blocks go through in pieces; a block's maximum is all that is kept of it."""
        blocks = max(1, -(-len(text) // BLOCK))
        tops = np.empty((blocks, FILTERS), np.float32)
        for a in range(0, blocks, _PIECE):
            b = min(blocks, a + _PIECE)
            part = text[a * BLOCK:b * BLOCK + WIDTH - 1]
            x = np.zeros((b - a) * BLOCK + WIDTH - 1, np.int64)
            x[:len(part)] = part
            two = x[:-1] * 256 + x[1:]
            n = (b - a) * BLOCK
            act = self.pair[0][two[:n]]
            act += self.pair[1][two[2:n + 2]]
            tops[a:b] = act.reshape(b - a, BLOCK, FILTERS).max(axis=1)
        if blocks > 1:
            tops = np.maximum(tops[:-1], tops[1:])
        tops = np.maximum(tops + self.c, 0)
        z = float(np.concatenate([tops.mean(axis=0), tops.max(axis=0)]) @ self.u) + self.v
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Scorer(model) if model else lambda t: 0.5
        for b in batches:
            data, off = C.utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(data[off[i]:off[i + 1]]) for i in range(b.num_rows)], pa.float64())],
                                             names=["doc_id", "score"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
