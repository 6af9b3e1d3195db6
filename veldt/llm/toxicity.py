"""Toxicity by a classifier chain.

The chain predicts the categories one after another; each linear model sees
the words and the probabilities of all earlier categories.  In training those
probabilities are out of fold: they come from models that never saw the row,
so a later model learns how far it can trust an earlier one.

Features are the distinct words of a text and their first two to five bytes
(inflected and compounded forms share them), hashed to ``DIMS``; what matters
is whether a feature occurs, so one insult in a very long text counts in full.
Models are fitted by follow-the-regularised-leader with an L1 penalty.

The labels hold one flag.  The graded categories are derived from it on the
training rows: marker features occur in at least ``MARKER_DOCS`` toxic rows and
in no clean one; ``repeated`` is a toxic row with two or more marked words and
``dense`` one with at least ``DENSE`` of its words marked.  A caller with more
label columns names them instead (``categories``).

Defined cases: null text and text without words have the features of an empty
text; a null doc_id is scored like any other; repeated rows each get their own
score; without labelled rows every score is 0; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C
from veldt.llm.ftrl import Ftrl, bounded_sample, softmax, train_in_task

DIMS = 1 << 20
PER_CLASS = 2000
EPOCHS = 5
ALPHA, L1, L2 = 2.0, 6.0, 0.01
FOLDS = 3
MARKER_DOCS = 3
DENSE = 0.02
PREFIXES = (2, 3, 4, 5)
GRADES = ["toxic", "repeated", "dense"]

_BREAKS = np.ones(256, bool)
_BREAKS[0x30:0x3A] = _BREAKS[0x41:0x5B] = _BREAKS[0x61:0x7B] = _BREAKS[0x80:] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word: its row, and its feature numbers (whole word, then each prefix)."""
    start, end, row = C.words(data, offsets, _BREAKS)
    whole = C.hash_spans(data, start, end)
    cols = [whole] + [C.hash_spans(data, start, np.minimum(end, start + p)) ^ np.uint64(0x51ED270B * p) for p in PREFIXES]
    return row, np.stack([(C.mix(c) >> np.uint64(44)).astype(np.int32) for c in cols], axis=1)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return C.utf8(pc.utf8_lower(column))


# ------------------------------------------------------------- training

def _featurize(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = lowered(b.column(1))
            row, idx = features(data, off)
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            got = [np.unique(idx[first[i]:first[i + 1]], return_counts=True) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array([g[0] for g in got], pa.list_(pa.int32())),
                 pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())),
                 pa.array(np.diff(first), pa.int64())], names=["doc_id", *names, "idx", "times", "n_words"])

    return run


def _graded(s: pd.DataFrame) -> pd.DataFrame:
    toxic = s["toxic"].to_numpy() == 1
    seen, clean = np.zeros(DIMS, np.int32), np.zeros(DIMS, np.int32)
    for i, t in zip(s["idx"], toxic, strict=True):
        (seen if t else clean)[i] += 1
    marker = (seen >= MARKER_DOCS) & (clean == 0)
    # one marked word has up to 1 + len(PREFIXES) marked features
    words = np.array([t[marker[i]].sum() for i, t in zip(s["idx"], s["times"], strict=True)]) / (1 + len(PREFIXES))
    return s.assign(repeated=(toxic & (words >= 2)).astype(int), dense=(toxic & (words >= DENSE * s["n_words"])).astype(int))


def _binary(xs: list, y: np.ndarray, rows: np.ndarray, extra: int):
    m = Ftrl(DIMS + extra, 2, alpha=ALPHA, l1=L1, l2=L2).fit([xs[k] for k in rows], y[rows], EPOCHS)
    return m.solved()


def _probability(x, model) -> float:
    w, b = model
    return float(softmax(x[1] @ w[x[0]] + b)[1])


def _fit(categories: list[str]):
    def fit(s: pd.DataFrame) -> dict:
        if categories == GRADES:
            s = _graded(s)
        base = [(i.astype(np.int64), np.ones(len(i))) for i in s["idx"]]
        fold, earlier, out = np.random.default_rng(3).permutation(len(s)) % FOLDS, [], {}
        for c, name in enumerate(categories):
            y = s[name].to_numpy().astype(int)
            xs = [(np.concatenate([i, DIMS + np.arange(c)]), np.concatenate([v, [e[k] for e in earlier]]))
                  for k, (i, v) in enumerate(base)]
            oof = np.zeros(len(s))
            for f in range(FOLDS):
                model = _binary(xs, y, np.flatnonzero(fold != f), len(categories))
                for k in np.flatnonzero(fold == f):
                    oof[k] = _probability(xs[k], model)
            earlier.append(oof)
            w, b = _binary(xs, y, np.arange(len(s)), len(categories))
            d = w[:, 1] - w[:, 0]
            at = np.flatnonzero(d[:DIMS])
            out |= {f"at{c}": at, f"w{c}": d[at], f"chain{c}": d[DIMS:DIMS + c], f"b{c}": np.array(b[1] - b[0])}
        return out

    return fit


def train(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, key: str = "doc_id", text: str = "text",
          per_class: int = PER_CLASS) -> dict:
    """Chain fitted on a bounded sample of the labelled rows; without ``categories``, on the grades of ``toxic``."""
    C.small_batches(docs.sparkSession)
    names = categories or ["toxic"]
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in names])
    rows = bounded_sample(d, lab, names, per_class).select("doc_id", "text", *names).mapInArrow(
        _featurize(names), f"doc_id long, {', '.join(f'{c} int' for c in names)}, idx array<int>, times array<int>, n_words long")
    return train_in_task(rows, _fit(categories or GRADES))


# ------------------------------------------------------------- scoring

def chain_scores(model: dict, n_categories: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each category (columns) for each row of lower-cased text."""
    n = len(offsets) - 1
    out = np.zeros((n, n_categories))
    if not model:
        return out
    row, idx = features(data, offsets)
    for c in range(n_categories):
        at, w = model[f"at{c}"], model[f"w{c}"]
        known = np.zeros(DIMS, bool)
        known[at] = True
        r, k = np.nonzero(known[idx]) if len(idx) else (np.zeros(0, int), np.zeros(0, int))
        pairs = np.unique(row[r].astype(np.int64) * DIMS + idx[r, k]) if len(r) else np.zeros(0, np.int64)
        logit = np.bincount(pairs // DIMS, w[np.searchsorted(at, pairs % DIMS)], n) if len(pairs) else np.zeros(n)
        logit = logit + float(model[f"b{c}"]) + out[:, :c] @ model[f"chain{c}"]
        out[:, c] = 1 / (1 + np.exp(-logit))
    return out


def score(docs: DataFrame, model: dict, categories: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and p_<category> for each category, in chain order, of every row."""
    C.small_batches(docs.sparkSession)
    names = categories or GRADES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = lowered(b.column(1))
            for i, j in C.slices(off):
                p = chain_scores(model, len(names), data[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(p[:, c]) for c in range(len(names))]],
                                                 names=["doc_id", *[f"p_{c}" for c in names]])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, ", ".join(["doc_id long", *[f"p_{c} double" for c in names]]))
