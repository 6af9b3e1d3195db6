"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one blank,
and all n-grams of one to three characters are hashed to ``DIMS`` features.  A
feature's value is its share of the text's n-grams times its inverse document
frequency.  Weights are fitted by follow-the-regularised-leader with an
elastic net on at most ``PER_LANGUAGE`` documents of each language; on a fifth
of them that the weights never saw, one temperature is fitted so that the
probabilities are calibrated.

Defined cases: null text or text without a letter is ``und`` with score 0;
without any labelled document all texts are ``und``; a null doc_id is held out;
repeated rows each get their own prediction; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C
from veldt.llm.ftrl import Ftrl, bounded_sample, softmax, train_in_task

DIMS = 1 << 16
PER_LANGUAGE = 800
EPOCHS = 4
SCALE = 30.0
FOLDS = 5
#: characters handled at once
_CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    every = np.zeros(0x110000, bool)
    every[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return every


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, a long text in pieces (which overlap, so none is lost);
    nothing for a text without letters."""
    text = text or ""
    for a in range(0, len(text), _CHARS):
        # two characters of the piece before complete the n-grams across the cut
        cp = np.frombuffer(text[max(0, a - 2):a + _CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[cp], cp, 0).astype(np.uint32)
        c = np.concatenate([[np.uint32(0)], c, [np.uint32(0)]]).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        if not c.any():
            continue
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(0xC2B2AE35)
        yield np.concatenate([_fold(one[c != 0], 1), _fold(two, 2), _fold(three, 3)])


def _fold(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x27D4EB2F)) * np.uint32(0x165667B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int32)


def _featurize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        idx, share = [], []
        for t in f["text"]:
            n = np.zeros(DIMS, np.int64)
            for g in ngrams(t):
                n += np.bincount(g, minlength=DIMS)
            at = np.flatnonzero(n)
            idx.append(at.astype(np.int32))
            share.append((n[at] / max(1, n.sum())).astype(np.float32))
        yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "idx": idx, "share": share})


def _fit(sample: pd.DataFrame) -> dict:
    sample = sample[sample["idx"].map(len) > 0].reset_index(drop=True)
    langs = sorted(set(sample["label"]))
    if not langs:
        return {}
    y = np.array([langs.index(v) for v in sample["label"]])
    test = np.arange(len(y)) % FOLDS == 0 if len(y) >= 10 * FOLDS else np.zeros(len(y), bool)
    train = np.flatnonzero(~test)
    df = np.zeros(DIMS)
    for k in train:
        df[sample["idx"][k]] += 1
    idf = np.where(df > 0, np.log((1 + len(train)) / (1 + df)) + 1, 0.0)
    xs = [(i, s * idf[i] * SCALE) for i, s in zip(sample["idx"], sample["share"], strict=True)]
    w, b = Ftrl(DIMS, len(langs), alpha=1.0, l1=0.02, l2=0.02).fit([xs[k] for k in train], y[train], EPOCHS).solved()
    temperature = 1.0
    if test.any():
        logits = np.array([xs[k][1] @ w[xs[k][0]] + b for k in np.flatnonzero(test)])
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
        right = np.arange(len(logits)), y[test]
        temperature = min(grid, key=lambda t: -np.log(softmax(logits / t)[right] + 1e-12).sum())
    return {"langs": np.array(langs), "w": (w * idf[:, None] * SCALE).astype(np.float32), "b": b, "t": np.array(temperature)}


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = PER_LANGUAGE) -> dict:
    """Model (arrays) learnt from the rows of ``docs`` whose language is known."""
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    sample = bounded_sample(d, d.select("doc_id", "label"), ["label"], per_language)
    return train_in_task(sample.mapInPandas(_featurize, "doc_id long, label string, idx array<int>, share array<float>"), _fit)


def predictor(model: dict):
    """Function from a text to (language, calibrated probability)."""
    if not model:
        return lambda text: ("und", 0.0)
    langs, w, b, t = [str(x) for x in model["langs"]], model["w"], model["b"], float(model["t"])

    def one(text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(langs)), 0
        for g in ngrams(text):
            total += np.take(w, g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        if not n:
            return "und", 0.0
        p = softmax((total / n + b) / t)
        k = int(p.argmax())
        return langs[k], float(p[k])

    return one


def _identify(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = predictor(model)
        for b in batches:
            got = [one(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             names=[*b.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    C.small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _identify(model), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows (all columns) whose language is known with a probability of at least ``least``."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = predictor(model)
        for b in batches:
            got = [one(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield b.filter(pa.array([lang != "und" and p >= least for lang, p in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
