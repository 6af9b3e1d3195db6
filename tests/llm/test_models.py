import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.conftest import make
from veldt.llm import langid, quality_cnn, queries, toxicity
from veldt.llm.common import table


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


# ------------------------------------------------------------- language

def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op4_ftrl_language_id"](spark, SF_MID).join(table(spark, SF_MID, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(messy, messy_rows, empty):
    model = langid.train(messy)
    rows = langid.identify(messy, model).collect()
    assert ids(rows) == Counter(r[0] for r in messy_rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (5, 6, 7)} == {"und"}
    kept = langid.keep_identified(messy, model, least=0.0)
    assert kept.columns == messy.columns and ids(kept.collect()).keys().isdisjoint({5, 6, 7})
    assert langid.train(empty) == {} and langid.identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(messy, {}).collect()} == {"und"}


def test_ngrams_of_pieces_are_those_of_the_whole():
    text, old = "Straße und Élan, zwei Wörter! " * 40, langid._CHARS
    whole = Counter(np.concatenate(list(langid.ngrams(text))).tolist())
    langid._CHARS = 97
    try:
        parts = Counter(np.concatenate(list(langid.ngrams(text))).tolist())
    finally:
        langid._CHARS = old
    assert set(whole) <= set(parts)


# ------------------------------------------------------------- quality

def test_quality_held_out(spark):
    got = queries.QUERIES["op3_byte_cnn_quality"](spark, SF_MID).join(table(spark, SF_MID, "labels"), "doc_id")
    rows = got.where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.88
    low, high = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean([a < b for a in low for b in high]) > 0.9


def test_quality_scores_every_byte_like_a_plain_convolution():
    rng = np.random.default_rng(2)
    m = quality_cnn.fit([rng.integers(0, 256, (3, 2 * quality_cnn.BLOCK + quality_cnn.WIDTH - 1)).astype(np.uint8) for _ in range(6)],
                        np.array([0, 1, 0, 1, 0, 1], np.float32), steps=5)
    one = quality_cnn.Scorer(m)
    for n in (0, 1, 5, 256, 257, 700, 256 * 300 + 11):
        t = rng.integers(0, 256, n).astype(np.uint8)
        blocks = max(1, -(-n // quality_cnn.BLOCK))
        x = np.concatenate([t, np.zeros(blocks * quality_cnn.BLOCK - n + 3, np.uint8)])
        act = sum((m["E"] @ m["W"][j])[x[j:len(x) - 3 + j]] for j in range(4))
        tops = [act[a * 256:(a + 2) * 256].max(axis=0) for a in range(max(1, blocks - 1))]
        tops = np.maximum(np.array(tops) + m["c"], 0)
        z = np.concatenate([tops.mean(axis=0), tops.max(axis=0)]) @ m["u"] + m["v"][0]
        assert abs(one(t) - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_edge_cases(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (10, 0), (10, 1), (None, 1), (8, None), (3, 1), (13, 0)], "doc_id long, quality int")
    rows = quality_cnn.score(messy, quality_cnn.train(messy, labels)).collect()
    assert ids(rows) == Counter(r[0] for r in messy_rows) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("false")
    assert quality_cnn.train(messy, none) == {} and quality_cnn.train(empty, none) == {}
    assert {r["score"] for r in quality_cnn.score(messy, {}).collect()} == {0.5} and quality_cnn.score(empty, {}).count() == 0


# ------------------------------------------------------------- toxicity

def _toxic(spark, n=240):
    rng = random.Random(8)
    kind = [rng.randrange(3) for _ in range(n)]
    rows = [(i, "the quick brown fox number %d jumps over lazy dogs %s" % (i, ("you idiot", "grumbly" + "xyz"[i % 3], "")[kind[i]]), "en", "a")
            for i in range(n)]
    return make(spark, rows), spark.createDataFrame([(r[0], int(kind[r[0]] < 2)) for r in rows], "doc_id long, toxic int")


def test_toxicity_chain_held_out(spark):
    docs, labels = _toxic(spark)
    learn = F.col("doc_id") % 4 != 0
    got = toxicity.score(docs, toxicity.train(docs, labels.where(learn))).where(~learn).join(labels, "doc_id").collect()
    assert len(got) == 60 and all((r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in got)
    long = make(spark, [(1, "calm words " * 20_000 + "you IDIOT!", "en", "a"), (2, "calm words " * 20_000, "en", "a")])
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(long, toxicity.train(docs, labels)).collect()}
    assert p[1] >= 0.5 > p[2]


def test_toxicity_chain_feeds_earlier_probabilities(spark):
    docs, labels = _toxic(spark)
    labels = labels.select("doc_id", "toxic", (F.col("toxic") * 1).alias("second"))
    model = toxicity.train(docs, labels, ["toxic", "second"])
    assert model["chain0"].shape == (0,) and model["chain1"].shape == (1,) and model["chain1"][0] > 0
    assert toxicity.score(docs, model, ["toxic", "second"]).columns == ["doc_id", "p_toxic", "p_second"]


def test_toxicity_on_given_tables(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    got = queries.QUERIES["op7_toxicity_chain"](spark, SF_MID).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert docs.count() == queries.QUERIES["op7_toxicity_chain"](spark, SF_MID).count()
    assert np.mean([r["said"] for r in got if r["toxic"] == 0]) < 0.01 and np.mean([r["said"] for r in got if r["toxic"] == 1]) > 0.9


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity_edge_cases(spark, messy, messy_rows, empty, labelled):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (10, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int").where(
        "true" if labelled else "false")
    rows = toxicity.score(messy, toxicity.train(messy, labels)).collect()
    assert ids(rows) == Counter(r[0] for r in messy_rows) and all(0 <= r["p_dense"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_network_learns_from_the_whole_text():
    """Every block of a long text is learned from: bytes that stand in one of 60 blocks change the network, in any block."""
    rng, q = np.random.default_rng(8), quality_cnn
    texts, y = [rng.integers(97, 123, 60 * q.BLOCK).astype(np.uint8) for _ in range(2)], np.array([0, 1], np.float32)

    def learned(block):
        t = texts[1].copy()
        if block is not None:
            t[block * q.BLOCK:(block + 1) * q.BLOCK] = np.arange(q.BLOCK)
        docs = [q.blocks_of(x.tobytes()) for x in (texts[0], t)]
        assert all(len(d) == 60 and d.shape[1] == q.BLOCK + q.WIDTH - 1 for d in docs) and docs[1][:, :q.BLOCK].tobytes() == t.tobytes()
        return q.fit(docs, y, steps=1)["u"]

    plain = learned(None)
    assert all(not np.allclose(learned(b), plain, atol=1e-7) for b in (0, 3, 28, 31, 59))
    assert q.blocks_of(b"").shape == (1, q.BLOCK + q.WIDTH - 1) and len(q.blocks_of(bytes(q.BLOCK + 1))) == 2


def test_places_of_the_maxima():
    rng, q = np.random.default_rng(9), quality_cnn
    tab = rng.normal(0, 1, (q.WIDTH, 256, q.FILTERS)).astype(np.float32)
    docs = [q.blocks_of(rng.integers(0, 256, n).astype(np.uint8).tobytes()) for n in (5, 700, 256 * 300 + 11)]
    top, at = q._tops(docs, tab)
    assert len(top) == sum(len(d) for d in docs)
    x = np.concatenate(docs)
    act = sum(tab[j][x[:, j:j + q.BLOCK]] for j in range(q.WIDTH))
    assert np.allclose(top, act.max(axis=1), atol=1e-4)
    assert np.allclose(sum(tab[j][at[:, j], np.arange(q.FILTERS)[None, :]] for j in range(q.WIDTH)), top, atol=1e-4)
