"""Evaluation operators against brute-force NumPy computations on small frames."""
import numpy as np
import pytest

from veldt.operators import evaluate as EV


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(y, p):
    ap, prev_r = 0.0, 0.0
    for thr in sorted(set(p), reverse=True):
        sel = p >= thr
        tp = (y[sel] == 1).sum()
        prec, rec = tp / sel.sum(), tp / (y == 1).sum()
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)   # many ties
    rows = [("E", i, "fire", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "entity string, day int, threat string, y int, p double")
    return df, y, p


def test_auc_ap_match_brute_force(data):
    df, y, p = data
    r = EV.auc_ap(df).collect()[0]
    assert r["roc_auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(brute_ap(y, p), abs=1e-12)


def test_metrics_and_f2(data):
    df, y, p = data
    m = EV.metrics(df).collect()[0]
    pred = p >= 0.5
    tp, fp, fn = ((y == 1) & pred).sum(), ((y == 0) & pred).sum(), ((y == 1) & ~pred).sum()
    assert m["f2"] == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp))
    assert m["brier"] == pytest.approx(((p - y) ** 2).mean())


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([("E", i, "fire", 1, 0.3) for i in range(5)],
                               "entity string, day int, threat string, y int, p double")
    assert EV.auc_ap(df).collect()[0]["roc_auc"] is None


def test_lead_time(spark):
    # onset at i=5; p >= .7 at rows 2 and 3 -> nearest prior hit is row 3 -> lead 2
    ys = [0, 0, 0, 0, 0, 1, 1, 0]
    ps = [0.1, 0.1, 0.8, 0.9, 0.2, 0.2, 0.2, 0.1]
    df = spark.createDataFrame([("E", i, "fire", y, p) for i, (y, p) in enumerate(zip(ys, ps))],
                               "entity string, day int, threat string, y int, p double")
    assert EV.lead_time(df).collect()[0]["lead_time_days"] == 2.0


def test_bootstrap_point_equals_f2(data):
    df, _, _ = data
    m = EV.metrics(df)
    b = EV.bootstrap_f2(m).collect()[0]
    assert b["f2_point"] == pytest.approx(m.collect()[0]["f2"])
    assert b["ci_lower"] <= b["f2_point"] <= b["ci_upper"]
