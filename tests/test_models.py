"""Model fitting: staged ensembles, grid pick, stored scorer, self-training against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import evaluate as EV
from veldt.operators import ml as ML
from veldt.streaming.daily import fresh_base

SCHEMA = ", ".join([f"{c} double" for c in C.FEATURE_COLS] + [f"{c} int" for c in C.LABEL_COLS] + ["entity string", "day date", "n int"])


def frame(spark, n, seed, labelled=True):
    """Rows whose first three features decide the three labels, with noise and NULL features."""
    import datetime
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in C.FEATURE_COLS]
        y = [int(x[k] + rng.gauss(0, 0.5 + 0.4 * k) > 0.3 * k) for k in range(3)]
        x[4] = None if i % 7 == 0 else x[4]
        rows.append((*x, *(y if labelled else [None] * 3), f"e{i % 5}", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), i))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def data(spark):
    train, val = frame(spark, 400, 1), frame(spark, 200, 2)
    med = ML.fit_medians(train)
    return ML.impute(train, med).coalesce(1).cache(), ML.impute(val, med).coalesce(1).cache(), med


def scores(model, df):
    return [r["p"] for r in ML.predict(model, df, "p").orderBy("n").select("p").collect()]


def test_larger_ensembles_are_grown_from_smaller_ones(data):
    train, val, _ = data
    params = {"maxDepth": 3, "stepSize": 0.1}
    staged = ML.fit_staged(train, C.LABEL_COLS[0], "gbt", params, [4, 6])
    for rounds in (4, 6):
        alone = ML.fit_classifier(train, C.LABEL_COLS[0], "gbt", params | {"maxIter": rounds})
        assert scores(staged[rounds], val) == pytest.approx(scores(alone, val), abs=1e-12)
    forest = ML.fit_staged(train, C.LABEL_COLS[0], "rf", {"maxDepth": 5, "minInstancesPerNode": 1}, [6, 4])
    (first, a), (more, b) = forest[6].parts
    assert (a, b) == (4.0, 2.0) and forest[4].parts == [(first, 4.0)]
    mean = [(4 * x + 2 * y) / 6 for x, y in zip(scores(forest[4], val), scores(ML.Ensemble([(more, 1.0)]), val), strict=True)]
    assert scores(forest[6], val) == pytest.approx(mean, abs=1e-12)


def test_one_class_needs_one_tree(data):
    train, val, _ = data
    for value in (0, 1):
        same = train.withColumn(C.LABEL_COLS[0], F.lit(value))
        for kind, params in (("rf", {"maxDepth": 3}), ("gbt", {"maxDepth": 3})):
            model = ML.fit_staged(same, C.LABEL_COLS[0], kind, params, [5])[5]
            assert sum(len(p.stages[-1].trees) for p, _ in model.parts) == 1
            if kind == "rf" and value == 0:
                assert set(scores(model, val)) == {0.0}


def test_grid_scores_every_point_and_picks_the_first_best(data):
    train, val, _ = data
    grid = ML.grid_search(train, val, "rf", {"numTrees": [3, 5], "maxDepth": [2, 4], "minInstancesPerNode": [1, 20]})
    assert [tuple(p["params"].values()) for p in grid.points] == [(n, d, m) for n in (3, 5) for d in (2, 4) for m in (1, 20)]
    for point, bundle in zip(grid.points, grid.bundles, strict=True):
        again = EV.metrics(EV.to_long(ML.predict_bundle(bundle, val, prefix=""), [])).collect()
        assert point["f2"] == {r["threat"]: r["f2"] for r in again}
        assert point["mean_f2"] == pytest.approx(sum(point["f2"].values()) / 3)
    top = max(p["mean_f2"] for p in grid.points)
    assert grid.best == next(i for i, p in enumerate(grid.points) if p["mean_f2"] == top)
    assert ML.Grid([{"mean_f2": 0.1}, {"mean_f2": 0.7}, {"mean_f2": 0.7}], []).best == 1


def test_bound_keeps_the_same_rows_in_every_run(data):
    train, _, _ = data
    kept = [[r["n"] for r in ML.bounded(train.repartition(k), 50).collect()] for k in (1, 7)]
    assert kept[0] == kept[1] and len(kept[0]) == 50
    assert ML.bounded(train, 10**6).count() == train.count()


def test_positive_weights(spark):
    long = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("a", 0), ("b", 0)], "threat string, y int")
    assert {r[0]: r[1] for r in ML.positive_weights(long).collect()} == {"a": 3.0, "b": 1.0}


def test_stored_scorer_gives_the_same_calibrated_clipped_probabilities(spark, data):
    train, val, med = data
    bundle = ML.fit_bundle(train, "rf", {"numTrees": 4, "maxDepth": 4})
    cal = ML.platt(EV.to_long(ML.predict_bundle(bundle, val, prefix=""), []))
    cal[C.THREATS[2]] = ("temperature", 2.0)
    scorer = ML.Scorer(bundle, med, cal)
    path = fresh_base(spark, "scorer-test")
    scorer.save(spark, path)
    bare = val.drop(*ML.IMPUTED)
    want = scorer.score(bare).orderBy("n").select(*C.PROB_COLS).collect()
    assert ML.Scorer.load(spark, path).score(bare).orderBy("n").select(*C.PROB_COLS).collect() == want
    raw = ML.predict_bundle(bundle, val, prefix="").orderBy("n").select(*C.PROB_COLS).collect()
    for w, r in zip(want, raw, strict=True):
        for k, t in enumerate(C.THREATS):
            p, c = r[k], cal[t]
            q = min(max(p, 1e-7), 1 - 1e-7)
            z = c[1] + c[2] * p if c[0] == "platt" else math.log(q / (1 - q)) / c[1]
            assert w[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and 0 <= w[k] <= 1


def test_temperature_is_the_lowest_loss(spark):
    rng = random.Random(4)
    rows = [("fire", int(rng.random() < p), min(max(p, 1e-6), 1 - 1e-6)) for p in (rng.betavariate(0.5, 0.5) for _ in range(300))]
    t = ML.temperature(spark.createDataFrame(rows, "threat string, y int, p double")).first()["T"]

    def loss(temp):
        out = 0.0
        for _, y, p in rows:
            q = 1 / (1 + math.exp(-math.log(p / (1 - p)) / temp))
            out -= math.log(q if y else 1 - q)
        return out

    assert loss(t) <= min(loss(0.1 + 0.01 * k) for k in range(991)) + 1e-3


def test_isotonic_is_monotone_and_within_bounds(spark):
    rng = random.Random(5)
    rows = [(t, int(rng.random() < p * p), p) for t in C.THREATS for p in (rng.random() for _ in range(200))]
    long = spark.createDataFrame(rows, "threat string, y int, p double")
    got = ML.apply_isotonic(long, ML.isotonic(long)).collect()
    for t in C.THREATS:
        own = sorted((r["p"], r["p_cal"]) for r in got if r["threat"] == t)
        assert all(a[1] <= b[1] + 1e-12 and 0 <= a[1] <= 1 for a, b in zip(own, own[1:], strict=False))


PARAMS = {"numTrees": 5, "maxDepth": 5, "minInstancesPerNode": 1}


def test_each_threat_empties_its_own_pool_like_a_plain_loop(spark, data, monkeypatch):
    """Models that depend on the labelled rows but not on their order, so that every round can be compared."""
    train, _, med = data
    pool = ML.impute(frame(spark, 150, 3, labelled=False), med).coalesce(1).cache()

    def fit(df, label, kind, params):
        return {"k": C.LABEL_COLS.index(label), "n": df.count(), "pos": df.where(F.col(label) == 1).count()}

    def predict(m, df, out):
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(ML.IMPUTED[m["k"]]) + m["pos"] / m["n"] - 0.5) * (m["n"] / 300 + m["k"] / 2))))

    monkeypatch.setattr(ML, "fit_classifier", fit)
    monkeypatch.setattr(ML, "predict", predict)
    bundle, sizes = ML.self_train_per_threat(train, pool, rounds=4, gate=0.85)
    got = {(r["threat"], r["round"]): (r["added"], r["left"]) for r in sizes.collect()}
    want = {}
    for t, label in zip(C.THREATS, C.LABEL_COLS, strict=True):
        labelled = [r[label] for r in train.collect()]
        left = [r[ML.IMPUTED[C.THREATS.index(t)]] for r in pool.collect()]
        for k in range(1, 6):
            m = {"k": C.THREATS.index(t), "n": len(labelled), "pos": sum(labelled)}
            if k == 5:
                break
            p = [1 / (1 + math.exp(-(x + m["pos"] / m["n"] - 0.5) * (m["n"] / 300 + m["k"] / 2))) for x in left]
            sure = [max(v, 1 - v) > 0.85 for v in p]
            if not any(sure):
                break
            labelled += [int(v > 0.5) for v, s in zip(p, sure, strict=True) if s]
            left = [x for x, s in zip(left, sure, strict=True) if not s]
            want[t, k] = (sum(sure), len(left))
        assert bundle[t] == m
    assert got == want and len({k for _, k in want}) > 1


def test_forests_train_on_their_own_pools(spark, data):
    train, val, med = data
    pool = ML.impute(frame(spark, 150, 3, labelled=False), med).coalesce(1).cache()
    bundle, sizes = ML.self_train_per_threat(train, pool, "rf", PARAMS, gate=0.8, rounds=2)
    first = {t: ML.predict(ML.fit_classifier(train, lab, "rf", PARAMS), pool, "p").where("greatest(p, 1 - p) > 0.8").count()
             for t, lab in zip(C.THREATS, C.LABEL_COLS, strict=True)}
    assert {r["threat"]: r["added"] for r in sizes.where("round = 1").collect()} == {t: n for t, n in first.items() if n}
    assert len(set(first.values())) > 1 and all(0 <= p <= 1 for t in C.THREATS for p in scores(bundle[t], val))


def test_shared_pool_moves_rows_sure_in_every_threat(spark, data):
    train, _, med = data
    pool = ML.impute(frame(spark, 150, 3, labelled=False), med).coalesce(1).cache()
    first = ML.predict_bundle(ML.fit_bundle(train, "rf", PARAMS), pool, prefix="")
    sure = first.where(" and ".join(f"greatest({p}, 1 - {p}) > 0.8" for p in C.PROB_COLS)).count()
    _, history = ML.self_train(train, pool, "rf", PARAMS, gate=0.8, rounds=2)
    assert sure > 0 and history[0] == {"round": 1, "added": sure} and len(history) <= 2
    none, empty = ML.self_train(train, pool.limit(0), "rf", PARAMS)
    assert empty == [] and set(none) == set(C.THREATS)
