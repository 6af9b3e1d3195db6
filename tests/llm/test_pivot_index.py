import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import pivot_index as P

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int, qs int, seg long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def plainly(rows, k, asked):
    """Sorted (query_id, rank, vec_id, score); equal query rows answer once."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v)]
    out, seen = [], set()
    for a, (i, q) in enumerate(kept):
        width = max(len(v) for _, v in kept)
        same = (i, tuple(q + [0] * (width - len(q))))
        if i is None or not asked(i) or same in seen:
            continue
        seen.add(same)
        got = sorted(((-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0, j) for b, (j, v) in enumerate(kept) if b != a),
                     key=lambda t: t[:3])
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(got[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=10, by=100):
    got = P.exact_top_k(frame(spark, rows), F.pmod("vec_id", F.lit(by)) == 0, k=k)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_messy_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(-40, 80)]
    rows += [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [float("nan")] * 5), (200, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
             (300, []), (301, [0.5]), (None, [3.0, 1.0, 0.0, 0.0, 0.0]), (None, [3.0, 1.0, 0.0, 0.0, 0.0]), (400, [1e306, 0.0]),
             (500, [0.1] * 5), (500, [0.1] * 5), (500, [0.1] * 5), (500, [0.2] * 5), (10, [0.1] * 5), (9, [0.1] * 5)]
    assert searched(spark, rows, k=7, by=10) == plainly(rows, 7, lambda i: i % 10 == 0)


def test_small_tables(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(1, [1.0])]) == []
    assert searched(spark, [(100, [1.0])]) == []
    assert searched(spark, [(100, []), (1, [])]) == [(100, 1, 1, 0)]


def test_scores_beyond_doubles_are_exact_and_beyond_longs_refused(spark):
    big = [(100, [2.0**20, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 3.5]), (3, [-2.0**21, 1.0])]
    assert searched(spark, big) == plainly(big, 10, lambda i: i == 100)
    with pytest.raises(Exception, match="does not fit"):
        searched(spark, [(100, [1e9]), (1, [1e9])])


def test_far_apart():
    rows = np.array([[0.0], [0.1], [5.0], [-9.0], [5.0]])
    assert P.far_apart(rows, 3).ravel().tolist() == [0.0, -9.0, 5.0]
    assert len(P.far_apart(np.ones((5, 2)), 4)) == 1
    assert len(P.far_apart(np.zeros((0, 2)), 4)) == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-900, 900, (400, 6)).astype(float), rng.integers(-900, 900, (50, 6)).astype(float)
    pivots = P.far_apart(x[:100], 5)
    d = P.distances(x, pivots)
    near = d.argmin(axis=1)
    annuli, members = [], []
    for p in range(5):
        for part in np.array_split(np.flatnonzero(near == p)[np.argsort(d[near == p, p])], 3):
            if len(part):
                r = d[part, p]
                annuli.append({"annulus": p * P.MAX_RINGS + len(annuli), "low": r.min(), "high": r.max(), "pieces": 1,
                               "longest": np.sqrt((x[part] ** 2).sum(axis=1).max())})
                members.append(part)
    for n, a in enumerate(annuli):
        a["annulus"] = (a["annulus"] // P.MAX_RINGS) * P.MAX_RINGS + n
    bound = P.Directory(pivots, annuli).bounds(q)
    for j, part in enumerate(members):
        assert ((q @ x[part].T).max(axis=1) <= bound[:, j]).all()


def test_many_clusters_copies_and_annuli(spark, monkeypatch):
    """Small pieces, tiles and blocks; a third of the rows one vector; far annuli are never opened."""
    for name, value in (("PIECE", 16), ("SEGMENT", 2), ("QUERY_BLOCK", 8), ("QUERY_SLICE", 2), ("RING_ROWS", 20), ("GROW", 2)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 4)) * 3
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=4) * 0.05]) for i in range(600)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 1.0]) for i in range(300)]
    opened = []
    real = P._meet
    monkeypatch.setattr(P, "_meet", lambda pieces, blocks, pairs, *a: opened.append((pairs.count(), pieces.select("grp").distinct().count(), blocks.count()))
                        or real(pieces, blocks, pairs, *a))
    assert searched(spark, rows, k=10, by=20) == plainly(rows, 10, lambda i: i % 20 == 0)
    assert sum(p for p, _, _ in opened) < opened[0][1] * opened[0][2]
