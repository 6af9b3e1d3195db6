import math
from fractions import Fraction

import numpy as np
import pytest

from veldt.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int, component long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 2, 3) for i, v in rows], SCHEMA)


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T, np.sort(values)[::-1]


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, 5.0, 5.0], [0.0, 0.0, 1.0], [0.0] * 4, list(range(1, 40)), [1e-9, 1.0, 1e9], [2.0] * 10 + [3.0] * 10,
    [1 + 1e-13 * k for k in range(8)], [1.0] * 63 + [150.0], list(np.random.default_rng(5).gamma(3, size=100)), [-3.0, -1.0, 0.0, 1.0, 3.0]])
def test_divide_and_conquer_gives_eigenpairs(values):
    v, want = spectrum(values)
    got, q = W.eigen((v + v.T) / 2)
    size, norm = len(values), max(np.abs(want).max(), 1e-300)
    assert np.abs(q.T @ q - np.eye(size)).max() < 1e-13 * size
    assert np.abs(got - want).max() <= 1e-14 * size * norm + 1e-300
    assert np.abs(v @ q - q * got).max() <= 2e-14 * size * norm + 1e-300


def test_polar_factor_is_the_sign():
    v, _ = spectrum([-5.0, -1e-8, 1e-7, 2.0, 9.0])
    u = W.polar(v)
    e, q = np.linalg.eigh(v)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-6
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13


def plainly(rows, components):
    """(rows as integers, n, deviations, covariance) with exact fractions."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) and abs(64 * c) < 2**62 for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [1000000] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(width)]
    dev = [sum((n * x[d] - s[d])**2 for d in range(width)) for _, x in kept]
    mean = [Fraction(t, n) for t in s]
    v = [[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(width)] for a in range(width)]
    return kept, n, dev, mean, np.array(v)


def compare(spark, rows, components):
    kept, n, dev, mean, v = plainly(rows, components)
    got = W.whiten(frame(spark, rows), components=components).collect()
    m = min(components, len(v))
    assert len(got) == m * len(kept)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    real = [k for k in range(m) if e[k] > 1e-9 * max(e[0], 1e-300)]
    want = {}
    for (i, x), d in zip(kept, dev, strict=True):
        w = np.array([float(a - b) for a, b in zip(x, mean, strict=True)]) @ q
        want.setdefault((i, d), []).append([abs(w[k]) / math.sqrt(e[k]) if k in real else None for k in range(m)])
    have = {}
    for r in got:
        assert r["n"] == n and 1 <= r["component"] <= m
        if e.sum() > 0:
            assert abs(r["explained"] - max(e[r["component"] - 1], 0) / e.sum()) < 1e-12
        have.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], None if r["whitened"] is None else abs(r["whitened"])))
        assert r["identity_error"] is None if not real else r["identity_error"] < 1e-9
    assert set(have) == set(want)
    for key, vectors in want.items():
        for k in range(m):
            a = sorted((w[k] is None, w[k] or 0) for w in vectors)
            b = sorted((w is None, w or 0) for c, w in have[key] if c == k + 1)
            assert [x[0] for x in a] == [x[0] for x in b]
            assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-8)
    return got


def test_messy_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [1, 2, 3, 4, 5]]) for i in range(80)]
    rows += [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (104, [1e30] * 5),
             (105, []), (106, [0.5]), (None, [3.0, 1.0, 0.0, 0.0, 0.0]), (None, [3.0, 1.0, 0.0, 0.0, 0.0]), (5, rows[5][1]), (7, rows[5][1])]
    compare(spark, rows, 3)


def test_few_distinct_vectors_and_none(spark):
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in compare(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 16))
    assert [r["whitened"] is None for r in sorted(compare(spark, [(1, [1.0, 2.0]), (2, [4.0, 9.0])], 16), key=lambda r: (r["vec_id"], r["component"]))] == \
        [False, True, False, True]
    for rows in ([], [(1, None)], [(1, [])]):
        assert W.whiten(frame(spark, rows)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0**40 * (i % 5), -2.0**38 * (i % 3) + i]) for i in range(20)]
    got = W.whiten(frame(spark, rows), components=2).collect()
    kept, n, dev, _, _ = plainly(rows, 2)
    assert {r["deviation"] for r in got} == {d if d < 2**63 else None for d in dev} and got[0]["n"] == n
    assert got[0]["identity_error"] < 1e-9
