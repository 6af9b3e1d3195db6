"""Student's p against exact sums, co-moments against NumPy."""
from decimal import Decimal, getcontext

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt import config as C
from veldt.functions import scalar as S
from veldt.operators import quality as Q

getcontext().prec = 80


def exact_even(t: float, v: int) -> Decimal:
    """Two-sided p for even v: one minus the finite series, in 80 digits."""
    t2 = Decimal(t) * Decimal(t)
    c2, term, total = Decimal(v) / (v + t2), Decimal(1), Decimal(1)
    for i in range(1, (v - 2) // 2 + 1):
        term *= c2 * Decimal(2 * i - 1) / Decimal(2 * i)
        total += term
    return 1 - (t2 / (v + t2)).sqrt() * total


CASES = [(t, v) for v in (2, 4, 10, 28, 100, 1000, 20000) for t in (1e-6, 0.01, 0.5, 1.0, 1.96, 2.5, 5.0, 12.0, 35.0)]


def test_p_of_t_is_exact(spark):
    got = spark.createDataFrame([(float(t), v) for t, v in CASES], "t double, v int").select("t", "v", S.student_t_p(F.col("t"), F.col("v")).alias("p")).collect()
    for r in got:
        want = exact_even(r["t"], r["v"])
        assert r["p"] == pytest.approx(float(want), abs=1e-12, rel=1e-9 if want > Decimal("1e-60") else 1), (r, want)


def test_p_for_few_degrees_signs_and_nulls(spark):
    rows = [(1.0, 1), (-1.0, 1), (0.0, 7), (None, 5), (2.0, None), (2.048407141795244, 28), (-12.706204736174707, 1), (1e200, 3), (0.7, 1_000_000)]
    got = [r[0] for r in spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(rows)], "k int, t double, v int")
           .orderBy("k").select(S.student_t_p(F.col("t"), F.col("v"))).collect()]
    assert got[:2] == pytest.approx([0.5, 0.5], abs=1e-14) and got[2] == 1.0 and got[3] is got[4] is None
    assert got[5:7] == pytest.approx([0.05, 0.05], abs=1e-12) and got[7] == pytest.approx(0.0, abs=1e-300)
    assert got[8] == pytest.approx(math.erfc(0.7 / math.sqrt(2)), abs=1e-6)


def test_co_moments_and_matrix(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        x = rng.gauss(1e6, 2)
        rows.append((x, 3 * x + rng.gauss(0, 1), None if i % 3 else rng.random(), 0.1, float("nan") if i % 5 == 0 else -x, None))
    cols = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    m = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for parts in (1, 7):
        got = {(r["feature_a"], r["feature_b"]): (r["r"], r["n"]) for r in Q.correlation_matrix(df.repartition(parts), cols).collect()}
        assert len(got) == 36
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                ok = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
                assert got[a, b][1] == ok.sum()
                if "d" in (a, b) or "f" in (a, b):
                    assert got[a, b][0] is None
                else:
                    assert got[a, b][0] == pytest.approx(np.corrcoef(m[ok, i], m[ok, j])[0, 1], abs=1e-9)
    assert {(r["feature_a"], r["feature_b"]) for r in Q.correlation_pairs(df, cols).collect()} == {("a", "b"), ("a", "e"), ("b", "e")}
    assert Q.correlation_matrix(df.limit(0), cols).where("r is not null or n > 0").count() == 0


def test_point_biserial_needs_thirty_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.random(), *[int(rng.random() < 0.5) if i < n else None for n in (29, 30, 100)]) for i in range(100)]
    got = Q.point_biserial(spark.createDataFrame(rows, "x double, " + ", ".join(f"{c} int" for c in C.LABEL_COLS)), ["x"]).collect()
    assert {r["label"]: (r["n"], r["r"] is None, r["p_value"] is None) for r in got} == {
        C.LABEL_COLS[0]: (29, True, True), C.LABEL_COLS[1]: (30, False, False), C.LABEL_COLS[2]: (100, False, False)}
