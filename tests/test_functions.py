"""Distributed helpers against NumPy on small frames."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.functions.ranking import exact_quantiles, global_row_number


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=301), 2)            # ties included
    rows = [("a", float(v)) for v in vals] + [("b", float(v)) for v in vals[:40]]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.025, 0.5, 0.975):
        got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", q).collect()}
        assert got["a"] == pytest.approx(np.percentile(vals, 100 * q))
        assert got["b"] == pytest.approx(np.percentile(vals[:40], 100 * q))


def test_global_row_number_is_a_permutation(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.col("id"))
    out = global_row_number(df, [F.col("x").desc(), F.col("id")], out="rn", partitions=7).collect()
    rns = sorted(r["rn"] for r in out)
    assert rns == list(range(1, 5001))
    by = sorted(out, key=lambda r: r["rn"])
    assert all(by[i]["x"] >= by[i + 1]["x"] for i in range(len(by) - 1))
