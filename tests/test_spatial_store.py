"""Rectangle overlap against all pairs, polygons against plain loops, uniqueness of the keyed store."""
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from veldt.operators import spatial as SP
from veldt.operators import store as ST
from veldt.streaming.daily import fresh_base

A, B = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")


def boxes(rng, n, extent):
    out = []
    for i in range(n):
        x, y = (round(rng.uniform(-20, 20), 1) for _ in "xy")
        out.append((i, x, y, round(x + rng.choice([0, 0.5, extent]), 1), round(y + rng.choice([0, 0.3, extent]), 1)))
    return out


@pytest.mark.parametrize("size", [0.7, 5.0, 100.0])
def test_overlapping_pairs_are_found_once(spark, size):
    rng = random.Random(8)
    a, b = boxes(rng, 120, 7.0), boxes(rng, 150, 2.0)
    b += [(900, None, 0.0, 1.0, 1.0), (901, 3.0, 0.0, 1.0, 1.0), (902, 0.0, 0.0, 0.0, 0.0), (903, 0.0, 0.0, 0.0, 0.0)]
    fa = spark.createDataFrame(a, "ia int, ax0 double, ay0 double, ax1 double, ay1 double")
    fb = spark.createDataFrame(b, "ib int, bx0 double, by0 double, bx1 double, by1 double")
    got = sorted((r["ia"], r["ib"]) for r in SP.overlap_join(fa, A, fb, B, size).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if None not in y and y[1] <= y[3] and x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert got == want and len(want) > 100
    keyed = SP.overlap_join(fa.withColumn("k", F.col("ia") % 3), A, fb.withColumn("k", F.col("ib") % 3), B, size, on=("k",))
    assert sorted((r["ia"], r["ib"]) for r in keyed.collect()) == [p for p in want if p[0] % 3 == p[1] % 3]
    assert SP.overlap_join(fa.limit(0), A, fb, B, size).count() == 0


def test_cell_size(spark):
    f = spark.createDataFrame([(0.0, 0.0, 4.0, 1.0), (0.0, 0.0, 2.0, 9.0)], "x0 double, y0 double, x1 double, y1 double")
    assert SP.cell_size(f, ("x0", "y0", "x1", "y1")) == 5.0
    assert SP.cell_size(f, ("x0", "y0", "x0", "y0")) == SP.cell_size(f.limit(0), ("x0", "y0", "x1", "y1")) == 1.0


def centre(ring):
    area = sx = sy = 0.0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        c = x0 * y1 - x1 * y0
        area, sx, sy = area + c / 2, sx + (x0 + x1) * c, sy + (y0 + y1) * c
    if abs(area) < 1e-9:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    return sx / (6 * area), sy / (6 * area)


def test_features_of_both_types_and_broken_ones(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [0.5, 1], [1, 1], [1, 0.5], [0.5, 0.5]]
    star = [[5, 0], [6, 1], [7, 0], [6, 3], [6.5, 4], [5, 2], [5, 0]]
    flat = [[1, 1], [2, 2], [3, 3], [2, 2], [1.5, 1.5], [1, 1]]
    shapes = {"poly": ("Polygon", [square, hole]), "multi": ("MultiPolygon", [[square, hole], [star]]), "tie": ("MultiPolygon", [[square], [hole]]),
              "flat": ("MultiPolygon", [[square], [flat]]), "point": ("Point", [1, 2]), "none": ("Polygon", [])}
    features = [{"type": "Feature", "properties": {"name": k}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in shapes.items()]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    f = SP.read_features(spark, str(tmp_path)).select(F.col("properties")["name"].alias("name"), "geom_type", "polygons")
    got = {r["name"]: r["c"] for r in f.where("size(polygons) > 0").select("name", SP.ring_centre(SP.main_ring(F.col("polygons"))).alias("c")).collect()}
    for name, ring in (("poly", square), ("multi", star), ("tie", square), ("flat", flat)):
        assert (got[name]["lon"], got[name]["lat"]) == pytest.approx(centre(ring))
    assert {r["name"] for r in f.where("polygons is null").collect()} == {"point"}
    ring = {(r["name"], r["polygon_no"], r["ring_no"]): (r["n_vertices"], r["area"], r["ring"]) for r in SP.rings(f, ["name"]).collect()}
    assert ring["poly", 0, 0] == (5, 4.0, square) and ring["poly", 0, 1] == (5, -0.25, hole)
    assert ring["multi", 1, 0][0] == 7 and len([k for k in ring if k[0] == "multi"]) == 3


def test_centre_of_a_circle_ring_is_its_centre(spark):
    from veldt.operators.relational import circle_ring
    r = spark.range(1).select(circle_ring(F.lit(8.6), F.lit(9.0), F.lit(2244.0)).alias("ring"))
    c = r.select(SP.ring_centre(F.col("ring")).alias("c"), F.size("ring").alias("n"), F.col("ring")[0].alias("a"), F.col("ring")[48].alias("b")).first()
    assert (c["c"]["lon"], c["c"]["lat"]) == (pytest.approx(8.6, abs=1e-5), pytest.approx(9.0, abs=1e-5)) and c["n"] == 49 and c["a"] == c["b"]


def rows(spark, values):
    return spark.createDataFrame([(f"r{i}", e, "s", None, None, None, datetime.datetime(2024, 1, d)) for i, e, d in values], ST.HEADER)


def test_store_keeps_keys_unique_and_history_is_newest_first(spark):
    held, _ = ST.recommendation_stores(spark, fresh_base(spark, "store-test"))
    assert held.read().count() == 0
    held.write(rows(spark, [(1, "a", 3), (2, "a", 5), (3, "b", 1)]), 0)
    held.write(rows(spark, [(2, "a", 9), (4, "a", 4), (4, "a", 4), (5, "c", 2)]), 1)
    before = sorted(held.read().collect(), key=str)
    assert [(r["recommendation_id"], r["created_at"].day) for r in before] == [("r1", 3), ("r2", 5), ("r3", 1), ("r4", 4), ("r5", 2)]
    held.write(rows(spark, [(2, "a", 9), (4, "a", 4), (4, "a", 4), (5, "c", 2)]), 1)  # repeated after a loss
    assert sorted(held.read().collect(), key=str) == before
    spark.createDataFrame([("r1", "s", None, None, None, datetime.datetime(2024, 1, 30), "a", 7)],
                          "recommendation_id string, scenario_id string, budget decimal(12,2), total_cost decimal(12,2), "
                          "total_risk_reduction decimal(8,6), created_at timestamp_ntz, entity string, version long") \
        .write.mode("append").partitionBy("entity", "version").parquet(held.path)  # a writer that saw nothing
    assert sorted(held.read().collect(), key=str) == before
    assert [(r["entity"], r["place"], r["recommendation_id"]) for r in ST.history(held, 2).orderBy("entity", "place").collect()] == \
        [("a", 1, "r2"), ("a", 2, "r4"), ("b", 1, "r3"), ("c", 1, "r5")]
    for bad in (0, 101):
        with pytest.raises(ValueError, match="between 1 and 100"):
            ST.history(held, bad)
