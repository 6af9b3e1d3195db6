"""Cases behind repaired operators: each fails when the rule is turned off."""
import itertools
import random

from pyspark.sql import functions as F

from veldt.functions import scalar as S
from veldt.operators import allocate as A
from veldt.operators import evaluate as EV
from veldt.operators import merge as M
from veldt.sources import files as FS
from veldt.streaming import daily as D


def test_threat_without_onset_keeps_its_row(spark):
    long = spark.createDataFrame([("e", d, t, y, p) for d, (t, y, p) in enumerate(
        [("fire", 0, .9), ("fire", 0, .1), ("fire", 1, .9), ("drought", 0, .2), ("drought", 0, .3)])],
        "entity string, day int, threat string, y int, p double")
    got = {r["threat"]: (r["lead_time_days"], r["n_onsets"]) for r in EV.lead_time(long).collect()}
    assert got == {"fire": (2.0, 1), "drought": (None, 0)}


def test_reliability_edge_scores_fall_into_the_lower_bin(spark):
    scores = [0.0, 0.05, 0.1, 0.5, 0.50001, 0.9, 1.0]
    long = spark.createDataFrame([("t", 1, p) for p in scores], "threat string, y int, p double")
    got = {r["bin"]: r["n"] for r in EV.reliability(long).collect()}
    assert got == {0: 3, 4: 1, 5: 1, 8: 1, 9: 1}


def test_duplicates_keep_an_explicit_row(spark):
    new = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 3.0), ("a", 1, None), ("b", 1, None)], "entity string, day int, v double")
    old = spark.createDataFrame([("b", 1, 0.0)], "entity string, day int, v double")
    assert [tuple(r) for r in M.insert_if_absent(old, new.repartition(3), ["entity", "day"]).collect()] == [("a", 1, 3.0)]


def test_payload_counts(spark):
    body = ["latitude,x\n1\n2\n", "<html>\nlatitude\n", "", "LATITUDE,x", "\nlatitude\r\n1"]
    df = spark.createDataFrame([(b,) for b in body], "value string")
    assert [r[0] for r in df.select(FS.payload_count(F.col("value"))).collect()] == [2, None, None, 0, 1]


def test_title_case(spark):
    df = spark.createDataFrame([("fire_within_30d",), ("urgent_plan",)], "c string")
    assert [r[0] for r in df.select(S.snake_to_title(F.col("c"))).collect()] == ["Fire Within 30d", "Urgent Plan"]


def test_missing_store_is_empty_and_other_errors_are_raised(spark, tmp_path):
    assert D._read_or_empty(spark, str(tmp_path / "none"), D.MEASURE_SCHEMA).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    try:
        D._read_or_empty(spark, str(bad), D.MEASURE_SCHEMA).count()
    except Exception:
        return
    raise AssertionError("a broken store was read as empty")


def _catalog(rng, n):
    kinds = ["patrol", "water", "vegetation", "community"]
    return [(f"i{q}", f"I{q}", kinds[q % 4], float(rng.randrange(3, 30) * 100), rng.randrange(1, 4),
             round(rng.random() * .2, 2), round(rng.random() * .2, 2), round(rng.random() * .2, 2)) for q in range(n)]


def test_plans_against_enumeration(spark):
    rng = random.Random(2)
    rows = _catalog(rng, 6)
    scen = [(f"s{k}", float(rng.randrange(0, 9000)), rng.random(), rng.random(), rng.random(),
             float(rng.choice([0, 500, 2500])), 0.0, float(rng.choice([0, 800])), rng.choice([[], ["water"]]), rng.choice([{}, {"patrol": 1}]))
            for k in range(12)]
    df = spark.createDataFrame(scen, "scenario_id string, budget double, p_fire double, p_drought double, p_veg double, floor_fire double, "
                                     "floor_drought double, floor_vegetation double, disabled_types array<string>, type_caps map<string,int>")
    got = {r["scenario_id"]: r for r in A.solve(df, A.catalog_df(spark, rows)).collect()}
    for sid, budget, pf, pd, pv, ff, _, fv, off, caps in scen:
        best = None
        for u in itertools.product(*[range((0 if r[2] in off else r[4]) + 1) for r in rows]):
            cost = sum(a * r[3] for a, r in zip(u, rows, strict=True))
            spend = [sum(a * r[3] for a, r in zip(u, rows, strict=True) if r[c] > 0) for c in (5, 6, 7)]
            kinds = {k: sum(a for a, r in zip(u, rows, strict=True) if r[2] == k) for k in caps}
            able = [any(r[c] > 0 and r[2] not in off for r in rows) for c in (5, 7)]
            if cost > budget or any(kinds[k] > caps[k] for k in caps) or able[0] and spend[0] < ff or able[1] and spend[2] < fv:
                continue
            lin = [sum(r[c] * a for a, r in zip(u, rows, strict=True)) for c in (5, 6, 7)]
            key = (int((pf * lin[0] + pd * lin[1] + pv * lin[2]) * 1e9 + .5), -cost, u)
            best = max(best, key) if best else key
        assert got[sid]["status"] == ("Optimal" if best else "Infeasible"), sid
        assert tuple(got[sid]["units"]) == (best[2] if best else (0,) * 6), sid


def test_thirty_items_have_a_plan(spark):
    rows = _catalog(random.Random(4), 30)
    df = spark.createDataFrame([("s", 8000.0, .7, .5, .3)], "scenario_id string, budget double, p_fire double, p_drought double, p_veg double")
    r = A.solve(df, A.catalog_df(spark, rows)).collect()[0]
    assert r["status"] == "Optimal" and len(r["units"]) == 30 and 0 < sum(u * i[3] for u, i in zip(r["units"], rows, strict=True)) <= 8000
