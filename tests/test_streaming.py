"""Streams: equal to batch with late, duplicate and replayed files; the watermark acts."""
import pytest
from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import ml as ML
from veldt.operators import serving as SV
from veldt.plans import panels
from veldt.sources import tables
from veldt.streaming import daily as D

SF = "/root/testdata/sf0.001"
KEYS = ["entity", "day"]


@pytest.fixture(scope="module")
def raw(spark):
    return panels.raw_panel(spark, SF).where("day < '1996-01-01'").cache()


def land(raw, base):
    late = F.dayofmonth("day") == 13
    D.land(raw.where(~late), f"{base}/landing", files=6)
    D.land(raw.where(~late & (F.month("day") == 3)).withColumn("firms_count", F.col("firms_count") + 5), f"{base}/landing", files=2)
    D.land(raw.where(late), f"{base}/landing", files=2)


def scorer(spark, raw):
    rows = SV.serve_vector(SV.serve_features(raw)).withColumn("n", F.xxhash64(*KEYS))
    for k, c in enumerate(C.LABEL_COLS):
        rows = rows.withColumn(c, (F.col("rain_30d") + F.pmod("n", F.lit(7 + k)) > 9 + k).cast("int"))
    med = {c: 0.5 for c in C.FEATURE_COLS}
    bundle = ML.fit_bundle(ML.bounded(ML.impute(rows, med), 300), "rf", {"numTrees": 3, "maxDepth": 4})
    return ML.Scorer(bundle, med, {"fire": ("platt", -1.0, 3.0), "drought": ("temperature", 2.0)})


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_stream_equals_batch_also_after_a_killed_batch(spark, raw, monkeypatch):
    base, model = D.fresh_base(spark, "test-stream"), scorer(spark, raw)
    land(raw, base)
    write, calls = D._write, []

    def killed(df, at, name, batch_id):
        write(df, at, name, batch_id)
        calls.append((name, batch_id))
        if (name, batch_id) == ("features", 1):
            raise RuntimeError("executor lost")

    monkeypatch.setattr(D, "_write", killed)
    with pytest.raises(Exception, match="executor lost"):
        D.daily_stream(spark, f"{base}/landing", base, max_files=3, scorer=model)
    assert calls[-1] == ("features", 1)
    committed = D.current(spark, base, "features").count()  # nothing of the killed batch is read
    monkeypatch.setattr(D, "_write", write)
    D.daily_stream(spark, f"{base}/landing", base, max_files=3, scorer=model)
    batch = SV.serve_vector(SV.serve_features(raw))
    assert 0 < committed < batch.count()
    got = D.current(spark, base, "features").select(*KEYS, "history_rows", *C.FEATURE_COLS)
    assert same(got, batch.select(*got.columns))
    store = spark.read.parquet(f"{base}/store")
    assert store.count() == store.select(*KEYS).distinct().count() == raw.count()
    want = model.score(batch.where("history_rows >= 45")).select(*KEYS, *C.PROB_COLS)
    assert same(D.current(spark, base, "forecasts").select(*want.columns), want)


def counts(spark, watermark):
    base = D.fresh_base(spark, "test-events")
    D.land_events(tables.read(spark, SF, "events"), f"{base}/landing")
    got = D.event_counts_stream(spark, f"{base}/landing", base, watermark=watermark)
    return D.event_counts(spark, got["out"]).agg(F.sum("n")).first()[0], got["landed"], got["dropped"]


def test_watermark_drops_late_rows_and_duplicates(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    counted, landed, dropped = counts(spark, "1 day")
    total = tables.read(spark, SF, "events").count()
    assert counted < total < landed and landed == counted + dropped
    assert counts(spark, "90 days")[0] == total  # a watermark that never acts lets late rows in
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert counts(spark, "1 day")[0] == counted and spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
