"""Registered queries: streaming, incremental maintenance, backfill and repair (I, S3-S5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import merge as M
from veldt.operators import ml as ML
from veldt.operators import readmodel as R
from veldt.operators import serving as SV
from veldt.plans import panels
from veldt.plans.q_ml import picked
from veldt.plans.q_readmodel import serve_sql
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base
from veldt.sources import tables
from veldt.streaming import daily as D


def _land(spark, sf, base):
    """The whole panel as landed files, the 13th of each month later than the rest, and before that
    every March once more with other values, which a stored key must not take."""
    raw = panels.raw_panel(spark, sf)
    late = F.dayofmonth("day") == 13
    D.land(raw.where(~late), f"{base}/landing")
    D.land(raw.where(~late & (F.month("day") == 3)).withColumn("precip_units", F.col("precip_units") + 10_000_000)
              .withColumn("firms_count", F.col("firms_count") + 9), f"{base}/landing", files=4)
    D.land(raw.where(late), f"{base}/landing", files=4)


@query("i01_stream_features", sql=serve_sql(
    "SELECT entity, day, history_rows, " + ", ".join(C.FEATURE_COLS) + " FROM serve"))
def i01_stream_features(spark, sf):
    """Landed daily files, duplicates and late ones among them -> availableNow micro-batches -> store and
    versioned serving features; 90-day trailing state read per batch; equals the batch serving profile (I1, I2, I3, I5)."""
    base = D.fresh_base(spark, "daily-stream")
    _land(spark, sf, base)
    D.daily_stream(spark, f"{base}/landing", base, max_files=6)
    return D.current(spark, base, "features").select("entity", "day", "history_rows", *C.FEATURE_COLS)


@query("i01_stream_forecasts", sql=serve_sql(
    f"SELECT entity, count(*) AS n_forecasts, count(*) AS n_equal_to_batch FROM serve WHERE history_rows >= {C.SERVE_MIN_ROWS} GROUP BY entity"))
def i01_stream_forecasts(spark, sf):
    """The same stream with the stored, calibrated forest in each micro-batch: forecasts per entity and how
    many of them equal the batch scoring of that day (I1, J11, B15)."""
    scorer = ML.Scorer.load(spark, picked(spark, sf, "rf")[0])
    base = D.fresh_base(spark, "daily-scores")
    _land(spark, sf, base)
    D.daily_stream(spark, f"{base}/landing", base, max_files=6, scorer=scorer)
    serve = SV.serve_vector(SV.serve_features(panels.raw_panel(spark, sf))).where(F.col("history_rows") >= C.SERVE_MIN_ROWS)
    batch = scorer.score(serve).select("entity", "day", *[F.col(p).alias(f"b_{p}") for p in C.PROB_COLS])
    j = D.current(spark, base, "forecasts").join(batch, ["entity", "day"], "left")
    same = reduce(lambda a, b: a & b, [F.abs(F.col(p) - F.col(f"b_{p}")) < 1e-12 for p in C.PROB_COLS])
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n_forecasts"), F.count_if(same).alias("n_equal_to_batch"))


def _late_free(sql):
    """``events`` as the stream counts them: without those that come behind the watermark."""
    return sql.replace("FROM events", """FROM (SELECT * FROM events, (SELECT CAST(min(ts) AS DATE) AS d0,
  date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) // 3 + 1 AS files FROM events)
  WHERE NOT (event_id % 40 = 7 AND date_diff('day', d0, CAST(ts AS DATE)) // 3 + 4 < files)) AS events""")


def _counts(spark, sf, **how):
    base = D.fresh_base(spark, "event-stream")
    D.land_events(tables.read(spark, sf, "events"), f"{base}/landing")
    return D.event_counts_stream(spark, f"{base}/landing", base, **how)


@query("i09_event_counts", sql=_late_free("""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
  count(*) AS n FROM events GROUP BY ALL"""))
def i09_event_counts(spark, sf):
    """Event-time daily counts per event type over ten arriving files: duplicates counted once, events
    behind the watermark not at all (I3, I9)."""
    return D.event_counts(spark, _counts(spark, sf)["out"])


@query("i09_sliding_counts", sql=_late_free("""
SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n
FROM events, LATERAL (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts),
                                                     INTERVAL 1 DAY)) AS w)
GROUP BY ALL"""))
def i09_sliding_counts(spark, sf):
    """Sliding 7-day windows every day over the same files (event time, watermark 2 days)."""
    return D.event_counts(spark, _counts(spark, sf, watermark="2 days", window="7 days", slide="1 day")["out"])


@query("i03_dropped_rows", sql="""
WITH e AS (SELECT event_id, date_diff('day', d0, CAST(ts AS DATE)) // 3 AS c, files FROM events, (SELECT CAST(min(ts) AS DATE) AS d0,
    date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) // 3 + 1 AS files FROM events)),
f AS (SELECT event_id % 40 = 7 AND c + 4 < files AS late, event_id % 10 = 3 AND NOT (event_id % 40 = 7 AND c + 4 < files) AND c + 1 < files AS twice FROM e)
SELECT count(*) + count(*) FILTER (twice) AS landed, count(*) FILTER (late) + count(*) FILTER (twice) AS dropped,
  count(*) FILTER (NOT late) AS counted FROM f""")
def i03_dropped_rows(spark, sf):
    """Rows landed, dropped (behind the watermark or seen before) and counted by the event stream."""
    got = _counts(spark, sf)
    return D.event_counts(spark, got["out"]).agg(F.lit(got["landed"]).cast("bigint").alias("landed"),
                                                 F.lit(got["dropped"]).cast("bigint").alias("dropped"), F.sum("n").alias("counted"))


_GAP = ("2001-03-01", "2001-03-31")


@query("i05_gap_repair", sql=serve_sql(
    "SELECT entity, day, " + ", ".join(C.FEATURE_COLS) + f", CASE WHEN day BETWEEN DATE '{_GAP[0]}' "
    f"AND DATE '{_GAP[1]}' THEN 1 ELSE 0 END AS version FROM serve"))
def i05_gap_repair(spark, sf):
    """Recompute one date range from [start-90, end] history in ONE batch, upsert over the stale stored rows (I5, S4);
    the whole table comes back."""
    p = panels.raw_panel(spark, sf)
    lo, hi = F.lit(_GAP[0]).cast("date"), F.lit(_GAP[1]).cast("date")
    stored = SV.serve_vector(SV.serve_features(p)).withColumn("version", F.lit(0))
    for c in ("rain_30d", "fire_90d"):  # stale values inside the range, which the repair must overwrite
        stored = stored.withColumn(c, F.when(F.col("day").between(lo, hi), F.lit(-1.0)).otherwise(F.col(c)))
    hist = p.where(F.col("day").between(F.date_sub(lo, C.SERVE_HISTORY_DAYS), hi))
    repaired = SV.serve_vector(SV.serve_features(hist)).where(F.col("day").between(lo, hi)).withColumn("version", F.lit(1))
    merged = M.upsert(stored.select("entity", "day", *C.FEATURE_COLS, "version"),
                      repaired.select("entity", "day", *C.FEATURE_COLS, "version"), ["entity", "day"], "version")
    return merged


@query("i07_backfill", sql=with_base("""
SELECT entity, count(*) AS n_inserted, min(day) AS first_day, max(day) AS last_day FROM fc
WHERE day >= (SELECT max(day) FROM fc) - 59 AND NOT (day(day) % 3 = 0) GROUP BY entity"""))
def i07_backfill(spark, sf):
    """Backfill the last 60 days anchored at the newest stored day, skipping existing rows."""
    fc = panels.forecasts(spark, sf).select("entity", "day", *C.PROB_COLS)
    newest = fc.select(F.max("day")).scalar()
    existing = fc.where(F.dayofmonth("day") % 3 == 0)
    wanted = fc.where(F.col("day") >= F.date_sub(newest, 59))
    ins = M.insert_if_absent(existing, wanted, ["entity", "day"])
    return ins.groupBy("entity").agg(F.count(F.lit(1)).alias("n_inserted"), F.min("day").alias("first_day"),
                                     F.max("day").alias("last_day"))


@query("s04_upsert", sql=with_base("""
SELECT entity, avg(fire_prob) AS avg_fire, count(*) AS n_rows, count(*) FILTER (WHERE version = 1) AS n_new FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY version DESC) AS r FROM (
    SELECT entity, day, fire_prob, 0 AS version FROM fc
    UNION ALL SELECT entity, day, fire_prob * fire_prob, 1 FROM fc WHERE day >= DATE '2001-07-01'))
WHERE r = 1 GROUP BY entity"""))
def s04_upsert(spark, sf):
    """Overwrite-on-match upsert by version."""
    fc = panels.forecasts(spark, sf).select("entity", "day", "fire_prob")
    old = fc.withColumn("version", F.lit(0))
    new = (fc.where(F.col("day") >= F.lit("2001-07-01").cast("date"))
             .withColumn("fire_prob", F.col("fire_prob") * F.col("fire_prob")).withColumn("version", F.lit(1)))
    u = M.upsert(old, new, ["entity", "day"], "version")
    return u.groupBy("entity").agg(F.avg("fire_prob").alias("avg_fire"), F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(F.col("version") == 1).alias("n_new"))


@query("s05_update_only", sql=with_base("""
SELECT e.entity, avg(coalesce(n.veg_prob, e.veg_prob)) AS avg_veg, count(*) AS n_rows,
  count(n.veg_prob) AS n_updated FROM fc e
LEFT JOIN (SELECT entity, day, veg_prob * 0.5 AS veg_prob FROM fc WHERE day >= DATE '2001-07-01' AND day(day) <= 15) n
  ON e.entity = n.entity AND e.day = n.day GROUP BY e.entity"""))
def s05_update_only(spark, sf):
    """Re-predict: matched rows take new values, others keep theirs, new-only rows ignored."""
    fc = panels.forecasts(spark, sf).select("entity", "day", "veg_prob")
    existing = fc
    new = (fc.where((F.col("day") >= F.lit("2001-07-01").cast("date")) & (F.dayofmonth("day") <= 15))
             .withColumn("veg_prob", F.col("veg_prob") * F.lit(0.5)))
    marked = new.withColumn("_m", F.lit(1))
    u = M.update_only(existing.join(marked.select("entity", "day", "_m"), ["entity", "day"], "left"),
                      new, ["entity", "day"], ["veg_prob"])
    return u.groupBy("entity").agg(F.avg("veg_prob").alias("avg_veg"), F.count(F.lit(1)).alias("n_rows"),
                                   F.count("_m").alias("n_updated"))


@query("i04_late_ndvi_fire_fallback", sql=with_base("""
SELECT entity, day, coalesce(ndvi, last_value(ndvi IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day
  RANGE BETWEEN INTERVAL 16 DAY PRECEDING AND CURRENT ROW)) AS ndvi_filled,
  coalesce(nrt, sp, 0) AS fire_count
FROM (SELECT *, CASE WHEN day(day) % 5 <> 0 THEN firms_count END AS nrt,
        CASE WHEN day(day) % 7 <> 0 THEN firms_count END AS sp FROM panel)""", upto="panel"))
def i04_late_ndvi_fire_fallback(spark, sf):
    """Late-data policy: NDVI from the last 16 days when today's is missing; fire from the first
    product that serves, else 0 (I4, C7, A6)."""
    p = panels.raw_panel(spark, sf)
    p = (p.withColumn("nrt", F.when(F.dayofmonth("day") % 5 != 0, F.col("firms_count")))
          .withColumn("sp", F.when(F.dayofmonth("day") % 7 != 0, F.col("firms_count"))))
    p = SV.asof_lookback(p, "ndvi", out="_asof")
    return p.select("entity", "day", F.coalesce("ndvi", "_asof").alias("ndvi_filled"),
                    F.coalesce("nrt", "sp", F.lit(0)).alias("fire_count"))


@query("i08_migrate_training_export", sql=with_base("""
SELECT entity, count(*) AS n_inserted, sum(precipitation) AS rain FROM panel
WHERE day > DATE '2000-12-31' GROUP BY entity""", upto="panel"))
def i08_migrate_training_export(spark, sf):
    """Migrate a training-named CSV export into the serving store in ONE append job:
    rename (B1), unparsable/sentinel -> NULL (B2), projection of existing columns (B6),
    insert-if-absent against rows already stored (I8, S3)."""
    from veldt.operators import relational as RL
    base = D.fresh_base(spark, "migrate")
    p = panels.raw_panel(spark, sf)
    export = p.select("entity", F.col("day").alias("date"),
                      F.coalesce(F.col("precipitation").cast("string"), F.lit("-999")).alias("om_precipitation_sum"),
                      F.coalesce(F.col("temp_max").cast("string"), F.lit("n/a")).alias("om_temperature_2m_max"))
    export.write.option("header", True).csv(f"{base}/export")
    raw = spark.read.schema("entity string, date string, om_precipitation_sum string, "
                            "om_temperature_2m_max string").option("header", True).csv(f"{base}/export")
    rename = {"date": "day", "om_precipitation_sum": "precipitation", "om_temperature_2m_max": "temp_max"}
    clean = raw.withColumnsRenamed(rename).withColumn("day", F.to_date("day"))
    for c in ("precipitation", "temp_max"):
        clean = clean.withColumn(c, F.nullif(F.expr(f"try_cast({c} AS double)"), F.lit(-999.0)))
    clean = RL.project_existing(clean, ["entity", "day", "precipitation", "temp_max", "ndvi"])
    stored = p.where(F.col("day") <= F.lit("2000-12-31").cast("date")).select("entity", "day")
    new = M.insert_if_absent(stored, clean, ["entity", "day"])
    return new.groupBy("entity").agg(F.count(F.lit(1)).alias("n_inserted"), F.sum("precipitation").alias("rain"))
