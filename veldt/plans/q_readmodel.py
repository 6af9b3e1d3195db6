"""Registered queries: read model over forecasts and the serving profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import readmodel as R
from veldt.operators import serving as SV
from veldt.plans import panels
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base

PROBS = "fire_prob, drought_prob, veg_prob"


def _fc(spark, sf):
    return panels.forecasts(spark, sf)


def _serve(spark, sf):
    return SV.serve_features(panels.raw_panel(spark, sf))


@query("e19_latest_per_entity", sql=with_base(f"""
SELECT entity, day, {PROBS} FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fc) WHERE rn = 1"""))
def e19_latest_per_entity(spark, sf):
    """Latest forecast per entity: grouped top-1 pruned by WindowGroupLimit."""
    return R.latest_per_entity(_fc(spark, sf)).select("entity", "day", *C.PROB_COLS)


@query("e20_recent_n", sql=with_base(f"""
SELECT entity, day, {PROBS}, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS recency FROM fc) WHERE recency <= 30"""))
def e20_recent_n(spark, sf):
    """Most recent 30 forecasts per entity (limit newest-first, then any order)."""
    return R.recent_n(_fc(spark, sf), 30).select("entity", "day", *C.PROB_COLS, "recency")


_WEEK_AGO_SQL = """
lt AS (SELECT entity, max(day) AS latest FROM fc GROUP BY entity),
cand AS (
  SELECT f.*, abs(date_diff('day', lt.latest - 7, f.day)) AS diff
  FROM fc f JOIN lt ON f.entity = lt.entity
  WHERE f.day <> lt.latest AND abs(date_diff('day', lt.latest - 7, f.day)) <= 4),
wa AS (
  SELECT entity, day AS wa_day, fire_prob AS wa_fire_prob, drought_prob AS wa_drought_prob, veg_prob AS wa_veg_prob
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY diff, day) AS rn FROM cand) WHERE rn = 1),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fc) WHERE rn = 1),
wow AS (
  SELECT l.entity, l.day, l.fire_prob, l.drought_prob, l.veg_prob, wa.wa_day,
    wa.wa_fire_prob, wa.wa_drought_prob, wa.wa_veg_prob,
    CAST(floor((l.fire_prob - coalesce(wa.wa_fire_prob, l.fire_prob)) * 100.0 + 0.5) AS BIGINT) AS dp_fire_prob,
    CAST(floor((l.drought_prob - coalesce(wa.wa_drought_prob, l.drought_prob)) * 100.0 + 0.5) AS BIGINT)
      AS dp_drought_prob,
    CAST(floor((l.veg_prob - coalesce(wa.wa_veg_prob, l.veg_prob)) * 100.0 + 0.5) AS BIGINT) AS dp_veg_prob
  FROM latest l LEFT JOIN wa ON l.entity = wa.entity)"""


@query("c08_nearest_week_ago", sql=with_base(
    "SELECT entity, wa_day, wa_fire_prob, wa_drought_prob, wa_veg_prob FROM wa", extra=_WEEK_AGO_SQL))
def c08_nearest_week_ago(spark, sf):
    """Row nearest to latest - 7 days within 4 days, latest excluded, earliest wins ties."""
    return R.week_ago(_fc(spark, sf))


@query("e22_week_over_week", sql=with_base("SELECT * EXCLUDE (rn_dummy) FROM (SELECT *, 0 AS rn_dummy FROM wow)",
                                            extra=_WEEK_AGO_SQL))
def e22_week_over_week(spark, sf):
    """Week-over-week delta in points per threat, JS half-up rounding."""
    return R.week_over_week(_fc(spark, sf)).select(
        "entity", "day", *C.PROB_COLS, "wa_day", "wa_fire_prob", "wa_drought_prob", "wa_veg_prob",
        "dp_fire_prob", "dp_drought_prob", "dp_veg_prob")


_ALERT_SQL = """
dom AS (
  SELECT *,
    CASE WHEN veg_prob > greatest(fire_prob, drought_prob) THEN 'Vegetation'
         WHEN drought_prob > fire_prob THEN 'Drought' ELSE 'Fire' END AS top_threat
  FROM wow),
al AS (
  SELECT entity, day, top_threat,
    CASE top_threat WHEN 'Fire' THEN fire_prob WHEN 'Drought' THEN drought_prob ELSE veg_prob END AS top_prob,
    CASE WHEN wa_day IS NULL THEN 0 ELSE CAST(floor((
      CASE top_threat WHEN 'Fire' THEN fire_prob - wa_fire_prob WHEN 'Drought' THEN drought_prob - wa_drought_prob
           ELSE veg_prob - wa_veg_prob END) * 100.0 + 0.5) AS BIGINT) END AS delta_pts
  FROM dom)"""


@query("h15_alerts", sql=with_base("""
SELECT entity, day, top_threat, top_prob, delta_pts,
  CASE WHEN top_prob >= 0.66 THEN 'high' WHEN delta_pts >= 5 AND top_prob >= 0.4 THEN 'medium' END AS alert_level,
  CASE WHEN top_prob >= 0.66 THEN top_threat || ' is the top threat at '
            || CAST(CAST(floor(top_prob * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '% (high'
            || CASE WHEN delta_pts <= -2 THEN ', though easing this week'
                    WHEN delta_pts >= 2 THEN ' and still rising' ELSE '' END || ').'
       WHEN delta_pts >= 5 AND top_prob >= 0.4 THEN top_threat || ' risk has climbed '
            || CAST(delta_pts AS VARCHAR) || ' pts this week to '
            || CAST(CAST(floor(top_prob * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%.' END AS message
FROM al""", extra=_WEEK_AGO_SQL + "," + _ALERT_SQL))
def h15_alerts(spark, sf):
    """Operational alert text per entity: high, or climbing >= 5 points this week."""
    return R.alerts(R.week_over_week(_fc(spark, sf)))


@query("d05_national_trend", sql=with_base("""
SELECT day, avg(fire_prob) AS fire, avg(drought_prob) AS drought, avg(veg_prob) AS veg
FROM fc WHERE day >= (SELECT max(day) FROM fc) - 59 GROUP BY day"""))
def d05_national_trend(spark, sf):
    """Cross-entity daily average per threat over the last 60 dates."""
    return R.national_trend(_fc(spark, sf), 60)


@query("d20_overview", sql=with_base("""
SELECT n_entities, high_count, avg_fire, avg_drought, avg_veg,
  CASE WHEN avg_veg > greatest(avg_fire, avg_drought) THEN 'Vegetation'
       WHEN avg_drought > avg_fire THEN 'Drought' ELSE 'Fire' END AS dominant_threat,
  top_entity, spike_entity, spike_threat, spike_prob, latest_date
FROM agg, top, spike""", extra="""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fc)
           WHERE rn = 1),
sp AS (
  SELECT entity, entity_id, 'Fire' AS threat, fire_prob AS v, 0 AS ti FROM latest
  UNION ALL SELECT entity, entity_id, 'Drought', drought_prob, 1 FROM latest
  UNION ALL SELECT entity, entity_id, 'Vegetation', veg_prob, 2 FROM latest),
spike AS (SELECT entity AS spike_entity, threat AS spike_threat, v AS spike_prob
          FROM sp ORDER BY v DESC, entity_id, ti LIMIT 1),
top AS (SELECT entity AS top_entity FROM latest
        ORDER BY greatest(fire_prob, drought_prob, veg_prob) DESC, entity_id LIMIT 1),
agg AS (SELECT count(*) AS n_entities,
          count(*) FILTER (WHERE greatest(fire_prob, drought_prob, veg_prob) >= 0.66) AS high_count,
          avg(fire_prob) AS avg_fire, avg(drought_prob) AS avg_drought, avg(veg_prob) AS avg_veg,
          max(day) AS latest_date FROM latest)"""))
def d20_overview(spark, sf):
    """High-risk count, threat means, dominant threat, top entity and top spike."""
    return R.overview(R.latest_per_entity(_fc(spark, sf)))


@query("e21_entity_ranking", sql=with_base("""
SELECT entity, max_risk, dominant_threat, row_number() OVER (ORDER BY max_risk DESC, entity_id) AS priority FROM (
  SELECT entity, entity_id, greatest(fire_prob, drought_prob, veg_prob) AS max_risk,
    CASE WHEN veg_prob > greatest(fire_prob, drought_prob) THEN 'Vegetation'
         WHEN drought_prob > fire_prob THEN 'Drought' ELSE 'Fire' END AS dominant_threat
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fc) WHERE rn = 1)"""))
def e21_entity_ranking(spark, sf):
    """Entities ranked by their highest threat with a distributed global row number."""
    return R.entity_ranking(R.latest_per_entity(_fc(spark, sf))).select(
        "entity", "max_risk", "dominant_threat", "priority")


@query("e21_threat_ranking", sql=with_base("""
SELECT entity, day, threat, prob,
  row_number() OVER (PARTITION BY entity, day ORDER BY prob DESC, ti) AS rank,
  CASE WHEN prob >= 0.66 THEN 'High' WHEN prob >= 0.33 THEN 'Medium' ELSE 'Low' END AS band,
  CAST(floor(coalesce(prob, 0.0) * 100.0 + 0.5) AS BIGINT) AS pct
FROM (SELECT entity, day, 'Fire' AS threat, 0 AS ti, fire_prob AS prob FROM fc
      UNION ALL SELECT entity, day, 'Drought', 1, drought_prob FROM fc
      UNION ALL SELECT entity, day, 'Vegetation', 2, veg_prob FROM fc)"""))
def e21_threat_ranking(spark, sf):
    """Threats ranked within every forecast row, with risk band (H4) and percent (H5)."""
    return R.threat_ranking(_fc(spark, sf)).select("entity", "day", "threat", "prob", "rank", "band", "pct")


# ---------------------------------------------------------------- serving profile

_SERVE_SQL = """
hist AS (
  SELECT t.entity, t.entity_id, t.ecosystem_id, t.day AS target, h.day, h.precip_units, h.temp_max, h.ndvi_units,
         h.firms_count
  FROM panel t JOIN panel h ON h.entity = t.entity AND h.day BETWEEN t.day - 90 AND t.day),
hf AS (
  SELECT *, CAST(date_diff('day', day, target) AS INTEGER) AS back,
    last_value(ndvi_units IGNORE NULLS) OVER (PARTITION BY entity, target ORDER BY day
                                              ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS nfu
  FROM hist),
sv AS (
  SELECT entity, target AS day, count(*) AS history_rows,
    CAST(sum(CASE WHEN back < 7 THEN coalesce(precip_units, 0) END) AS DOUBLE) / 1e6 AS rain_7d,
    CAST(sum(CASE WHEN back < 30 THEN coalesce(precip_units, 0) END) AS DOUBLE) / 1e6 AS rain_30d,
    CAST(sum(CASE WHEN back < 60 THEN coalesce(precip_units, 0) END) AS DOUBLE) / 1e6 AS rain_60d,
    CAST(sum(CASE WHEN month(day) = month(target) THEN coalesce(precip_units, 0) END) AS DOUBLE) * 30.0
      / (CAST(count(CASE WHEN month(day) = month(target) THEN 1 END) AS DOUBLE) * 1e6) AS exp30,
    avg(CASE WHEN back < 7 THEN temp_max END) AS temp_max_7d,
    avg(CASE WHEN back < 30 THEN temp_max END) AS temp_max_30d,
    CAST(sum(CASE WHEN back < 30 THEN CASE WHEN temp_max > 35.0 THEN 1 ELSE 0 END END) AS DOUBLE) AS hot_days_30d,
    coalesce(CAST(max(CASE WHEN back = 0 THEN nfu END) AS DOUBLE) / 1e9, 0.0) AS ndvi,
    CAST(max(CASE WHEN back = 30 THEN nfu END) AS DOUBLE) / 1e9 AS lag30,
    CAST(sum(CASE WHEN back < 90 THEN nfu END) AS DOUBLE)
      / (CAST(count(CASE WHEN back < 90 THEN nfu END) AS DOUBLE) * 1e9) AS ndvi_90d_avg,
    CAST(sum(CASE WHEN back < 30 THEN coalesce(firms_count, 0) END) AS DOUBLE) AS fire_30d,
    CAST(sum(CASE WHEN back < 90 THEN coalesce(firms_count, 0) END) AS DOUBLE) AS fire_90d,
    CAST(coalesce(least(min(CASE WHEN firms_count > 0 THEN back END), 365), 365) AS DOUBLE) AS days_since_fire,
    any_value(entity_id) AS entity_id, any_value(ecosystem_id) AS ecosystem_id
  FROM hf GROUP BY entity, target),
serve AS (
  SELECT entity, day, history_rows, rain_7d, rain_30d, rain_60d, rain_30d - exp30 AS rain_deficit_30d,
    temp_max_7d, temp_max_30d, hot_days_30d, ndvi, coalesce(lag30, ndvi) AS ndvi_30d_lag,
    ndvi - coalesce(lag30, ndvi) AS ndvi_change_30d, ndvi_90d_avg, ndvi - ndvi_90d_avg AS ndvi_deviation,
    fire_30d, fire_90d, days_since_fire,
    sin(2 * pi() * CAST(dayofyear(day) AS DOUBLE) / 365.25) AS doy_sin,
    cos(2 * pi() * CAST(dayofyear(day) AS DOUBLE) / 365.25) AS doy_cos,
    CAST(month(day) IN (11,12,1,2,3) AS DOUBLE) AS dry_season,
    CAST(entity_id AS DOUBLE) AS park_id, CAST(ecosystem_id AS DOUBLE) AS ecosystem_id
  FROM sv)"""


def serve_sql(body: str, extra: str = "") -> str:
    return with_base(body, upto="panel", extra=_SERVE_SQL + ("," + extra if extra else ""))


@query("e13_serving_features", sql=serve_sql(
    "SELECT entity, day, history_rows, " + ", ".join(C.FEATURE_COLS) + " FROM serve"))
def e13_serving_features(spark, sf):
    """Serving-profile features for every entity-day from its [d-90, d] history."""
    return SV.serve_vector(_serve(spark, sf)).select("entity", "day", "history_rows", *C.FEATURE_COLS)


@query("b15_history_guard", sql=serve_sql(
    "SELECT entity, count(*) AS n_servable, min(day) AS first_servable FROM serve WHERE history_rows >= 45 "
    "GROUP BY entity"))
def b15_history_guard(spark, sf):
    """Days per entity with >= 45 rows of history in [d-90, d]."""
    return (SV.history_guard(_serve(spark, sf)).groupBy("entity")
            .agg(F.count(F.lit(1)).alias("n_servable"), F.min("day").alias("first_servable")))


@query("b15_backfill_guard", sql=serve_sql(
    "SELECT entity, count(*) AS n_backfillable, min(day) AS first_backfillable FROM serve WHERE history_rows >= 7 GROUP BY entity"))
def b15_backfill_guard(spark, sf):
    """Days per entity with the 7 rows of history that a backfill asks for."""
    return (SV.history_guard(_serve(spark, sf), C.BACKFILL_MIN_ROWS).groupBy("entity")
            .agg(F.count(F.lit(1)).alias("n_backfillable"), F.min("day").alias("first_backfillable")))


@query("c06_history_interval_join", sql=with_base("""
SELECT t.entity, t.day AS target_day, count(*) AS n_rows, min(h.day) AS first_day,
  CAST(sum(coalesce(h.precip_units, 0)) AS DOUBLE) / 1e6 AS rain_total, sum(h.firms_count) AS fire_total
FROM panel t JOIN panel h ON h.entity = t.entity AND h.day BETWEEN t.day - 90 AND t.day
GROUP BY t.entity, t.day""", upto="panel"))
def c06_history_interval_join(spark, sf):
    """90-day history of every target day via a binned range join."""
    p = panels.raw_panel(spark, sf)
    targets = p.select("entity", F.col("day").alias("target_day"))
    j = SV.interval_join(p.select("entity", "day", "precip_units", "firms_count"), targets, 90)
    return j.groupBy("entity", "target_day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"),
        (F.sum(F.coalesce("precip_units", F.lit(0))).cast("double") / F.lit(1e6)).alias("rain_total"),
        F.sum("firms_count").alias("fire_total"))


@query("c07_asof_lookback", sql=with_base("""
SELECT entity, day, ndvi,
  last_value(ndvi IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day
                                      RANGE BETWEEN INTERVAL 16 DAY PRECEDING AND CURRENT ROW) AS ndvi_asof
FROM panel""", upto="panel"))
def c07_asof_lookback(spark, sf):
    """Last non-NULL NDVI within 16 calendar days (C7, late-data fill I4)."""
    return SV.asof_lookback(panels.raw_panel(spark, sf), "ndvi").select("entity", "day", "ndvi", "ndvi_asof")


def spec_df(spark):
    rows = [(t, i % 4, f, lab, u, d, C.DRIVER_THRESHOLDS.get(f)) for i, (t, f, lab, u, d) in enumerate(C.DRIVER_SPECS)]
    return spark.createDataFrame(rows, "threat string, position int, feature string, label string, unit string, "
                                       "direction string, threshold double")


_SPEC_VALUES = ", ".join(
    "('{}', {}, '{}', '{}', '{}', '{}', {})".format(t, i % 4, f, lab, u, d,
                                                    "NULL" if f not in C.DRIVER_THRESHOLDS
                                                    else repr(float(C.DRIVER_THRESHOLDS[f])))
    for i, (t, f, lab, u, d) in enumerate(C.DRIVER_SPECS))


@query("j25_drivers", sql=serve_sql("""
SELECT entity, day, threat, position, label,
  CASE WHEN value IS NULL AND unit <> 'bool' THEN 'nan'
       WHEN unit = 'mm' THEN printf('%.1f mm', value)
       WHEN unit = 'degC' THEN printf('%.1f °C', value)
       WHEN unit = 'days' THEN printf('%d days', CAST(trunc(value) AS BIGINT))
       WHEN unit = 'ndvi' THEN printf('%.2f', value)
       WHEN unit = 'bool' THEN CASE WHEN value >= 0.5 THEN 'Yes' ELSE 'No' END
       ELSE printf('%.2f', value) END AS value_text,
  CASE WHEN coalesce(CASE direction WHEN 'bool' THEN value >= 0.5 WHEN 'lowval' THEN value < 0
                                   WHEN 'low' THEN value < coalesce(threshold, 0.0)
                                   WHEN 'high' THEN value > coalesce(threshold, 0.0) ELSE false END, false)
       THEN 'raises' ELSE 'lowers' END AS impact
FROM lng JOIN spec USING (feature)""", extra="""
spec AS (SELECT * FROM (VALUES """ + _SPEC_VALUES + """) s(threat, position, feature, label, unit, direction, threshold)),
lat AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn
                                     FROM serve) WHERE rn = 1),
lng AS (UNPIVOT lat ON """ + ", ".join(C.FEATURE_COLS) + """ INTO NAME feature VALUE value)"""))
def j25_drivers(spark, sf):
    """Four drivers per threat for each entity's latest day: unit-formatted values and raise/lower impact."""
    latest = R.latest_per_entity(SV.serve_vector(_serve(spark, sf)))
    return R.drivers(latest, spec_df(spark))
