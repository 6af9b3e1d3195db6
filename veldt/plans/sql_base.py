"""DuckDB-dialect CTEs used by the SQL oracles.

These restate the panel, labels, features and deterministic forecasts in
plain SQL, independently of the DataFrame code, so each registered query can
be checked against DuckDB on the same parquet tables.  ``with_base(body)``
prepends the CTE chain to a query body that may reference ``panel``,
``labelled``, ``feat`` (all panel rows, with ``rn``), ``featured`` (warm-up
dropped, with ``split``) and ``fc`` (forecasts).
"""

PANEL = """
o AS (
  SELECT c_nationkey AS entity_id, CAST(o_orderdate AS DATE) AS day, o_totalprice tp,
         o_orderpriority pr, c_acctbal ab
  FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT min(day) lo, max(day) hi FROM o),
ents AS (SELECT n_name AS entity, n_nationkey AS entity_id, r_name AS ecosystem, r_regionkey AS ecosystem_id
         FROM nation JOIN region ON n_regionkey = r_regionkey),
spine AS (SELECT e.*, CAST(g.d AS DATE) AS day
          FROM ents e, b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) g(d)),
a AS (SELECT entity_id, day,
        sum(CAST(round(tp * 100) AS BIGINT)) AS precip_units,
        CAST(sum(CAST(round(ab * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 25000.0) AS temp_max,
        0.3 + CAST(sum(CASE WHEN pr IN ('5-LOW','4-NOT SPECIFIED') THEN CAST(round(tp * 100) AS BIGINT) END) AS DOUBLE)
            / nullif(CAST(count(CASE WHEN pr IN ('5-LOW','4-NOT SPECIFIED') THEN 1 END) AS DOUBLE) * 1.6e8, 0.0) AS ndvi,
        CAST(count(CASE WHEN pr='1-URGENT' AND tp>400000 THEN 1 END) AS INTEGER) AS firms_count,
        CAST(sum(CASE WHEN pr='1-URGENT' AND tp>400000 THEN CAST(round(tp * 100) AS BIGINT) END) AS DOUBLE)
            / nullif(CAST(count(CASE WHEN pr='1-URGENT' AND tp>400000 THEN 1 END) AS DOUBLE) * 100.0, 0.0) AS firms_frp_mean
      FROM o GROUP BY entity_id, day),
panel AS (
  SELECT s.entity, s.entity_id, s.ecosystem, s.ecosystem_id, s.day,
         CAST(a.precip_units AS BIGINT) AS precip_units, CAST(a.precip_units AS DOUBLE) / 1e6 AS precipitation,
         a.temp_max, CAST(floor(a.ndvi * 1e9 + 0.5) AS BIGINT) AS ndvi_units,
         CAST(floor(a.ndvi * 1e9 + 0.5) AS DOUBLE) / 1e9 AS ndvi,
         CAST(coalesce(a.firms_count, 0) AS INTEGER) AS firms_count, a.firms_frp_mean
  FROM spine s LEFT JOIN a ON s.entity_id = a.entity_id AND s.day = a.day)"""

LABELLED = """
lab0 AS (
  SELECT p.*,
    CAST(sum(precip_units) OVER (PARTITION BY entity, month(day)) AS DOUBLE) * 30.0
      / (CAST(count(precip_units) OVER (PARTITION BY entity, month(day)) AS DOUBLE) * 1e6) AS d_exp,
    CASE WHEN count(precip_units) OVER w30 >= 15 THEN CAST(sum(precip_units) OVER w30 AS DOUBLE) / 1e6 END AS d_act,
    last_value(ndvi_units IGNORE NULLS) OVER w8 AS nfu
  FROM panel p
  WINDOW w30 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
         w8 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
lab1 AS (
  SELECT *,
    coalesce(d_act / nullif(d_exp, 0.0) < 0.4 AND month(day) NOT IN (11,12,1,2,3), false) AS drought_flag,
    CASE WHEN count(nfu) OVER w90 >= 30
         THEN CAST(sum(nfu) OVER w90 AS DOUBLE) / (CAST(count(nfu) OVER w90 AS DOUBLE) * 1e9) END AS avg90
  FROM lab0 WINDOW w90 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
lab2 AS (SELECT *, CAST(coalesce(CAST(nfu AS DOUBLE) / 1e9 - avg90 < -0.1, false) AS DOUBLE) AS below FROM lab1),
lab3 AS (
  SELECT *,
    coalesce(count(*) OVER w14 >= 7 AND sum(below) OVER w14 >= 5.0, false) AS veg_flag,
    coalesce(firms_count > 0, false) AS fire_flag
  FROM lab2 WINDOW w14 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
labelled AS (
  SELECT entity, entity_id, ecosystem, ecosystem_id, day, precip_units, precipitation, temp_max, ndvi, ndvi_units,
    firms_count,
    firms_frp_mean,
    CASE WHEN count(*) OVER wf = 30 THEN CAST(max(CAST(fire_flag AS INTEGER)) OVER wf AS INTEGER) END AS fire_within_30d,
    CASE WHEN count(*) OVER wf = 30 THEN CAST(max(CAST(drought_flag AS INTEGER)) OVER wf AS INTEGER) END AS drought_within_30d,
    CASE WHEN count(*) OVER wf = 30 THEN CAST(max(CAST(veg_flag AS INTEGER)) OVER wf AS INTEGER) END AS vegetation_within_30d
  FROM lab3 WINDOW wf AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))"""

FEATURES = """
f0 AS (
  SELECT l.*, CAST(coalesce(precip_units, 0) AS BIGINT) AS p0,
    last_value(ndvi_units IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
      AS ndvi_fu,
    CAST(coalesce(firms_count, 0) AS DOUBLE) AS fire0,
    CAST(coalesce(temp_max > 35.0, false) AS DOUBLE) AS hot
  FROM labelled l),
f1 AS (
  SELECT *,
    CAST(sum(p0) OVER (PARTITION BY entity, month(day)) AS DOUBLE) * 30.0
      / (CAST(count(p0) OVER (PARTITION BY entity, month(day)) AS DOUBLE) * 1e6) AS expected_30d,
    CASE WHEN count(p0) OVER w7 >= 4 THEN CAST(sum(p0) OVER w7 AS DOUBLE) / 1e6 END AS rain_7d,
    CASE WHEN count(p0) OVER w30 >= 15 THEN CAST(sum(p0) OVER w30 AS DOUBLE) / 1e6 END AS rain_30d,
    CASE WHEN count(p0) OVER w60 >= 30 THEN CAST(sum(p0) OVER w60 AS DOUBLE) / 1e6 END AS rain_60d,
    CASE WHEN count(temp_max) OVER w7 >= 4 THEN avg(temp_max) OVER w7 END AS temp_max_7d,
    CASE WHEN count(temp_max) OVER w30 >= 15 THEN avg(temp_max) OVER w30 END AS temp_max_30d,
    CASE WHEN count(hot) OVER w30 >= 15 THEN sum(hot) OVER w30 END AS hot_days_30d,
    CAST(ndvi_fu IS NULL AS INTEGER) AS ndvi_missing,
    CAST(ndvi_fu AS DOUBLE) / 1e9 AS ndvi_f,
    CAST(lag(ndvi_fu, 30) OVER wo AS DOUBLE) / 1e9 AS ndvi_30d_lag,
    CASE WHEN count(ndvi_fu) OVER w90 >= 30
         THEN CAST(sum(ndvi_fu) OVER w90 AS DOUBLE) / (CAST(count(ndvi_fu) OVER w90 AS DOUBLE) * 1e9) END AS ndvi_90d_avg,
    CASE WHEN count(fire0) OVER w30 >= 15 THEN sum(fire0) OVER w30 END AS fire_30d,
    CASE WHEN count(fire0) OVER w90 >= 45 THEN sum(fire0) OVER w90 END AS fire_90d,
    sum(fire0) OVER w90 AS fire_90d_plain,
    CAST(least(coalesce(date_diff('day', max(CASE WHEN fire0 > 0 THEN day END) OVER wu, day), 365), 365) AS DOUBLE)
      AS days_since_fire,
    row_number() OVER wo AS rn
  FROM f0
  WINDOW wo AS (PARTITION BY entity ORDER BY day),
         wu AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w7 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
         w60 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
         w90 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
feat AS (
  SELECT entity, entity_id, ecosystem, ecosystem_id, day, precipitation, temp_max, firms_count, firms_frp_mean,
    rain_7d, rain_30d, rain_60d, rain_30d - expected_30d AS rain_deficit_30d, expected_30d,
    temp_max_7d, temp_max_30d, hot_days_30d,
    ndvi_f AS ndvi, ndvi_30d_lag, ndvi_f - ndvi_30d_lag AS ndvi_change_30d, ndvi_90d_avg,
    ndvi_f - ndvi_90d_avg AS ndvi_deviation,
    fire_30d, fire_90d, fire_90d_plain, days_since_fire,
    sin(2 * pi() * CAST(dayofyear(day) AS DOUBLE) / 365.25) AS doy_sin,
    cos(2 * pi() * CAST(dayofyear(day) AS DOUBLE) / 365.25) AS doy_cos,
    CAST(month(day) IN (11,12,1,2,3) AS INTEGER) AS dry_season,
    CAST(entity_id AS INTEGER) AS park_id, CAST(ecosystem_id AS INTEGER) AS ecosystem_id2,
    fire_within_30d, drought_within_30d, vegetation_within_30d, ndvi_missing, rn
  FROM f1),
featured AS (
  SELECT * EXCLUDE (ecosystem_id2),
    CASE WHEN day <= DATE '1999-06-30' THEN 'train'
         WHEN day >= DATE '1999-07-01' AND day <= DATE '1999-12-31' THEN 'val'
         WHEN day >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS split
  FROM feat WHERE rn > 60),
fc AS (
  SELECT entity, entity_id, ecosystem, day,
    coalesce(least(1.0, fire_90d_plain / 5.0), 0.0) AS fire_prob,
    coalesce(greatest(0.0, least(1.0, 1.0 - rain_30d / nullif(expected_30d, 0.0))), 0.0) AS drought_prob,
    coalesce(1.0 / (1.0 + exp(30.0 * coalesce(ndvi_deviation, 0.0))), 0.0) AS veg_prob,
    fire_within_30d, drought_within_30d, vegetation_within_30d, ndvi_missing,
    rain_7d, rain_30d, rain_60d, rain_deficit_30d, temp_max_7d, temp_max_30d, hot_days_30d,
    ndvi, ndvi_30d_lag, ndvi_change_30d, ndvi_90d_avg, ndvi_deviation, fire_30d, fire_90d,
    days_since_fire, doy_sin, doy_cos, dry_season, park_id, rn AS row_idx
  FROM feat),
ev AS (
  SELECT entity, day, threat, y, p FROM (
    SELECT entity, day, 'fire' AS threat, fire_within_30d AS y, fire_prob AS p FROM fc
      WHERE row_idx > 60 AND day >= DATE '2000-01-01' AND ndvi_missing = 0
    UNION ALL SELECT entity, day, 'drought', drought_within_30d, drought_prob FROM fc
      WHERE row_idx > 60 AND day >= DATE '2000-01-01' AND ndvi_missing = 0
    UNION ALL SELECT entity, day, 'vegetation', vegetation_within_30d, veg_prob FROM fc
      WHERE row_idx > 60 AND day >= DATE '2000-01-01' AND ndvi_missing = 0)
  WHERE y IS NOT NULL)"""


def with_base(body: str, upto: str = "fc", extra: str = "") -> str:
    """``WITH <base CTEs up to upto>[, extra CTEs] body``."""
    parts = [PANEL]
    if upto in ("labelled", "feat", "featured", "fc"):
        parts.append(LABELLED)
    if upto in ("feat", "featured", "fc"):
        parts.append(FEATURES)
    if extra.strip():
        parts.append(extra.strip().lstrip(","))
    return "WITH " + ",".join(parts) + "\n" + body
