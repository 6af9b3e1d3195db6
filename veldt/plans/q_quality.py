"""Registered queries: data-quality profiles and label/feature statistics (D, S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import quality as Q
from veldt.plans import panels
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base

RAW_COLS = ["precipitation", "temp_max", "ndvi", "firms_count", "firms_frp_mean"]
MONTH_COLS = ["rain_30d", "temp_max_30d", "ndvi", "fire_30d"]
SUMMARY_COLS = ["rain_7d", "rain_30d", "rain_deficit_30d", "temp_max_7d", "hot_days_30d", "ndvi", "ndvi_deviation",
                "fire_30d", "days_since_fire"]
BOX_COLS = ["rain_7d", "rain_30d", "rain_deficit_30d", "temp_max_7d", "temp_max_30d", "hot_days_30d",
            "ndvi", "ndvi_30d_lag", "ndvi_change_30d", "ndvi_90d_avg", "ndvi_deviation"]
FEATURES = [c for c in C.FEATURE_COLS if c not in ("park_id", "ecosystem_id")]
CONTINUOUS = [c for c in FEATURES if c not in ("doy_sin", "doy_cos", "dry_season")]
CLEAN_SQL = "ndvi_missing = 0"
CLEAN_TRAIN_SQL = "split = 'train' AND ndvi_missing = 0"


def _clean(spark, sf):
    return panels.featured(spark, sf).where("ndvi_missing = 0")


def _clean_train(spark, sf):
    return _clean(spark, sf).where("split = 'train'")


def _xmean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(38,9))) AS DOUBLE) / count({c})"


def _corr(a: str, b: str, cond: str) -> str:
    return (f"covar_samp({a}, {b}) FILTER (WHERE {cond}) / nullif(stddev_samp({a}) FILTER (WHERE {cond}) * "
            f"stddev_samp({b}) FILTER (WHERE {cond}), 0.0)")


@query("d06_split_crosstab", sql=with_base("""
SELECT entity, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
  count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total
FROM featured GROUP BY ROLLUP (entity)""", upto="featured"))
def d06_split_crosstab(spark, sf):
    """Split x entity counts with totals via rollup."""
    return Q.split_crosstab(panels.featured(spark, sf))


@query("d07_test_positives", sql=with_base("""
SELECT entity, coalesce(sum(fire_within_30d), 0) AS fire_pos, coalesce(sum(fire_within_30d), 0) < 30 AS fire_low,
  coalesce(sum(drought_within_30d), 0) AS drought_pos, coalesce(sum(drought_within_30d), 0) < 30 AS drought_low,
  coalesce(sum(vegetation_within_30d), 0) AS vegetation_pos,
  coalesce(sum(vegetation_within_30d), 0) < 30 AS vegetation_low
FROM featured WHERE split = 'test' GROUP BY entity""", upto="featured"))
def d07_test_positives(spark, sf):
    """Test-split positives per entity and threat with the < 30 flag."""
    return Q.test_positives(panels.featured(spark, sf))


@query("d08_missing_fraction", sql=with_base(
    "SELECT column_name, missing_frac FROM (UNPIVOT (SELECT "
    + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in C.FEATURE_COLS)
    + " FROM featured) ON COLUMNS(*) INTO NAME column_name VALUE missing_frac) WHERE missing_frac > 0",
    upto="featured"))
def d08_missing_fraction(spark, sf):
    """Share of NULLs per feature column, > 0 only."""
    return Q.missing_fraction(panels.featured(spark, sf), C.FEATURE_COLS)


@query("d09_describe", sql=with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_pct FROM panel" for c in RAW_COLS),
    upto="panel"))
def d09_describe(spark, sf):
    """count/mean/std/min/max/missing% per raw measure."""
    return Q.describe(panels.raw_panel(spark, sf), RAW_COLS)


@query("d10_ndvi_coverage", sql=with_base(
    "SELECT entity, " + ", ".join(
        f"1.0 - avg(ndvi_missing) FILTER (WHERE month(day) = {m}) AS \"{m}\"" for m in range(1, 13))
    + ", 1.0 - avg(ndvi_missing) AS coverage FROM featured GROUP BY entity", upto="featured"))
def d10_ndvi_coverage(spark, sf):
    """NDVI availability per entity, overall and per month pivot."""
    return Q.ndvi_coverage(panels.featured(spark, sf))


@query("d11_monthly_seasonality", sql=with_base("""
SELECT CAST(month(day) AS INTEGER) AS month, avg(fire_within_30d) AS fire_rate, avg(drought_within_30d) AS drought_rate,
  avg(vegetation_within_30d) AS vegetation_rate FROM labelled GROUP BY month(day)""", upto="labelled"))
def d11_monthly_seasonality(spark, sf):
    """Month-of-year label rates pooled over entities."""
    return Q.monthly_seasonality(panels.labelled_panel(spark, sf))


@query("d12_month_entity_stats", sql=with_base(
    "SELECT entity, CAST(month(day) AS INTEGER) AS month, "
    + ", ".join(f"{_xmean(c)} AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in MONTH_COLS)
    + f" FROM featured WHERE {CLEAN_SQL} GROUP BY entity, month(day)", upto="featured"))
def d12_month_entity_stats(spark, sf):
    """Exact fixed-point mean and sample std per entity x month."""
    return Q.month_entity_stats(_clean(spark, sf), MONTH_COLS)


@query("d13_weekly_resample", sql=with_base("""
SELECT entity, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, avg(fire_within_30d) AS fire_rate,
  avg(drought_within_30d) AS drought_rate, avg(vegetation_within_30d) AS vegetation_rate
FROM labelled GROUP BY entity, CAST(date_trunc('week', day) AS DATE) + 6""", upto="labelled"))
def d13_weekly_resample(spark, sf):
    """Weekly (Mon-Sun, labelled by Sunday) label rates per entity."""
    return Q.weekly_resample(panels.labelled_panel(spark, sf))


@query("d14_ecosystem_summary", sql=with_base(
    "SELECT ecosystem, count(*) AS n_rows, "
    + ", ".join(f"coalesce(printf('%.2f', {_xmean(c)}), 'nan') || ' ± ' || coalesce(printf('%.2f', stddev_samp({c})), "
                f"'nan') AS {c}" for c in SUMMARY_COLS)
    + " FROM featured WHERE split = 'train' AND ndvi_missing = 0 GROUP BY ecosystem", upto="featured"))
def d14_ecosystem_summary(spark, sf):
    """'mean ± std' text per ecosystem on clean train rows."""
    return Q.ecosystem_summary(panels.featured(spark, sf), SUMMARY_COLS)


@query("d15_box_stats", sql=with_base("""
SELECT entity, feature, q[1] AS q1, q[2] AS median, q[3] AS q3,
  min(value) FILTER (WHERE value BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS whisker_lo,
  max(value) FILTER (WHERE value BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS whisker_hi,
  count(*) FILTER (WHERE NOT (value BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]))) AS n_outliers
FROM (SELECT l.*, qq.q FROM lng l JOIN (
        SELECT entity, feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM lng GROUP BY entity, feature) qq
      USING (entity, feature))
GROUP BY entity, feature, q""", upto="featured", extra=(
    "lng AS (SELECT * FROM (UNPIVOT (SELECT entity, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in BOX_COLS) + f" FROM featured WHERE {CLEAN_SQL}) ON "
    + ", ".join(BOX_COLS) + " INTO NAME feature VALUE value) WHERE value IS NOT NULL)")))
def d15_box_stats(spark, sf):
    """Quartiles and 1.5 IQR whiskers per entity x feature."""
    return Q.box_stats(_clean(spark, sf), BOX_COLS)


_PB_PAIRS = " UNION ALL ".join(
    f"SELECT '{lab}' AS label, '{c}' AS feature, "
    f"{_corr(c, f'CAST({lab} AS DOUBLE)', f'{c} IS NOT NULL AND {lab} IS NOT NULL')} AS r0, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND {lab} IS NOT NULL)"
    f" AS n FROM featured WHERE {CLEAN_TRAIN_SQL}" for lab in C.LABEL_COLS for c in FEATURES)


# the oracle's p: the finite trigonometric series of Student's distribution for whole degrees of freedom
_PB_CTES = """
pb AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(r) DESC NULLS LAST, feature) AS rank FROM (
  SELECT label, feature, n, r, r * sqrt((n - 2) / (1.0 - r * r)) AS t FROM (
    SELECT label, feature, n, CASE WHEN n >= 30 THEN r0 END AS r FROM (""" + _PB_PAIRS + """)))),
top AS (SELECT *, n - 2 AS v, atan2(abs(t), sqrt(n - 2)) AS theta, (n - 2) / (n - 2 + t * t) AS c2 FROM pb WHERE rank <= 5),
term AS (SELECT label, feature, exp(sum(ln(c2 * CASE WHEN v % 2 = 0 THEN (2.0 * i - 1) / (2.0 * i) ELSE 2.0 * i / (2.0 * i + 1) END)) OVER (
    PARTITION BY label, feature ORDER BY i)) AS x
  FROM (SELECT *, unnest(range(1, (v - 2 - v % 2) // 2 + 1)) AS i FROM top WHERE t IS NOT NULL)),
total AS (SELECT label, feature, 1 + sum(x) AS s FROM term GROUP BY label, feature)"""


@query("d16_point_biserial", sql=with_base("""
SELECT label, feature, n, r, t, 1 - CASE WHEN v % 2 = 0 THEN sin(theta) * s ELSE 2 / pi() * (theta + sin(theta) * cos(theta) * s) END AS p_value, rank
FROM top LEFT JOIN total USING (label, feature)""", upto="featured", extra=_PB_CTES))
def d16_point_biserial(spark, sf):
    """Feature-label correlation, t and exact two-sided p; top 5 per label by |r|."""
    return Q.point_biserial(_clean_train(spark, sf), FEATURES).select(
        "label", "feature", "n", "r", "t", "p_value", "rank")


@query("d17_correlation_matrix", sql=with_base("""
SELECT feature_a, feature_b, r, n FROM m UNION ALL SELECT feature_b, feature_a, r, n FROM m WHERE feature_a <> feature_b""",
    upto="featured", extra="m AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr(a, b, f'{a} IS NOT NULL AND {b} IS NOT NULL')} AS r, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM featured WHERE {CLEAN_TRAIN_SQL}"
        for i, a in enumerate(CONTINUOUS) for b in CONTINUOUS[i:]) + ")"))
def d17_correlation_matrix(spark, sf):
    """Full matrix of pairwise-complete Pearson r."""
    return Q.correlation_matrix(_clean_train(spark, sf), CONTINUOUS)


@query("d17_correlation_pairs", sql=with_base("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr(a, b, f'{a} IS NOT NULL AND {b} IS NOT NULL')}"
    f" AS r FROM featured WHERE {CLEAN_TRAIN_SQL}" for i, a in enumerate(CONTINUOUS) for b in CONTINUOUS[i + 1:])
    + ") WHERE abs(r) > 0.8", upto="featured"))
def d17_correlation_pairs(spark, sf):
    """Feature pairs with |Pearson r| > 0.8, pairwise-complete, one pass."""
    return Q.correlation_pairs(_clean_train(spark, sf), CONTINUOUS)


@query("d18_source_coverage", sql=with_base("""
SELECT entity, count(*) AS n_rows, avg(CASE WHEN ndvi IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ndvi_coverage,
  count(*) FILTER (WHERE firms_count > 0) AS fire_days FROM panel GROUP BY entity""", upto="panel"))
def d18_source_coverage(spark, sf):
    """NDVI share, fire days and rows per entity."""
    return Q.source_coverage(panels.raw_panel(spark, sf))


@query("d21_table_extent", sql=with_base("""
SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, min(day) AS first_day, max(day) AS last_day,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test
FROM featured""", upto="featured"))
def d21_table_extent(spark, sf):
    """Row count, distinct entities, date range and split counts of the training table."""
    return Q.table_extent(panels.featured(spark, sf), splits=("train", "val", "test"))


@query("s07_summary_report", sql=with_base("""
SELECT entity, ecosystem, count(*) AS n_rows,
  coalesce(sum(fire_within_30d), 0) AS fire_positive,
  CASE WHEN count(fire_within_30d) > 0
       THEN printf('%.1f%%', 100.0 * coalesce(sum(fire_within_30d), 0) / count(fire_within_30d)) ELSE 'N/A' END
    AS fire_rate,
  coalesce(sum(drought_within_30d), 0) AS drought_positive,
  CASE WHEN count(drought_within_30d) > 0
       THEN printf('%.1f%%', 100.0 * coalesce(sum(drought_within_30d), 0) / count(drought_within_30d)) ELSE 'N/A' END
    AS drought_rate,
  coalesce(sum(vegetation_within_30d), 0) AS vegetation_positive,
  CASE WHEN count(vegetation_within_30d) > 0
       THEN printf('%.1f%%', 100.0 * coalesce(sum(vegetation_within_30d), 0) / count(vegetation_within_30d))
       ELSE 'N/A' END AS vegetation_rate
FROM labelled GROUP BY entity, ecosystem""", upto="labelled"))
def s07_summary_report(spark, sf):
    """Per-entity label report with 'x.x%' rates."""
    return Q.summary_report(panels.labelled_panel(spark, sf))
