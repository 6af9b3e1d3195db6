"""Registered queries: panel construction, labels and features (B, C, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import features as FE
from veldt.operators import quality as Q
from veldt.plans import panels
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base


def _fp(spark, sf):
    return panels.feature_panel(spark, sf)


@query("b03_daily_spine", sql=with_base(
    "SELECT entity, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, "
    "count(DISTINCT day) AS n_distinct FROM spine GROUP BY entity", upto="panel"))
def b03_daily_spine(spark, sf):
    """Continuous spine: one row per entity-day between global bounds."""
    from veldt.sources import panel as P
    facts = P.daily_facts(spark, sf)
    b = facts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    sp = P.spine(P.entities(spark, sf), b.select("lo").scalar(), b.select("hi").scalar())
    return sp.groupBy("entity").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"),
                                    F.max("day").alias("last_day"),
                                    F.count_distinct("day").alias("n_distinct"))


@query("c03_densified_panel", sql=with_base(
    "SELECT entity, day, precipitation, temp_max, ndvi, firms_count, firms_frp_mean FROM panel",
    upto="panel"))
def c03_densified_panel(spark, sf):
    """Sparse facts left-joined onto the spine; counts NULL->0, means stay NULL (C2, C3, C4 dims, A3 scans)."""
    return panels.raw_panel(spark, sf).select("entity", "day", "precipitation", "temp_max", "ndvi",
                                              "firms_count", "firms_frp_mean")


@query("e01_rolling_sum", sql=with_base(
    "SELECT entity, day, rain_7d, rain_30d, rain_60d, fire_30d, fire_90d FROM feat", upto="feat"))
def e01_rolling_sum(spark, sf):
    """Trailing rolling sums with min_periods; rain and fire NULL -> 0 first."""
    return _fp(spark, sf).select("entity", "day", "rain_7d", "rain_30d", "rain_60d", "fire_30d", "fire_90d")


@query("e02_rolling_mean", sql=with_base(
    "SELECT entity, day, temp_max_7d, temp_max_30d, ndvi_90d_avg FROM feat", upto="feat"))
def e02_rolling_mean(spark, sf):
    """Trailing rolling means of temperature (7/30, min 4/15) and NDVI (90, min 30)."""
    return _fp(spark, sf).select("entity", "day", "temp_max_7d", "temp_max_30d", "ndvi_90d_avg")


@query("e03_hot_days", sql=with_base("SELECT entity, day, hot_days_30d FROM feat", upto="feat"))
def e03_hot_days(spark, sf):
    """Rolling 30-day count of days above 35 C; NULL temperature counts as 0."""
    return _fp(spark, sf).select("entity", "day", "hot_days_30d")


@query("e04_ffill_ndvi", sql=with_base("SELECT entity, day, ndvi, ndvi_missing FROM feat", upto="feat"))
def e04_ffill_ndvi(spark, sf):
    """NDVI forward-filled at most 7 rows plus the missing flag."""
    return _fp(spark, sf).select("entity", "day", "ndvi", "ndvi_missing")


@query("e05_lag_change", sql=with_base(
    "SELECT entity, day, ndvi_30d_lag, ndvi_change_30d FROM feat", upto="feat"))
def e05_lag_change(spark, sf):
    """NDVI 30-row lag and change versus it (E5)."""
    return _fp(spark, sf).select("entity", "day", "ndvi_30d_lag", "ndvi_change_30d")


@query("e06_deviation_deficit", sql=with_base(
    "SELECT entity, day, ndvi_deviation, rain_deficit_30d, expected_30d FROM feat", upto="feat"))
def e06_deviation_deficit(spark, sf):
    """NDVI anomaly and rain deficit vs the (entity, month) climatology window."""
    return _fp(spark, sf).select("entity", "day", "ndvi_deviation", "rain_deficit_30d", "expected_30d")


@query("e07_days_since_fire", sql=with_base("SELECT entity, day, days_since_fire FROM feat", upto="feat"))
def e07_days_since_fire(spark, sf):
    """Days since the last fire day, capped at 365, none -> 365."""
    return _fp(spark, sf).select("entity", "day", "days_since_fire")


@query("e08_forward_label", sql=with_base(
    "SELECT entity, day, fire_within_30d FROM labelled", upto="labelled"))
def e08_forward_label(spark, sf):
    """Fire within the next 30 rows (today excluded), NULL without a full horizon."""
    return panels.labelled_panel(spark, sf).select("entity", "day", "fire_within_30d")


@query("e09_drought_label", sql=with_base(
    "SELECT entity, day, drought_within_30d FROM labelled", upto="labelled"))
def e09_drought_label(spark, sf):
    """Drought: 30-day rain below 40 % of the month climatology outside dry months, forward 30."""
    return panels.labelled_panel(spark, sf).select("entity", "day", "drought_within_30d")


@query("e10_vegetation_label", sql=with_base(
    "SELECT entity, day, vegetation_within_30d FROM labelled", upto="labelled"))
def e10_vegetation_label(spark, sf):
    """Vegetation: >= 5 of 14 days with NDVI 0.10 below its 90-row mean, forward 30."""
    return panels.labelled_panel(spark, sf).select("entity", "day", "vegetation_within_30d")


@query("e11_featured_dataset", sql=with_base(
    "SELECT entity, ecosystem, day, " + ", ".join(C.FEATURE_COLS) + ", " + ", ".join(C.LABEL_COLS)
    + ", ndvi_missing, split FROM featured", upto="featured"))
def e11_featured_dataset(spark, sf):
    """Full training table: warm-up dropped (E11), split assigned."""
    return panels.featured(spark, sf)


@query("e12_seasonal", sql=with_base(
    "SELECT entity, day, doy_sin, doy_cos, dry_season, park_id, ecosystem_id FROM feat", upto="feat"))
def e12_seasonal(spark, sf):
    """sin/cos day-of-year, dry-season month-set membership, ids."""
    return _fp(spark, sf).select("entity", "day", "doy_sin", "doy_cos", "dry_season", "park_id", "ecosystem_id")


@query("b09_split_counts", sql=with_base(
    "SELECT split, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM featured GROUP BY split",
    upto="featured"))
def b09_split_counts(spark, sf):
    """Rows and date range per chronological split."""
    return (panels.featured(spark, sf).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day")))


@query("d04_label_base_rates", sql=with_base("""
SELECT entity, count(*) AS n_rows,
  count(fire_within_30d) AS fire_labeled, sum(fire_within_30d) AS fire_pos, avg(fire_within_30d) AS fire_rate,
  count(drought_within_30d) AS drought_labeled, sum(drought_within_30d) AS drought_pos,
  avg(drought_within_30d) AS drought_rate,
  count(vegetation_within_30d) AS vegetation_labeled, sum(vegetation_within_30d) AS vegetation_pos,
  avg(vegetation_within_30d) AS vegetation_rate
FROM labelled GROUP BY ROLLUP (entity)""", upto="labelled"))
def d04_label_base_rates(spark, sf):
    """Label base rates per entity plus the pooled (entity NULL) row."""
    return Q.label_base_rates(panels.labelled_panel(spark, sf))
