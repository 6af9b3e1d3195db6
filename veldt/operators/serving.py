"""Serving-profile features and history joins.

The serving profile computes, for every target day d, the same 20 features
from the trailing history [d-90, d] only, with ``min_periods=1`` (T4):

* rolling sums/means over the last k rows of that history;
* rain climatology of the target's month *within the history* — since the
  history spans 91 days, the days of month(d) in it are exactly the days
  from the 1st of that month to d, so it is a running mean over
  (entity, year, month): no range join, one extra exchange;
* NDVI forward fill cannot reach before d-90: the 6 oldest rows of the
  90-row mean are corrected with explicit lags (exact, window-only);
* NDVI NULL -> 0.0 at the target, 30-day lag NULL -> target NDVI (T5);
* days since fire only counts fires inside the history, else 365.

Bulk evaluation uses windows over (entity, day); ``interval_join`` is the
explicit range join for a small set of target days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import windows as W


def serve_features(panel: DataFrame, history_days: int = C.SERVE_HISTORY_DAYS) -> DataFrame:
    """Add serving-profile features (+ ``history_rows``) to every panel row."""
    H = history_days
    by = W.by_entity()
    p0 = F.coalesce(F.col("precip_units"), F.lit(0)).cast("bigint")
    fire0 = F.coalesce(F.col("firms_count"), F.lit(0)).cast("double")
    t = F.col("temp_max")
    hot = W.flag(t > F.lit(C.HOT_DAY_C)).cast("double")
    month_to_date = (Window.partitionBy("entity", F.year("day"), F.month("day")).orderBy("day")
                     .rowsBetween(Window.unboundedPreceding, 0))
    src = by.rowsBetween(-C.NDVI_FILL_LIMIT, 0)
    df = (panel.withColumn("_p0", p0)
               .withColumn("_exp30", W.group_mean_fixed(F.col("_p0"), month_to_date, 1e6, 30.0))
               .withColumn("_nu", F.last("ndvi_units", ignorenulls=True).over(src))
               .withColumn("_nsrc", F.last(F.when(F.col("ndvi_units").isNotNull(), F.col("day")),
                                           ignorenulls=True).over(src)))

    def s1(c: Column, k: int, scale: float | None = None) -> Column:
        w = W.trailing(k)
        v = F.sum(c).over(w)
        v = v.cast("double") / F.lit(scale) if scale else v
        return F.when(F.count(c).over(w) >= 1, v)

    # 90-row NDVI mean with history-bounded fill: rows d-83..d always fill from
    # inside [d-90, d]; rows d-89..d-84 only count when their fill source does.
    lim = C.NDVI_FILL_LIMIT
    inner = by.rowsBetween(-(H - lim), 0)
    start = F.date_sub(F.col("day"), H)
    tail_sum = F.lit(0).cast("bigint")
    tail_cnt = F.lit(0).cast("bigint")
    for k in range(H - lim + 1, H):
        ok = W.flag(F.lag("_nsrc", k).over(by) >= start)
        tail_sum = tail_sum + F.when(ok, F.lag("_nu", k).over(by)).otherwise(F.lit(0))
        tail_cnt = tail_cnt + F.when(ok, F.lit(1)).otherwise(F.lit(0))
    n_ndvi = F.count("_nu").over(inner) + tail_cnt
    sum_ndvi = F.coalesce(F.sum("_nu").over(inner), F.lit(0)) + tail_sum
    ndvi90 = F.when(n_ndvi >= 1, sum_ndvi.cast("double") / (n_ndvi.cast("double") * F.lit(1e9)))

    last_fire = F.last(F.when(fire0 > 0, F.col("day")), ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, 0))
    ds = F.when(last_fire >= start, F.least(F.datediff("day", last_fire), F.lit(C.DAYS_SINCE_CAP)))
    hist_rows = F.count(F.lit(1)).over(Window.partitionBy("entity").orderBy(F.unix_date("day"))
                                       .rangeBetween(-H, 0))
    ndvi_now = F.col("_nu").cast("double") / F.lit(1e9)
    df = df.select(
        "*",
        s1(F.col("_p0"), 7, 1e6).alias("s_rain_7d"),
        s1(F.col("_p0"), 30, 1e6).alias("s_rain_30d"),
        s1(F.col("_p0"), 60, 1e6).alias("s_rain_60d"),
        F.when(F.count(t).over(W.trailing(7)) >= 1, F.avg(t).over(W.trailing(7))).alias("s_temp_max_7d"),
        F.when(F.count(t).over(W.trailing(30)) >= 1, F.avg(t).over(W.trailing(30))).alias("s_temp_max_30d"),
        s1(hot, 30).alias("s_hot_days_30d"),
        F.coalesce(ndvi_now, F.lit(0.0)).alias("s_ndvi"),
        F.lag(ndvi_now, 30).over(by).alias("_lag30"),
        ndvi90.alias("s_ndvi_90d_avg"),
        s1(fire0, 30).alias("s_fire_30d"),
        s1(fire0, 90).alias("s_fire_90d"),
        F.coalesce(ds, F.lit(C.DAYS_SINCE_CAP)).cast("double").alias("s_days_since_fire"),
        hist_rows.alias("history_rows"),
    )
    doy = F.dayofyear("day").cast("double")
    out = (df.withColumn("s_rain_deficit_30d", F.col("s_rain_30d") - F.col("_exp30"))
             .withColumn("s_ndvi_30d_lag", F.coalesce(F.col("_lag30"), F.col("s_ndvi")))
             .withColumn("s_ndvi_change_30d", F.col("s_ndvi") - F.col("s_ndvi_30d_lag"))
             .withColumn("s_ndvi_deviation", F.col("s_ndvi") - F.col("s_ndvi_90d_avg"))
             .withColumn("s_doy_sin", F.sin(F.lit(2 * math.pi) * doy / F.lit(365.25)))
             .withColumn("s_doy_cos", F.cos(F.lit(2 * math.pi) * doy / F.lit(365.25)))
             .withColumn("s_dry_season", F.array_contains("dry_months", F.month("day")).cast("double"))
             .withColumn("s_park_id", F.col("entity_id").cast("double"))
             .withColumn("s_ecosystem_id", F.col("ecosystem_id").cast("double")))
    return out.drop("_p0", "_exp30", "_nu", "_nsrc", "_lag30")


def serve_vector(df: DataFrame) -> DataFrame:
    """Rename ``s_*`` serving columns to the canonical FEATURE_COLS names."""
    keep = [c for c in df.columns if not c.startswith("s_") and c not in C.FEATURE_COLS]
    return df.select(*keep, *[F.col(f"s_{c}").alias(c) for c in C.FEATURE_COLS])


def history_guard(df: DataFrame, min_rows: int = C.SERVE_MIN_ROWS) -> DataFrame:
    """Minimum-history guard (B15): rows with >= min_rows days in [d-90, d]."""
    return df.where(F.col("history_rows") >= min_rows)


def asof_lookback(df: DataFrame, col: str, days: int = C.NDVI_LOOKBACK_DAYS,
                  out: str | None = None) -> DataFrame:
    """Last non-NULL value within the previous ``days`` calendar days.

    RANGE frame on the day ordinal, so gaps in the series are handled."""
    w = (Window.partitionBy("entity").orderBy(F.unix_date("day")).rangeBetween(-days, 0))
    return df.withColumn(out or f"{col}_asof", F.last(col, ignorenulls=True).over(w))


def interval_join(facts: DataFrame, targets: DataFrame, lo_days: int, hi_days: int = 0,
                  bin_days: int = 16, key: str = "entity", day: str = "day",
                  target_day: str = "target_day") -> DataFrame:
    """Rows of ``facts`` with day in [target-lo_days, target+hi_days].

    Binned range join: both sides get a ``bin = floor(unix_date/bin_days)``;
    each target is replicated into the (lo+hi)/bin_days+2 bins its interval
    touches, then an equi-join on (key, bin) plus the exact range predicate.
    A hot entity is thus spread over many bins instead of one task, and no
    pair outside the interval is ever formed."""
    f = facts.withColumn("_bin", F.floor(F.unix_date(day) / F.lit(bin_days)))
    lo = F.unix_date(F.col(target_day)) - F.lit(lo_days)
    hi = F.unix_date(F.col(target_day)) + F.lit(hi_days)
    t = targets.withColumn("_bin", F.explode(F.sequence(F.floor(lo / F.lit(bin_days)),
                                                       F.floor(hi / F.lit(bin_days)))))
    j = f.join(t, [key, "_bin"])
    return j.where((F.unix_date(F.col(day)) >= lo) & (F.unix_date(F.col(day)) <= hi)).drop("_bin")
