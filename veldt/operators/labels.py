"""Forward-looking event labels.

* fire: any day with ``firms_count > 0`` in the next 30 rows.
* drought: 30-day rain (min 15 obs, un-filled) below 40 % of the entity's
  calendar-month climatology x 30, outside the dry months.
* vegetation: >= 5 of the last 14 rows with NDVI (7-day filled) more than
  0.10 below its 90-row mean (min 30 obs); window needs >= 7 rows.

Labels are NULL for the last 30 rows of an entity (incomplete horizon).
The monthly climatology is a window over (entity, month) (C5) — one extra
exchange of the entity-day panel, never a self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import windows as W


def _dry(day_col: str = "day", dry_col: str = "dry_months"):
    return F.array_contains(F.col(dry_col), F.month(day_col))


def drought_flag(df: DataFrame, units: str = "precip_units", scale: float = 1e6,
                 ratio: float = C.DROUGHT_RATIO, k: int = C.DROUGHT_ROLLING,
                 min_periods: int = C.DROUGHT_MIN) -> DataFrame:
    """Rain is un-filled here (NULL days are skipped, T15); rain is given as a
    fixed-point BIGINT column ``units`` (value = units / scale)."""
    clim = Window.partitionBy("entity", F.month("day"))
    u = F.col(units)
    df = df.withColumn("_expected", W.group_mean_fixed(u, clim, scale, float(k)))
    actual = W.rolling_sum_fixed(u, k, min_periods, scale)
    r = actual / F.nullif(F.col("_expected"), F.lit(0.0))
    return (df.withColumn("drought_flag", W.flag((r < F.lit(ratio)) & ~_dry()))
            .drop("_expected"))


def vegetation_flag(df: DataFrame, ndvi_units: str = "ndvi_units", scale: float = 1e9,
                    threshold: float = C.NDVI_THRESHOLD,
                    days_needed: int = C.VEG_DAYS_IN_WINDOW, window: int = C.VEG_WINDOW,
                    min_rows: int = C.VEG_MIN) -> DataFrame:
    """NDVI given as fixed-point BIGINT ``ndvi_units`` (value = units / scale)."""
    df = df.withColumn("_nu", W.ffill(F.col(ndvi_units), C.NDVI_FILL_LIMIT))
    df = df.withColumn("_avg90", W.rolling_mean_fixed(F.col("_nu"), C.NDVI_WINDOW, C.NDVI_MIN, scale))
    dev = F.col("_nu").cast("double") / F.lit(scale) - F.col("_avg90")
    df = df.withColumn("_below", W.flag(dev < F.lit(-threshold)).cast("double"))
    w = W.trailing(window)
    degraded = W.flag((F.count(F.lit(1)).over(w) >= min_rows)
                      & (F.sum("_below").over(w) >= F.lit(float(days_needed))))
    return df.withColumn("vegetation_flag", degraded).drop("_nu", "_avg90", "_below")


def label_panel(panel: DataFrame, horizon: int = C.FORWARD_DAYS) -> DataFrame:
    """Add fire/drought/vegetation ``*_within_30d`` labels to a raw panel."""
    df = drought_flag(panel)
    df = vegetation_flag(df)
    df = df.withColumn("fire_flag", W.flag(F.col("firms_count") > 0))
    return (df.withColumn("fire_within_30d", W.forward_any(F.col("fire_flag"), horizon))
              .withColumn("drought_within_30d", W.forward_any(F.col("drought_flag"), horizon))
              .withColumn("vegetation_within_30d", W.forward_any(F.col("vegetation_flag"), horizon))
              .drop("fire_flag", "drought_flag", "vegetation_flag"))
