"""The 20 engineered features (E1-E7, E11, E12, B9) for the training profile.

All trailing windows run in one (entity, day) window family; the monthly
rain climatology is a window over (entity, month) (C5).  The first 60 rows
of every entity are dropped (warm-up, E11) and a chronological split is
assigned (B9).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import windows as W


def add_features(df: DataFrame, roll: dict = C.ROLL_TRAIN) -> DataFrame:
    """Add all FEATURE_COLS and ``ndvi_missing`` to a (labelled) panel.

    ``ndvi`` is replaced by its 7-row forward fill.
    """
    # rain filled with 0 (T15), as fixed-point units for exact rolling sums
    p0 = F.coalesce(F.col("precip_units"), F.lit(0)).cast("bigint")
    fire0 = F.coalesce(F.col("firms_count"), F.lit(0)).cast("double")
    t = F.col("temp_max")
    hot = W.flag(t > F.lit(C.HOT_DAY_C)).cast("double")
    clim = Window.partitionBy("entity", F.month("day"))

    df = (df.withColumn("_p0", p0)
            .withColumn("expected_30d", W.group_mean_fixed(F.col("_p0"), clim, 1e6, 30.0))
            .withColumn("ndvi_units", W.ffill(F.col("ndvi_units"), C.NDVI_FILL_LIMIT))
            .withColumn("ndvi", F.col("ndvi_units").cast("double") / F.lit(1e9)))
    k, m = roll["rain_30d"]
    df = df.select(
        "*",
        W.rolling_sum_fixed(F.col("_p0"), *roll["rain_7d"], 1e6).alias("rain_7d"),
        W.rolling_sum_fixed(F.col("_p0"), k, m, 1e6).alias("rain_30d"),
        W.rolling_sum_fixed(F.col("_p0"), *roll["rain_60d"], 1e6).alias("rain_60d"),
        W.rolling_mean(t, *roll["temp_max_7d"]).alias("temp_max_7d"),
        W.rolling_mean(t, *roll["temp_max_30d"]).alias("temp_max_30d"),
        W.rolling_sum(hot, *roll["hot_days_30d"]).alias("hot_days_30d"),
        F.isnull("ndvi").cast("int").alias("ndvi_missing"),
        F.lag("ndvi", 30).over(W.by_entity()).alias("ndvi_30d_lag"),
        W.rolling_mean_fixed(F.col("ndvi_units"), *roll["ndvi_90d_avg"], 1e9).alias("ndvi_90d_avg"),
        W.rolling_sum(fire0, *roll["fire_30d"]).alias("fire_30d"),
        W.rolling_sum(fire0, *roll["fire_90d"]).alias("fire_90d"),
        W.days_since(fire0 > 0, F.col("day"), C.DAYS_SINCE_CAP).cast("double").alias("days_since_fire"),
        F.row_number().over(W.by_entity()).alias("_rn"),
    )
    doy = F.dayofyear("day").cast("double")
    return (df.withColumn("rain_deficit_30d", F.col("rain_30d") - F.col("expected_30d"))
              .withColumn("ndvi_change_30d", F.col("ndvi") - F.col("ndvi_30d_lag"))
              .withColumn("ndvi_deviation", F.col("ndvi") - F.col("ndvi_90d_avg"))
              .withColumn("doy_sin", F.sin(F.lit(2 * math.pi) * doy / F.lit(365.25)))
              .withColumn("doy_cos", F.cos(F.lit(2 * math.pi) * doy / F.lit(365.25)))
              .withColumn("dry_season", F.array_contains("dry_months", F.month("day")).cast("int"))
              .withColumn("park_id", F.col("entity_id").cast("int"))
              .withColumn("ecosystem_id", F.col("ecosystem_id").cast("int"))
              .drop("_p0"))


def split_col(day: str = "day", train_end: str = C.TRAIN_END, val_start: str = C.VAL_START,
              val_end: str = C.VAL_END, test_start: str = C.TEST_START):
    """Chronological split CASE (B9); anything unmatched is train."""
    d = F.col(day)
    return (F.when(d <= F.lit(train_end).cast("date"), "train")
             .when((d >= F.lit(val_start).cast("date")) & (d <= F.lit(val_end).cast("date")), "val")
             .when(d >= F.lit(test_start).cast("date"), "test")
             .otherwise("train"))


def featurize(labeled: DataFrame, warmup: int = C.WARMUP_DAYS) -> DataFrame:
    """Labelled panel -> featured dataset (features + labels + meta + split)."""
    f = add_features(labeled)
    f = f.where(F.col("_rn") > warmup).drop("_rn")
    return f.withColumn("split", split_col()).select(
        "entity", "ecosystem", "day", *C.FEATURE_COLS, *C.LABEL_COLS, "ndvi_missing", "split")
