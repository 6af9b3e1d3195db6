"""Raster-like pixel tables and zonal statistics.

A pixel table has one row per (entity, day, image, pixel) with band values
and a QA integer.  Zonal statistics are grouped aggregates; the multi-image
daily mean is two aggregation levels (image, then day).

Mapping onto the driver tables (line items as pixels): entity = supplier
nation, day = ship date, image = order, nir = extended price,
red = extended price * (discount + tax), qa = line number,
class = quantity, frp = extended price / 1000, cloud % = discount * 1000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalar import qa_clear
from veldt.sources import tables


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    s = tables.read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = tables.read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("entity"))
    return (li.join(sn, li.l_suppkey == sn.s_suppkey)
              .select("entity", F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("image"),
                      F.col("l_linenumber").alias("qa"), F.col("l_extendedprice").alias("nir"),
                      (F.col("l_extendedprice") * (F.col("l_discount") + F.col("l_tax"))).alias("red"),
                      F.col("l_quantity").cast("int").alias("cls"),
                      (F.col("l_extendedprice") / F.lit(1000.0)).alias("frp"),
                      (F.col("l_discount") * F.lit(1000.0)).alias("cloud_pct"),
                      F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("source_rank")))


def ndvi_expr(nir="nir", red="red"):
    """Normalised difference; NULL when the denominator is 0."""
    den = F.col(nir) + F.col(red)
    return F.when(den != 0, (F.col(nir) - F.col(red)) / den)


def scene_filter(px: DataFrame, max_cloud: float = 80.0, lo=None, hi=None) -> DataFrame:
    """Scene pre-filter: cloud share below max_cloud, inclusive date range."""
    out = px.where(F.col("cloud_pct") < max_cloud)
    if lo is not None:
        out = out.where(F.col("day") >= F.lit(lo).cast("date"))
    if hi is not None:
        out = out.where(F.col("day") <= F.lit(hi).cast("date"))
    return out


def daily_ndvi(px: DataFrame, qa_bits=(10, 11)) -> DataFrame:
    """Masked NDVI mean per image, then mean of image means per (entity, day)."""
    clean = px.where(qa_clear(F.col("qa"), qa_bits)).withColumn("ndvi", ndvi_expr())
    per_image = clean.groupBy("entity", "day", "image").agg(F.avg("ndvi").alias("img_ndvi"))
    return per_image.groupBy("entity", "day").agg(F.avg("img_ndvi").alias("ndvi_s2"),
                                                  F.count(F.lit(1)).alias("n_images"))


def fire_zonal(px: DataFrame, min_class: int = 7) -> DataFrame:
    """Per (entity, day, image): pixels with class >= min_class and their mean FRP;
    only images with detections are kept (A8)."""
    hot = F.col("cls") >= min_class
    g = px.groupBy("entity", "day", "image", "source_rank").agg(
        F.count_if(hot).alias("firms_count"), F.avg(F.when(hot, F.col("frp"))).alias("firms_frp_mean"))
    return g.where(F.col("firms_count") > 0)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Duplicate key -> first row by an explicit order."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
