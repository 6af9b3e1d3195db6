"""Landed-file sources and report sinks.

Readers always take an explicit schema (no inference) and keep the file
name from ``_metadata`` where the entity or version is encoded in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ----------------------------------------------------------------- A1 / A2 dated CSV

def read_dated_csv(spark: SparkSession, glob: str, schema: T.StructType, date_col: str = "date") -> DataFrame:
    """CSV with header and a parsed DATE key (A1); the file name is kept."""
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(glob)
                 .withColumn(date_col, F.to_date(date_col))
                 .withColumn("file_name", F.col("_metadata.file_name")))


def newest_per_entity(df: DataFrame, pattern: str = r"^([A-Za-z0-9_]+?)_labeled_") -> DataFrame:
    """Keep rows of the lexicographically newest file per entity (A2): the
    entity comes from the file name; max(file) per entity via a window."""
    from pyspark.sql import Window
    x = df.withColumn("file_entity", F.regexp_extract("file_name", pattern, 1))
    w = Window.partitionBy("file_entity")
    return x.where(F.col("file_name") == F.max("file_name").over(w))


# ----------------------------------------------------------------- A4 column-oriented JSON

def read_columnar_json(spark: SparkSession, path: str, variables: list[str], prefix: str = "om_") -> DataFrame:
    """{"entity":..,"daily":{"time":[...],"v1":[...],...}} -> one row per day (A4, B1)."""
    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("daily", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]))])
    j = spark.read.schema(schema).json(path)
    z = j.select("entity", F.inline(F.arrays_zip(F.col("daily.time").alias("time"),
                                                 *[F.col(f"daily.{v}").alias(v) for v in variables])))
    return z.select("entity", F.to_date("time").alias("date"), *[F.col(v).alias(prefix + v) for v in variables])


def write_columnar_json(df: DataFrame, path: str, variables: list[str], key: str = "entity") -> None:
    """Land per (entity, year) column-oriented payloads (bounded: <= 366 values per array)."""
    g = df.groupBy(key, F.year("day").alias("_y")).agg(
        F.sort_array(F.collect_list(F.struct("day", *variables))).alias("_r"))
    def field(name):
        return lambda r: r[name]
    daily = F.struct(F.transform("_r", lambda r: F.date_format(r["day"], "yyyy-MM-dd")).alias("time"),
                     *[F.transform("_r", field(v)).alias(v) for v in variables])
    g.select(key, daily.alias("daily")).write.mode("overwrite").json(path)


# ----------------------------------------------------------------- A5 map-of-maps JSON

def read_map_json(spark: SparkSession, path: str, variables: list[str], prefix: str = "power_",
                  sentinel: float = -999.0) -> DataFrame:
    """{"entity":..,"parameter":{VAR:{yyyymmdd: v}}} -> wide daily rows, sentinel -> NULL (A5, B2)."""
    schema = T.StructType([T.StructField("entity", T.StringType()),
                           T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(),
                                                                                          T.DoubleType())))])
    j = spark.read.schema(schema).json(path)
    e = j.select("entity", F.explode("parameter").alias("var", "series")).select(
        "entity", "var", F.explode("series").alias("ymd", "v"))
    e = e.select("entity", F.lower("var").alias("var"), F.to_date("ymd", "yyyyMMdd").alias("date"),
                 F.nullif(F.col("v"), F.lit(sentinel)).alias("v"))
    wide = e.groupBy("entity", "date").pivot("var", [v.lower() for v in variables]).agg(F.first("v"))
    for v in variables:
        wide = wide.withColumnRenamed(v.lower(), prefix + v.lower())
    return wide


def write_map_json(df: DataFrame, path: str, variables: list[str], key: str = "entity",
                   sentinel: float = -999.0) -> None:
    g = df.groupBy(key, F.year("day").alias("_y")).agg(*[
        F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd"),
                                                   F.coalesce(F.col(v), F.lit(sentinel))))).alias(v)
        for v in variables])
    par = F.create_map(*[x for v in variables for x in (F.lit(v.upper()), F.col(v))])
    g.select(key, par.alias("parameter")).write.mode("overwrite").json(path)


# ----------------------------------------------------------------- A6 text payload counts

def count_detections(spark: SparkSession, glob: str) -> DataFrame:
    """Per (entity, day, product) text file: NULL when not a CSV (first line does
    not start with 'latitude'), else the number of data lines (A6)."""
    t = spark.read.text(glob, wholetext=True).withColumn("f", F.col("_metadata.file_name"))
    parts = F.split(F.regexp_replace("f", r"\.txt$", ""), "__")
    return t.select(parts[0].alias("entity"), F.to_date(parts[1]).alias("day"), parts[2].alias("product"),
                    payload_count(F.col("value")).alias("count"))


def payload_count(text: Column) -> Column:
    """Data lines of a payload that begins with 'latitude', else NULL."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda v: F.length(F.trim(v)) > 0)
    return F.when(F.lower(F.try_element_at(lines, F.lit(1))).startswith("latitude"), (F.size(lines) - 1).cast("bigint"))


def first_serving_product(counts: DataFrame, order=("nrt", "sp")) -> DataFrame:
    """Fire count from the first product that serves, else 0."""
    wide = counts.groupBy("entity", "day").pivot("product", list(order)).agg(F.first("count"))
    return wide.select("entity", "day", F.coalesce(*[F.col(p) for p in order], F.lit(0)).alias("firms_count"))


# ----------------------------------------------------------------- A10/A11 dimension & incident CSV

def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Dimension CSV whose text fields contain quoted commas (A10)."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def trusted_incidents(df: DataFrame) -> DataFrame:
    """Incidents kept only at high or medium confidence."""
    return df.where(F.lower(F.trim("confidence")).isin("high", "medium"))


# ----------------------------------------------------------------- A12 GeoJSON

def read_geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """FeatureCollection -> one row per feature with its ring."""
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(
        T.StructType([T.StructField("properties", T.StructType([T.StructField("entity", T.StringType())])),
                      T.StructField("geometry", T.StructType([
                          T.StructField("type", T.StringType()),
                          T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))])))])
    j = spark.read.schema(schema).option("multiLine", multiline).json(path)
    f = j.select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties.entity").alias("entity"), F.col("f.geometry.type").alias("geom_type"),
                    F.col("f.geometry.coordinates")[0].alias("ring"))


# ----------------------------------------------------------------- A14 metrics JSON

def read_metrics_json(spark: SparkSession, glob: str, threats: list[str], metrics: list[str]) -> DataFrame:
    """Many {threat: {metric: v}} files -> (config, threat, metric, value)."""
    schema = T.StructType([T.StructField(t, T.StructType([T.StructField(m, T.DoubleType()) for m in metrics]))
                           for t in threats])
    j = (spark.read.schema(schema).option("multiLine", True).json(glob)
              .withColumn("config", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)))
    long = j.select("config", F.inline(F.array(*[F.struct(F.lit(t).alias("threat"), F.col(t).alias("m"))
                                                  for t in threats])))
    return long.select("config", "threat", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                                      F.col(f"m.{m}").alias("value"))
                                                             for m in metrics])))


# ----------------------------------------------------------------- A15 skip landed

def not_yet_landed(requested: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys without a landed file (A15): left-anti join."""
    return requested.join(landed.select(*keys).distinct(), keys, "left_anti")


# ----------------------------------------------------------------- sinks

def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Dataset sink: always partitioned parquet, no size switch."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_json_report(df: DataFrame, path: str, key: str) -> None:
    """Nested JSON report: one document per key with a struct payload."""
    cols = [c for c in df.columns if c != key]
    df.select(F.to_json(F.struct(F.col(key), F.struct(*cols).alias("metrics"))).alias("value")) \
      .write.mode("overwrite").text(path)
