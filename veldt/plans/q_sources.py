"""Registered queries: landed-file sources and report sinks.

Each query lands files derived by Spark from the driver tables into a fresh
folder under the shared checkpoint location, then reads them back through
the source reader — so the reader's work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import config as C

from veldt.operators import evaluate as EV
from veldt.operators import relational as RL
from veldt.plans import panels
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base
from veldt.sources import files as FS
from veldt.sources import tables
from veldt.streaming.daily import fresh_base


@query("a01_a02_newest_csv", sql=with_base("""
SELECT entity, 'v2' AS version, count(*) AS n_rows, sum(precipitation) AS rain FROM panel GROUP BY entity""",
    upto="panel"))
def a01_a02_newest_csv(spark, sf):
    """Dated CSV scan with explicit schema (A1); newest version per entity from the path (A2)."""
    base = fresh_base(spark, "csv")
    p = panels.raw_panel(spark, sf).select("entity", F.col("day").alias("date"), "precipitation")
    p.where(F.year("date") <= 1999).write.partitionBy("entity").option("header", True).csv(f"{base}/v1")
    p.write.partitionBy("entity").option("header", True).csv(f"{base}/v2")
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("precipitation", T.DoubleType())])
    d = (spark.read.schema(schema).option("header", True).csv(f"{base}/v*/entity=*/*.csv")
              .withColumn("date", F.to_date("date"))
              .withColumn("file_name", F.col("_metadata.file_path")))
    d = (d.withColumn("entity", F.regexp_extract("file_name", r"/entity=([^/]+)/", 1))
          .withColumn("version", F.regexp_extract("file_name", r"/(v\d+)/entity=", 1)))
    from pyspark.sql import Window
    newest = (d.withColumn("_newest", F.max("version").over(Window.partitionBy("entity")))
               .where(F.col("version") == F.col("_newest")))
    return newest.groupBy("entity", "version").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.sum("precipitation").alias("rain"))


@query("a04_columnar_json", sql=with_base(
    "SELECT entity, day AS date, precipitation AS om_precipitation, temp_max AS om_temp_max FROM panel",
    upto="panel"))
def a04_columnar_json(spark, sf):
    """Column-oriented daily JSON payloads flattened to rows with prefixed names (A4, B1)."""
    base = fresh_base(spark, "json-cols")
    FS.write_columnar_json(panels.raw_panel(spark, sf), base, ["precipitation", "temp_max"])
    return FS.read_columnar_json(spark, base, ["precipitation", "temp_max"])


@query("a05_map_json", sql=with_base(
    "SELECT entity, day AS date, precipitation AS power_precipitation, temp_max AS power_temp_max FROM panel",
    upto="panel"))
def a05_map_json(spark, sf):
    """Map-of-maps JSON with -999 sentinels -> wide daily rows, sentinel -> NULL (A5, B2)."""
    base = fresh_base(spark, "json-maps")
    FS.write_map_json(panels.raw_panel(spark, sf), base, ["precipitation", "temp_max"])
    return FS.read_map_json(spark, base, ["precipitation", "temp_max"])


@query("a06_detection_payloads", sql=with_base(
    "SELECT entity, day, CASE WHEN day(day) % 7 = 0 THEN 0 ELSE firms_count END AS firms_count FROM panel", upto="panel"))
def a06_detection_payloads(spark, sf):
    """Text payloads of two products for every day, a header alone where nothing burnt and an error page now and
    then: not-a-CSV -> NULL, first serving product wins; days for which nothing landed count 0 (A6)."""
    base = fresh_base(spark, "payloads")
    days = panels.raw_panel(spark, sf).select("entity", "day", "firms_count")
    prods = days.where(F.dayofmonth("day") % 7 != 0).select("*", F.explode(F.array(F.lit("nrt"), F.lit("sp"))).alias("product"))
    csv = F.concat_ws("\n", F.lit("latitude,longitude,confidence"), F.array_repeat(F.lit("9.1,8.2,n"), F.col("firms_count")))
    body = F.when((F.col("product") == "nrt") & (F.dayofmonth("day") % 5 == 0), F.lit("<html>service unavailable</html>")).otherwise(csv)
    prods.select("entity", "day", "product", body.alias("payload")).write.parquet(base)
    counts = spark.read.parquet(base).select("entity", "day", "product", FS.payload_count(F.col("payload")).alias("count"))
    return days.select("entity", "day").join(FS.first_serving_product(counts), ["entity", "day"], "left").na.fill(0, ["firms_count"])


@query("a10_quoted_dimension_csv", sql="""
SELECT n_name || ', ' || c_mktsegment || ' segment' AS zone_name, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def a10_quoted_dimension_csv(spark, sf):
    """Dimension CSV with quoted commas in text fields (A10)."""
    base = fresh_base(spark, "dim-csv")
    c = tables.read(spark, sf, "customer", "c_nationkey", "c_mktsegment")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    z = (c.join(n, c.c_nationkey == n.n_nationkey)
          .groupBy(F.concat_ws(", ", "n_name", F.concat("c_mktsegment", F.lit(" segment"))).alias("zone_name"))
          .agg(F.count(F.lit(1)).alias("n_customers")))
    z.write.option("header", True).option("quoteAll", True).csv(base)
    return FS.read_quoted_csv(spark, base, T.StructType([T.StructField("zone_name", T.StringType()),
                                                         T.StructField("n_customers", T.LongType())]))


@query("a11_trusted_incidents", sql="""
SELECT n_name AS entity, count(*) AS n_incidents, count(DISTINCT (doc_id * 37) % 2405) AS n_days
FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE n_chars >= 200 GROUP BY n_name""")
def a11_trusted_incidents(spark, sf):
    """Incident CSV scan keeping high/medium confidence only."""
    from veldt.plans.q_misc import incidents
    base = fresh_base(spark, "incidents")
    incidents(spark, sf).withColumnRenamed("entity", "park").write.option("header", True).csv(base)
    r = spark.read.schema("park string, threat_type string, confidence string, inc_day date").option("header", True).csv(base)
    return FS.trusted_incidents(r).groupBy(F.col("park").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_incidents"), F.count_distinct("inc_day").alias("n_days"))


@query("a12_geojson_boundaries", sql="SELECT n_name AS entity, 'Polygon' AS geom_type, CAST(49 AS BIGINT) AS n_vertices "
                                     "FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def a12_geojson_boundaries(spark, sf):
    """GeoJSON FeatureCollections (one per ecosystem) -> one row per feature."""
    base = fresh_base(spark, "geojson")
    from veldt.plans.q_misc import _points
    from veldt.sources import panel as P
    g = (_points(spark, sf).groupBy("entity").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
                                                  F.count(F.lit(1)).cast("double").alias("area"))
         .join(P.entities(spark, sf).select("entity", "ecosystem"), "entity"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("entity")).alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"),
                             F.array(RL.circle_ring(F.col("lon"), F.col("lat"), F.col("area"))).alias("coordinates"))
                    .alias("geometry"))
    fc = g.groupBy("ecosystem").agg(F.collect_list(feat).alias("features"))  # entities of one ecosystem
    fc.select(F.lit("FeatureCollection").alias("type"), "features").write.json(base)
    r = FS.read_geojson(spark, base, multiline=False)   # written as JSON lines
    return r.select("entity", "geom_type", F.size("ring").cast("bigint").alias("n_vertices"))


_MET = ["f2", "precision", "recall", "brier"]


@query("a14_metrics_json", sql=with_base("""
SELECT config, threat, metric, value FROM (
  UNPIVOT (SELECT 'score' AS config, threat, f2, precision, recall, brier FROM """
    + __import__("veldt.plans.q_evaluate", fromlist=["x"]).metrics_sql() + """
           UNION ALL SELECT 'persistence', threat, f2, precision, recall, brier FROM """
    + __import__("veldt.plans.q_evaluate", fromlist=["x"]).metrics_sql("pers") + """)
  ON f2, precision, recall, brier INTO NAME metric VALUE value)""",
    extra=__import__("veldt.plans.q_evaluate", fromlist=["x"]).PERSIST_SQL))
def a14_metrics_json(spark, sf):
    """Many per-config metric JSON reports -> (config, threat, metric, value)."""
    base = fresh_base(spark, "metrics")
    lg = panels.eval_long(spark, sf)
    for cfg, long in (("score", lg), ("persistence", EV.persistence(lg))):
        m = EV.metrics(long)
        doc = F.struct(*[F.struct(*[F.max(F.when(F.col("threat") == t, F.col(x))).alias(x) for x in _MET]).alias(t)
                         for t in C.THREATS])
        m.agg(doc.alias("d")).select(F.to_json("d").alias("value")).coalesce(1).write.text(f"{base}/{cfg}")
    spark_files = f"{base}/*/*.txt"
    return FS.read_metrics_json(spark, spark_files, C.THREATS, _MET)


@query("a15_skip_landed", sql=with_base("""
SELECT entity, CAST(y AS INTEGER) AS year FROM (SELECT entity, entity_id, unnest(generate_series(year(min(day)),
  year(max(day)))) AS y FROM panel GROUP BY entity, entity_id) WHERE entity_id % 2 = 1""", upto="panel"))
def a15_skip_landed(spark, sf):
    """Requested (entity, year) chunks minus the ones already landed (A15): left-anti."""
    base = fresh_base(spark, "landed")
    from veldt.sources import panel as P
    p = panels.raw_panel(spark, sf)
    req = RL.year_chunks(p).select("entity", "year")
    landed_ids = P.entities(spark, sf).where(F.col("entity_id") % 2 == 0).select("entity")
    (req.join(landed_ids, "entity", "left_semi").withColumn("landed", F.lit(True))
        .write.partitionBy("entity", "year").parquet(base))
    landed = spark.read.parquet(base).select("entity", "year")
    return FS.not_yet_landed(req, landed, ["entity", "year"])


@query("s01_s02_partitioned_sink", sql=with_base(
    "SELECT entity, split, count(*) AS n_rows, count(*) AS n_split_rows, count(*) AS n_csv_rows, sum(days_since_fire) AS days, "
    "sum(days_since_fire) AS csv_days, count(ndvi) AS n_ndvi, count(ndvi) AS n_csv_ndvi FROM featured GROUP BY entity, split", upto="featured"))
def s01_s02_partitioned_sink(spark, sf):
    """Featured dataset as entity-partitioned parquet and as CSV, and its (day, entity, split) side output,
    all three read back (S1, S2)."""
    base = fresh_base(spark, "featured")
    f = panels.featured(spark, sf)
    FS.write_partitioned(f, f"{base}/featured", ["entity"])
    FS.write_partitioned(f.select("day", "entity", "split"), f"{base}/splits", ["entity"])
    f.write.option("header", True).csv(f"{base}/csv")

    def read(rows, **names):
        return rows.groupBy("entity", "split").agg(*[F.count(F.lit(1)).alias(names["n"])], *(
            [F.sum("days_since_fire").alias(names["days"]), F.count("ndvi").alias(names["ndvi"])] if "days" in names else []))

    whole = read(spark.read.parquet(f"{base}/featured"), n="n_rows", days="days", ndvi="n_ndvi")
    csv = read(spark.read.schema(f.schema).option("header", True).csv(f"{base}/csv"), n="n_csv_rows", days="csv_days", ndvi="n_csv_ndvi")
    return whole.join(read(spark.read.parquet(f"{base}/splits"), n="n_split_rows"), ["entity", "split"]).join(csv, ["entity", "split"])


_REPORT = ["n", "n_pos", "precision", "recall", "f1", "f2", "accuracy", "brier"]


@query("s06_json_report", sql=with_base(f"SELECT threat, {', '.join(_REPORT)} FROM " + __import__(
    "veldt.plans.q_evaluate", fromlist=["x"]).metrics_sql()))
def s06_json_report(spark, sf):
    """Nested JSON evaluation report written as text and read back, every metric."""
    base = fresh_base(spark, "report")
    m = EV.metrics(panels.eval_long(spark, sf))
    FS.write_json_report(m, base, "threat")
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    return spark.read.text(base).select(F.get_json_object("value", "$.threat").alias("threat"), *[
        F.get_json_object("value", f"$.metrics.{c}").cast(kinds[c]).alias(c) for c in _REPORT])
