"""Registered queries: rectangle overlap, scene pre-filter, nested polygons.

Points and zones come from customers; scenes are orders whose price and customer
number place a footprint; each entity's polygons are shapes within its bounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import relational as RL
from veldt.operators import spatial as SP
from veldt.plans.q_misc import _POINTS_SQL, _points
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base
from veldt.sources import panel as P
from veldt.sources import tables
from veldt.streaming.daily import fresh_base

ZONE = ("z_min_lon", "z_min_lat", "z_max_lon", "z_max_lat")
SCENE = ("s_min_lon", "s_min_lat", "s_max_lon", "s_max_lat")


def _boxes(spark, sf):
    return _points(spark, sf).groupBy("entity").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
                                                    F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def _scenes(spark, sf):
    o = tables.read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    x, y = F.col("o_totalprice") / F.lit(5000.0), F.pmod("o_custkey", F.lit(997)).cast("double") / F.lit(100.0)
    return o.select(F.col("o_orderkey").alias("image"), F.to_date("o_orderdate").alias("day"),
                    F.pmod("o_orderkey", F.lit(101)).cast("double").alias("cloud_pct"), x.alias("s_min_lon"), y.alias("s_min_lat"),
                    (x + F.pmod("o_orderkey", F.lit(4)) * 0.5).alias("s_max_lon"), (y + F.pmod("o_orderkey", F.lit(3)) * 0.25).alias("s_max_lat"))


_SCENES_SQL = _POINTS_SQL + """,
scenes AS (SELECT *, s_min_lon + (image % 4) * 0.5 AS s_max_lon, s_min_lat + (image % 3) * 0.25 AS s_max_lat FROM (
  SELECT o_orderkey AS image, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 101 AS DOUBLE) AS cloud_pct,
    o_totalprice / 5000.0 AS s_min_lon, CAST(o_custkey % 997 AS DOUBLE) / 100.0 AS s_min_lat FROM orders))"""


@query("c13_rectangle_overlap", sql=with_base("""
SELECT entity, zone_no, count(*) AS n_scenes, sum(image) AS image_sum, max(
  (least(z_max_lon, s_max_lon) - greatest(z_min_lon, s_min_lon)) * (least(z_max_lat, s_max_lat) - greatest(z_min_lat, s_min_lat))) AS max_area
FROM quads JOIN scenes ON z_min_lon <= s_max_lon AND s_min_lon <= z_max_lon AND z_min_lat <= s_max_lat AND s_min_lat <= z_max_lat
GROUP BY entity, zone_no""", upto="panel", extra=_SCENES_SQL))
def c13_rectangle_overlap(spark, sf):
    """Scene footprints that overlap each zone, counted once per pair through grid cells."""
    scenes = _scenes(spark, sf)
    j = SP.overlap_join(RL.quadrants(_boxes(spark, sf)), ZONE, scenes, SCENE, SP.cell_size(scenes, SCENE))
    return j.groupBy("entity", "zone_no").agg(F.count(F.lit(1)).alias("n_scenes"), F.sum("image").alias("image_sum"),
                                              F.max(SP.overlap_area(ZONE, SCENE)).alias("max_area"))


@query("a09_scene_prefilter", sql=with_base("""
SELECT entity, zone_no, count(*) AS n_scenes, min(day) AS first_day, max(day) AS last_day, sum(image) AS image_sum
FROM (SELECT *, DATE '1996-01-01' + zone_no * 90 AS since, DATE '1997-06-30' + zone_no * 90 AS until FROM quads) q
JOIN scenes ON cloud_pct < 80 AND day BETWEEN since AND until
  AND z_min_lon <= s_max_lon AND s_min_lon <= z_max_lon AND z_min_lat <= s_max_lat AND s_min_lat <= z_max_lat
GROUP BY entity, zone_no""", upto="panel", extra=_SCENES_SQL))
def a09_scene_prefilter(spark, sf):
    """Scenes with less than 80 % cloud that meet a zone's bounds within its dates."""
    days = F.col("zone_no") * 90
    areas = RL.quadrants(_boxes(spark, sf)).withColumn("since", F.date_add(F.lit("1996-01-01").cast("date"), days)) \
        .withColumn("until", F.date_add(F.lit("1997-06-30").cast("date"), days))
    scenes = _scenes(spark, sf)
    return SP.scenes_of(areas, ZONE, scenes, SCENE, SP.cell_size(scenes, SCENE)).groupBy("entity", "zone_no").agg(
        F.count(F.lit(1)).alias("n_scenes"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("image").alias("image_sum"))


@query("c13_points_in_zones", sql=with_base("""
SELECT q.entity, q.zone_no, count(*) AS n_points FROM pts p JOIN quads q ON p.entity = q.entity
  AND p.lon BETWEEN q.z_min_lon AND q.z_max_lon AND p.lat BETWEEN q.z_min_lat AND q.z_max_lat
GROUP BY q.entity, q.zone_no""", upto="panel", extra=_POINTS_SQL))
def c13_points_in_zones(spark, sf):
    """Points in their entity's zones (inclusive), joined on (entity, cell)."""
    p = _points(spark, sf)
    zones = RL.quadrants(_boxes(spark, sf))
    j = SP.overlap_join(p, ("lon", "lat", "lon", "lat"), zones, ZONE, SP.cell_size(zones, ZONE) / 8, on=("entity",))
    return j.groupBy("entity", "zone_no").agg(F.count(F.lit(1)).alias("n_points"))


# rings as shares of an entity's bounds: frame, hole, star and a line back and forth
_FRAME = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
_HOLE = [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25)]
_STAR = [(0.5, 0), (0.75, 0.25), (1, 0.5), (0.75, 0.75), (0.5, 1), (0.25, 0.75), (0, 0.5), (0.25, 0.25), (0.5, 0)]
_LINE = [(0, 0), (0.25, 0.25), (0.5, 0.5), (0.75, 0.75), (0.5, 0.5), (0.25, 0.25), (0, 0)]
_SHAPES = [("Polygon", [[_FRAME, _HOLE]]), ("MultiPolygon", [[_FRAME, _HOLE], [_STAR]]), ("MultiPolygon", [[_FRAME], [_LINE]])]
_SHAPE_SQL = _POINTS_SQL + ",\nshape AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{kind}', {p}, {r}, {i}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for k, (kind, polys) in enumerate(_SHAPES) for p, poly in enumerate(polys)
    for r, ring in enumerate(poly) for i, (x, y) in enumerate(ring)) + """) t(kind_no, geom_type, polygon_no, ring_no, i, fx, fy)),
vert AS (SELECT entity, geom_type, polygon_no, ring_no, i, min_lon + (max_lon - min_lon) * fx AS lon, min_lat + (max_lat - min_lat) * fy AS lat
         FROM bb JOIN nation ON n_name = entity JOIN shape ON kind_no = n_nationkey % 3),
ring AS (SELECT entity, geom_type, polygon_no, ring_no, count(*) AS n_vertices, avg(lon) AS mx, avg(lat) AS my,
    sum((lon * lat1 - lon1 * lat) / 2) AS area, sum((lon + lon1) * (lon * lat1 - lon1 * lat)) AS sx, sum((lat + lat1) * (lon * lat1 - lon1 * lat)) AS sy
  FROM (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM vert
        WINDOW w AS (PARTITION BY entity, polygon_no, ring_no ORDER BY i)) GROUP BY ALL)"""


def _features(spark, sf):
    """Polygons of every entity, written as one FeatureCollection per ecosystem and read back."""
    bb = _boxes(spark, sf).join(P.entities(spark, sf).select("entity", "entity_id", "ecosystem"), "entity")
    w, h = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")

    def ring(points):
        return F.array(*[F.array(F.col("min_lon") + w * F.lit(float(x)), F.col("min_lat") + h * F.lit(float(y))) for x, y in points])

    def text(polys, kind):
        c = F.array(*[F.array(*[ring(r) for r in p]) for p in polys])
        return F.to_json(c if kind == "MultiPolygon" else c[0])

    no = F.pmod("entity_id", F.lit(3))
    kind, coords = F.lit(_SHAPES[2][0]), text(_SHAPES[2][1], _SHAPES[2][0])
    for k in (1, 0):
        kind, coords = F.when(no == k, F.lit(_SHAPES[k][0])).otherwise(kind), F.when(no == k, text(_SHAPES[k][1], _SHAPES[k][0])).otherwise(coords)
    feature = F.format_string('{"type":"Feature","properties":{"entity":"%s"},"geometry":{"type":"%s","coordinates":%s}}', "entity", kind, coords)
    files = bb.groupBy("ecosystem").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","),
                                                 F.lit("]}")).alias("value"))  # entities of one ecosystem
    base = fresh_base(spark, "geojson")
    files.select("value").write.text(base)
    f = SP.read_features(spark, base, multiline=False)
    return f.select(F.col("properties")["entity"].alias("entity"), "geom_type", "polygons")


@query("a12_geojson_rings", sql=with_base("SELECT entity, geom_type, polygon_no, ring_no, i, lon, lat FROM vert", upto="panel", extra=_SHAPE_SQL))
def a12_geojson_rings(spark, sf):
    """Every vertex of every ring of Polygon and MultiPolygon features read from GeoJSON."""
    r = SP.rings(_features(spark, sf), ["entity", "geom_type"])
    return r.select("entity", "geom_type", "polygon_no", "ring_no", F.posexplode("ring").alias("i", "pt")).select(
        "entity", "geom_type", "polygon_no", "ring_no", "i", F.col("pt")[0].alias("lon"), F.col("pt")[1].alias("lat"))


@query("h11_feature_centroid", sql=with_base("""
SELECT entity, geom_type, CASE WHEN abs(area) < 1e-9 THEN mx ELSE sx / (6.0 * area) END AS lon,
  CASE WHEN abs(area) < 1e-9 THEN my ELSE sy / (6.0 * area) END AS lat, n_vertices, n_rings, net_area
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n_vertices DESC, polygon_no) AS place FROM ring WHERE ring_no = 0)
JOIN (SELECT entity, count(*) AS n_rings, sum(CASE WHEN ring_no = 0 THEN abs(area) ELSE -abs(area) END) AS net_area FROM ring GROUP BY entity)
USING (entity) WHERE place = 1""", upto="panel", extra=_SHAPE_SQL))
def h11_feature_centroid(spark, sf):
    """Centroid of each feature's main ring: most vertices win, a ring without area gives its vertex mean;
    with the area of all polygons less their holes (H11)."""
    f = _features(spark, sf)
    main = SP.main_ring(F.col("polygons"))
    c = f.select("entity", "geom_type", SP.ring_centre(main).alias("c"), F.size(main).alias("n_vertices"))
    signed = F.when(F.col("ring_no") == 0, F.abs("area")).otherwise(-F.abs("area"))
    per = SP.rings(f, ["entity"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rings"), F.sum(signed).alias("net_area"))
    return c.join(per, "entity").select("entity", "geom_type", "c.lon", "c.lat", "n_vertices", "n_rings", "net_area")
