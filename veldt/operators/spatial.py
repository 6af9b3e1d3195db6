"""Rectangles and nested polygons.

* ``overlap_join`` pairs rectangles (a point is one without extent) through
  grid cells: both sides list the cells that they touch, an equi-join on the
  cell brings neighbours together, and a pair is kept in one cell only, the one
  that holds the lower left corner of its intersection.  A crowded region is
  many cells, so it is many tasks, and neither side is sorted by entity.
* Polygons are ``[[ring, ...], ...]`` with rings of ``[lon, lat]``; areas and
  centroids are folds over a ring's own array, so a ring is never exploded
  into points and sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")


# ----------------------------------------------------------------- rectangles

def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size)))


def with_cells(df: DataFrame, box: Sequence[str], size: float) -> DataFrame:
    """A copy of each row for every grid cell that its closed rectangle touches, as ``_cx``, ``_cy``;
    a rectangle with a NULL side or with its sides crossed touches none."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return (df.where((x0 <= x1) & (y0 <= y1))
            .withColumn("_cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size))))
            .withColumn("_cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size)))))


def cell_size(df: DataFrame, box: Sequence[str]) -> float:
    """A cell as large as the mean rectangle of ``df`` (1 where they have no extent): few cells for each."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    size = df.agg(F.greatest(F.avg(x1 - x0), F.avg(y1 - y0)).alias("s")).first()["s"]  # one number
    return float(size) if size and size > 0 else 1.0


def overlap_join(a: DataFrame, a_box: Sequence[str], b: DataFrame, b_box: Sequence[str], size: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs whose closed rectangles share a point (C13), each once; ``on`` adds equal keys.

    The column names of both sides differ, but for those of ``on``."""
    left, right = with_cells(a, a_box, size), with_cells(b, b_box, size)
    j = left.join(right, [*on, "_cx", "_cy"])
    meet = [(F.col(a_box[k]) <= F.col(b_box[k + 2])) & (F.col(b_box[k]) <= F.col(a_box[k + 2])) for k in (0, 1)]
    corner = [_cell(F.greatest(a_box[k], b_box[k]), size) for k in (0, 1)]
    return j.where(meet[0] & meet[1] & (F.col("_cx") == corner[0]) & (F.col("_cy") == corner[1])).drop("_cx", "_cy")


def overlap_area(a_box: Sequence[str], b_box: Sequence[str]) -> Column:
    side = [F.least(a_box[k + 2], b_box[k + 2]) - F.greatest(a_box[k], b_box[k]) for k in (0, 1)]
    return side[0] * side[1]


def scenes_of(areas: DataFrame, area_box: Sequence[str], scenes: DataFrame, scene_box: Sequence[str], size: float,
              max_cloud: float = 80.0) -> DataFrame:
    """Scene pre-filter (A9): scenes under the cloud limit whose footprint meets an area's bounds and
    whose ``day`` lies in the area's ``since`` .. ``until`` (inclusive), with the area's columns."""
    clear = scenes.where(F.col("cloud_pct") < max_cloud)
    return overlap_join(areas, area_box, clear, scene_box, size).where(F.col("day").between(F.col("since"), F.col("until")))


# ----------------------------------------------------------------- polygons

_RING = "array<array<double>>"


def read_features(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """FeatureCollections -> one row per feature: properties (a map), geom_type, polygons.

    Coordinates are taken as text and parsed by the type they stand under, so Polygons and
    MultiPolygons may stand in one file; other types and broken ones have NULL polygons."""
    schema = ("features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")
    f = spark.read.schema(schema).option("multiLine", multiline).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one, many = F.from_json(text, f"array<{_RING}>"), F.from_json(text, f"array<array<{_RING}>>")
    return f.select(F.col("f.properties").alias("properties"), kind.alias("geom_type"),
                    F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).alias("polygons"))


def rings(df: DataFrame, keep: Sequence[str], polygons: str = "polygons") -> DataFrame:
    """One row per ring (two-level explode): polygon_no, ring_no (0 is the outer one), ring, n_vertices, area (signed)."""
    p = df.select(*keep, F.posexplode(polygons).alias("polygon_no", "_rings"))
    r = p.select(*keep, "polygon_no", F.posexplode("_rings").alias("ring_no", "ring"))
    return r.withColumn("n_vertices", F.size("ring")).withColumn("area", ring_moments(F.col("ring"))["area"])


def ring_moments(ring: Column) -> Column:
    """struct(area, sx, sy): signed shoelace area and first moments of a closed ring."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        cross = p[0] * q[1] - q[0] * p[1]
        return F.struct((acc["area"] + cross / 2).alias("area"), (acc["sx"] + (p[0] + q[0]) * cross).alias("sx"),
                        (acc["sy"] + (p[1] + q[1]) * cross).alias("sy"))

    edges = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(edges, zero, step)


def ring_centre(ring: Column) -> Column:
    """struct(lon, lat): shoelace centroid; the vertex mean of a ring without area."""
    m = ring_moments(ring)
    flat = F.abs(m["area"]) < 1e-9

    def mean(k: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.nullif(F.size(ring), F.lit(0))

    def by_area(s: str) -> Column:
        return m[s] / (F.lit(6.0) * F.nullif(m["area"], F.lit(0.0)))

    return F.struct(F.when(flat, mean(0)).otherwise(by_area("sx")).alias("lon"), F.when(flat, mean(1)).otherwise(by_area("sy")).alias("lat"))


def main_ring(polygons: Column) -> Column:
    """The outer ring with the most vertices; the first of equal ones."""
    outer = F.transform(polygons, lambda p: F.get(p, F.lit(0)))
    return F.aggregate(outer, F.array().cast(_RING), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))
