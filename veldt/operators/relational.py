"""Generic relational building blocks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C


def year_chunks(df: DataFrame, key: str = "entity", day: str = "day") -> DataFrame:
    """Inclusive (year-01-01, year-12-31) chunks spanning each key's days."""
    b = df.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    y = b.select(key, F.explode(F.sequence(F.year("_lo"), F.year("_hi"))).alias("year"))
    return y.select(key, "year", F.make_date("year", F.lit(1), F.lit(1)).alias("start"),
                    F.make_date("year", F.lit(12), F.lit(31)).alias("end"))


def project_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Select the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; missing columns become NULL; empty list tolerated."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no frames to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def known_only(df: DataFrame, dim: DataFrame, key: str = "entity") -> DataFrame:
    """Rows whose key exists in the dimension (B14): left-semi join."""
    return df.join(dim.select(key), key, "left_semi")


def missing_keys(expected: DataFrame, found: DataFrame, key: str = "entity") -> DataFrame:
    """Expected keys absent from the data (G4): distinct + exceptAll."""
    return expected.select(key).distinct().exceptAll(found.select(key).distinct())


def row_scope(rows: DataFrame, users: DataFrame, key: str = "entity") -> DataFrame:
    """Rows each non-admin user may see (B13): managers see their own entity
    (equi join on the key).  Admins are unrestricted — their view is ``rows``
    itself — so they are never paired with every row."""
    return users.where(F.col("role") != "admin").join(rows, key).select("user_id", *rows.columns)


def full_outer_feeds(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer equi-join of two feeds on the same keys."""
    return a.join(b, keys, "full_outer")


def centered_mean(df: DataFrame, col: str, k: int = 10, key: str = "entity", order: str = "day") -> DataFrame:
    """Centred k-observation mean over the non-NULL rows of ``col`` (E18):
    pandas even-window centring = rows (-k/2, k/2 - 1), full windows only."""
    nn = df.where(F.col(col).isNotNull())
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(k // 2), k - k // 2 - 1)
    return nn.withColumn(f"{col}_centered", F.when(F.count(col).over(w) == k, F.avg(col).over(w)))


def sequence_blocks(df: DataFrame, features: list[str], length: int = 30, key: str = "entity", order: str = "day",
                    targets: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Sliding sequences without copies (E14): each key's rows in blocks of ``length``, every row's values
    held twice at most, as ``cur`` of its block and ``prev`` of the next.

    ``targets`` lists the rows a sequence may end at (those that pass ``targets`` and have ``length`` rows up
    to them), with their place in the block, ``order`` and the columns ``keep``.  Blocks without targets are left out."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    ok = F.lit(True) if targets is None else F.coalesce(targets, F.lit(False))
    rows = df.select(key, F.floor(rn / length).alias("block"), F.struct(
        F.pmod(rn, F.lit(length)).alias("at"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"),
        ok.alias("ok"), F.struct(order, *keep).alias("row")).alias("r"))
    blocks = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list("r"), lambda x, y: x["at"] - y["at"]).alias("rs"))  # ``length`` at most
    blocks = blocks.select(key, "block", F.transform("rs", lambda r: r["v"]).alias("cur"), F.filter("rs", lambda r: r["ok"]).alias("rs"))
    before = blocks.select(key, (F.col("block") + 1).alias("block"), F.col("cur").alias("prev"))
    ends = F.transform(F.filter("rs", lambda r: F.col("prev").isNotNull() | (r["at"] == length - 1)),
                       lambda r: F.struct(r["at"].alias("at"), r["row"].alias("row")))
    return blocks.join(before, [key, "block"], "left").select(key, "block", "prev", "cur", ends.alias("targets")).where(F.size("targets") > 0)


def expand_sequences(blocks: DataFrame, length: int = 30, key: str = "entity") -> DataFrame:
    """One row per target of :func:`sequence_blocks`: key, its kept columns and ``seq``, two slices put together;
    rows are named by key and order, never by position (C16)."""
    at = F.col("at")
    seq = F.when(at == length - 1, F.col("cur")).otherwise(F.concat(F.slice("prev", at + 2, F.lit(length)), F.slice("cur", F.lit(1), at + 1)))
    return blocks.select(key, "prev", "cur", F.inline("targets")).select(key, "row.*", seq.alias("seq"))


# ----------------------------------------------------------------- geometry

def circle_ring(lon: Column, lat: Column, area_km2: Column, vertices: int = C.CIRCLE_VERTICES) -> Column:
    """Closed ring of [lon, lat] points around a circle of the given area (H12), rounded to 5 decimals.

    In degrees the circle is an ellipse: a kilometre is 1 / KM_PER_DEGREE_LAT
    high and 1 / (KM_PER_DEGREE_LON * cos(lat)) wide."""
    radius = F.sqrt(area_km2 / F.pi())
    tall = radius / F.lit(C.KM_PER_DEGREE_LAT)
    wide = radius / (F.lit(C.KM_PER_DEGREE_LON) * F.cos(F.radians(lat)))
    turn = F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda i: F.lit(2 * math.pi) * i / F.lit(vertices))
    return F.transform(turn, lambda a: F.array(F.round(lon + wide * F.cos(a), 5), F.round(lat + tall * F.sin(a), 5)))


def quadrants(df: DataFrame, key: str = "entity") -> DataFrame:
    """Four quadrant zones from a bbox midpoint (H13): NW, NE, SW, SE."""
    mx = (F.col("min_lon") + F.col("max_lon")) / 2
    my = (F.col("min_lat") + F.col("max_lat")) / 2
    def z(no, name, a, b, c, d):
        return F.struct(F.lit(no).alias("zone_no"), F.lit(name).alias("zone_name"), a.alias("z_min_lon"),
                        b.alias("z_min_lat"), c.alias("z_max_lon"), d.alias("z_max_lat"))
    q = F.array(z(1, "North-West", F.col("min_lon"), my, mx, F.col("max_lat")),
                z(2, "North-East", mx, my, F.col("max_lon"), F.col("max_lat")),
                z(3, "South-West", F.col("min_lon"), F.col("min_lat"), mx, my),
                z(4, "South-East", mx, F.col("min_lat"), F.col("max_lon"), my))
    return df.select(key, F.inline(q))


def bounds(points: Column) -> Column:
    """[min_lon, min_lat, max_lon, max_lat] of nested [lon, lat] points."""
    lons = F.transform(points, lambda p: p[0])
    lats = F.transform(points, lambda p: p[1])
    return F.array(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))
