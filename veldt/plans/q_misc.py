"""Registered queries: filters, joins, set operations, scalar functions, pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldt import config as C

from veldt.functions import scalar as S
from veldt.functions.ranking import global_row_number
from veldt.operators import evaluate as EV
from veldt.operators import ml as ML
from veldt.operators import readmodel as R
from veldt.operators import relational as RL
from veldt.operators import serving as SV
from veldt.operators import spatial as SP
from veldt.plans import panels
from veldt.plans.q_ml import MEDIANS_SQL
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base
from veldt.sources import chunks as CH
from veldt.sources import files as FS
from veldt.sources import pixels as PX
from veldt.sources import sorted_files as SO
from veldt.sources import tables
from veldt.streaming.daily import fresh_base


@query("b04_year_chunks", sql=with_base("""
SELECT entity, CAST(y AS INTEGER) AS year, make_date(CAST(y AS INTEGER), 1, 1) AS start,
  make_date(CAST(y AS INTEGER), 12, 31) AS "end"
FROM (SELECT entity, min(day) lo, max(day) hi FROM panel GROUP BY entity),
     LATERAL (SELECT unnest(generate_series(year(lo), year(hi))) AS y)""", upto="panel"))
def b04_year_chunks(spark, sf):
    """Inclusive calendar-year request chunks covering each entity's days."""
    return RL.year_chunks(panels.raw_panel(spark, sf))


@query("b05_range_filter", sql=with_base("""
SELECT entity, count(*) AS n_rows, avg(ndvi) AS mean_ndvi FROM panel
WHERE day BETWEEN DATE '2000-03-01' AND DATE '2000-05-31' AND ndvi IS NOT NULL GROUP BY entity""", upto="panel"))
def b05_range_filter(spark, sf):
    """Date-range + not-null filters pushed into the parquet scan."""
    p = panels.raw_panel(spark, sf)
    f = p.where(F.col("day").between(F.lit("2000-03-01").cast("date"), F.lit("2000-05-31").cast("date"))
                & F.col("ndvi").isNotNull())
    return f.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ndvi").alias("mean_ndvi"))


@query("b10_usable_rows", sql=with_base("""
SELECT split, count(*) FILTER (WHERE ndvi_missing = 0) AS usable,
  count(*) FILTER (WHERE split = 'train' AND ndvi_missing = 1) AS unlabeled_pool FROM featured GROUP BY split""",
    upto="featured"))
def b10_usable_rows(spark, sf):
    """Usable rows (ndvi_missing = 0) per split and the unlabeled self-training pool."""
    f = panels.featured(spark, sf)
    return f.groupBy("split").agg(
        F.count_if(F.col("ndvi_missing") == 0).alias("usable"),
        F.count_if((F.col("split") == "train") & (F.col("ndvi_missing") == 1)).alias("unlabeled_pool"))


def _users(spark, sf):
    """Users = suppliers: manager of their nation; the richest supplier per region is admin."""
    s = tables.read(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    u = s.join(n, s.s_nationkey == n.n_nationkey)
    # one row per region, aggregated map-side, instead of a window over all users
    top = u.groupBy("n_regionkey").agg(F.min(F.struct((-F.col("s_acctbal")).alias("b"), F.col("s_suppkey").alias("k"))).alias("t")) \
           .select(F.col("t.k").alias("admin_key"))
    return u.join(top, u["s_suppkey"] == top["admin_key"], "left").select(
        F.col("s_suppkey").alias("user_id"), F.col("n_name").alias("entity"),
        F.when(F.col("admin_key").isNotNull(), "admin").otherwise("manager").alias("role"))


@query("b13_row_scope", sql=with_base("""
SELECT u.user_id, u.role, sum(CASE WHEN u.role = 'admin' OR f.entity = u.entity THEN f.n ELSE 0 END)::BIGINT AS visible_rows FROM (
  SELECT s_suppkey AS user_id, n_name AS entity,
    CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) = 1
         THEN 'admin' ELSE 'manager' END AS role
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) u
CROSS JOIN (SELECT entity, count(*) AS n FROM fc GROUP BY entity) f GROUP BY u.user_id, u.role"""))
def b13_row_scope(spark, sf):
    """Forecast rows visible to each user: managers see their own entity, admins every one.

    A manager's scope is the equi-join :func:`relational.row_scope`; an admin's
    is the whole table, so it is counted once and not joined row by row."""
    fc, users = panels.forecasts(spark, sf).select("entity", "day"), _users(spark, sf)
    per = fc.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    every = fc.agg(F.count(F.lit(1)).alias("total"))
    mine = RL.row_scope(per, users).groupBy("user_id").agg(F.sum("n").alias("visible_rows"))
    managers = users.where("role = 'manager'").join(mine, "user_id", "left").select(
        "user_id", "role", F.coalesce("visible_rows", F.lit(0)).alias("visible_rows"))
    admins = users.where("role = 'admin'").withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").select(
        "user_id", "role", F.col("total").alias("visible_rows"))
    return managers.unionByName(admins)


@query("b14_known_entities", sql=with_base("""
SELECT entity, count(*) AS n_rows FROM (
  SELECT CASE WHEN l_suppkey % 7 = 0 THEN lower(n_name) || '?' ELSE n_name END AS entity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_returnflag <> 'N') x WHERE entity IN (SELECT entity FROM ents) GROUP BY entity""", upto="panel"))
def b14_known_entities(spark, sf):
    """Incoming rows kept only for known entities (left-semi to the dimension).

    Every seventh supplier reports under a misspelt name, which must be rejected."""
    from veldt.sources import panel as P
    li = tables.read(spark, sf, "lineitem", "l_suppkey", "l_returnflag").where("l_returnflag <> 'N'")
    s, n = tables.read(spark, sf, "supplier", "s_suppkey", "s_nationkey"), tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    px = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lower("n_name"), F.lit("?"))).otherwise(F.col("n_name")).alias("entity"))
    return RL.known_only(px, P.entities(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))


_FEEDS_SQL = """
fa AS (SELECT n_name AS entity, CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY ALL),
fb AS (SELECT n_name AS entity, CAST(l_shipdate AS DATE) AS day, count(*) AS n_lines
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       GROUP BY ALL)"""


@query("c01_full_outer_feeds", sql=with_base(
    "SELECT entity, day, n_orders, n_lines FROM fa FULL OUTER JOIN fb USING (entity, day)",
    upto="panel", extra=_FEEDS_SQL))
def c01_full_outer_feeds(spark, sf):
    """Two daily feeds full-outer-joined on (entity, day)."""
    o = tables.read(spark, sf, "orders", "o_custkey", "o_orderdate")
    c = tables.read(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    fa = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy(F.col("n_name").alias("entity"), F.to_date("o_orderdate").alias("day"))
           .agg(F.count(F.lit(1)).alias("n_orders")))
    px = PX.pixel_table(spark, sf)
    fb = px.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n_lines"))
    return RL.full_outer_feeds(fa, fb, ["entity", "day"])


@query("c09_insert_if_absent", sql=with_base("""
SELECT entity, count(*) AS n_new, min(day) AS first_new FROM fc n
WHERE NOT EXISTS (SELECT 1 FROM fc e WHERE e.entity = n.entity AND e.day = n.day AND e.day <= DATE '2001-06-30')
GROUP BY entity"""))
def c09_insert_if_absent(spark, sf):
    """All forecast rows not already stored (store = days <= 2001-06-30): left-anti."""
    fc = panels.forecasts(spark, sf)
    new = fc.select("entity", "day")
    existing = fc.where(F.col("day") <= F.lit("2001-06-30").cast("date")).select("entity", "day")
    ins = new.join(existing, ["entity", "day"], "left_anti")
    return ins.groupBy("entity").agg(F.count(F.lit(1)).alias("n_new"), F.min("day").alias("first_new"))


@query("c10_overview_with_meta", sql=with_base("""
SELECT e.entity, e.entity_id, e.ecosystem, l.day AS latest_date, greatest(l.fire_prob, l.drought_prob, l.veg_prob)
  AS max_risk FROM ents e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC)
  AS r FROM fc) WHERE r = 1) l ON e.entity = l.entity"""))
def c10_overview_with_meta(spark, sf):
    """Entity metadata left-joined with the latest forecast and its max risk."""
    from veldt.sources import panel as P
    l = R.latest_per_entity(panels.forecasts(spark, sf)).select(
        "entity", F.col("day").alias("latest_date"), F.greatest(*[F.col(c) for c in C.PROB_COLS]).alias("max_risk"))
    return P.entities(spark, sf).select("entity", "entity_id", "ecosystem").join(l, "entity", "left")


def _points(spark, sf):
    c = tables.read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("entity"), F.col("c_custkey").alias("pid"),
        (F.col("c_acctbal") / F.lit(100.0)).alias("lon"),
        (F.pmod(F.col("c_custkey"), F.lit(997)).cast("double") / F.lit(100.0)).alias("lat"))


_POINTS_SQL = """
pts AS (SELECT n_name AS entity, c_custkey AS pid, c_acctbal / 100.0 AS lon, CAST(c_custkey % 997 AS DOUBLE) / 100.0 AS lat
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
bb AS (SELECT entity, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat
       FROM pts GROUP BY entity),
quads AS (
  SELECT entity, 1 AS zone_no, 'North-West' AS zone_name, min_lon AS z_min_lon, (min_lat + max_lat) / 2 AS z_min_lat,
    (min_lon + max_lon) / 2 AS z_max_lon, max_lat AS z_max_lat FROM bb
  UNION ALL SELECT entity, 2, 'North-East', (min_lon + max_lon) / 2, (min_lat + max_lat) / 2, max_lon, max_lat FROM bb
  UNION ALL SELECT entity, 3, 'South-West', min_lon, min_lat, (min_lon + max_lon) / 2, (min_lat + max_lat) / 2 FROM bb
  UNION ALL SELECT entity, 4, 'South-East', (min_lon + max_lon) / 2, min_lat, max_lon, (min_lat + max_lat) / 2 FROM bb)"""


@query("h13_quadrant_zones", sql=with_base("SELECT * FROM quads", upto="panel", extra=_POINTS_SQL))
def h13_quadrant_zones(spark, sf):
    """Four quadrant zones per entity from the bbox midpoint of its points."""
    p = _points(spark, sf)
    bb = p.groupBy("entity").agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
                                 F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    return RL.quadrants(bb)


@query("h11_h12_polygon_centroid", sql=None, no_oracle="array/transform geometry; the circle's centre in tests/test_spatial_store.py")
def h11_h12_polygon_centroid(spark, sf):
    """Equal-area circle polygon per entity from its points' bbox, then shoelace centroid and bounds."""
    p = _points(spark, sf)
    g = p.groupBy("entity").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
                                F.count(F.lit(1)).cast("double").alias("area_km2"))
    rings = g.withColumn("ring", RL.circle_ring(F.col("lon"), F.col("lat"), F.col("area_km2")))
    return rings.withColumn("c", SP.ring_centre(F.col("ring"))).select(
        "entity", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"), RL.bounds(F.col("ring")).alias("bbox"),
        F.size("ring").alias("n_vertices"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))


_INC_SQL = """
inc AS (SELECT DISTINCT n_name AS entity, DATE '1995-01-01' + CAST((doc_id * 37) % 2405 AS INTEGER) AS inc_day
        FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE n_chars >= 200)"""


def incidents(spark, sf):
    """Every document as a report on an entity and a day; its confidence grows with its length."""
    d = tables.read(spark, sf, "documents", "doc_id", "n_chars")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    conf = F.when(F.col("n_chars") >= 1000, "High").when(F.col("n_chars") >= 200, " medium").otherwise("low")
    return d.join(n, F.pmod(d.doc_id, F.lit(25)) == n.n_nationkey).select(
        F.col("n_name").alias("entity"), F.lit("fire").alias("threat_type"), conf.alias("confidence"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(2405)).cast("int")).alias("inc_day"))


@query("c14_incident_backlabel", sql=with_base("""
SELECT p.entity, p.day, h.label FROM panel p
LEFT JOIN (SELECT DISTINCT p2.entity, p2.day, 1 AS label FROM panel p2 JOIN inc i ON p2.entity = i.entity
           AND p2.day BETWEEN i.inc_day - 30 AND i.inc_day) h ON p.entity = h.entity AND p.day = h.day""", upto="panel", extra=_INC_SQL))
def c14_incident_backlabel(spark, sf):
    """Trusted incidents, one per entity and day, label the days [D-30, D] with 1, all others stay NULL."""
    p = panels.raw_panel(spark, sf).select("entity", "day")
    inc = FS.trusted_incidents(incidents(spark, sf)).select("entity", F.col("inc_day").alias("target_day")).distinct()
    hits = SV.interval_join(p, inc, 30).select("entity", "day").distinct().withColumn("label", F.lit(1))
    return p.join(hits, ["entity", "day"], "left")


@query("d01_d02_pixel_zonal", sql=with_base("""
SELECT entity, day, avg(img) AS ndvi_s2, count(*) AS n_images FROM (
  SELECT n_name AS entity, CAST(l_shipdate AS DATE) AS day, l_orderkey AS image,
    avg(CASE WHEN l_extendedprice + l_extendedprice * (l_discount + l_tax) <> 0 THEN
      (l_extendedprice - l_extendedprice * (l_discount + l_tax)) / (l_extendedprice + l_extendedprice * (l_discount + l_tax))
      END) AS img
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE (l_linenumber & 3) = 0 AND l_discount * 1000.0 < 80.0
  GROUP BY ALL) GROUP BY entity, day""", upto="panel"))
def d01_d02_pixel_zonal(spark, sf):
    """Cloud-filtered scenes, QA-masked NDVI, per-image mean then daily mean of images."""
    return PX.daily_ndvi(PX.scene_filter(PX.pixel_table(spark, sf)), qa_bits=(0, 1))


@query("a08_fire_zonal_dedup", sql=with_base("""
SELECT entity, day, firms_count, firms_frp_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY source_rank, image) AS r FROM (
    SELECT n_name AS entity, CAST(l_shipdate AS DATE) AS day, l_orderkey AS image,
      CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS source_rank,
      count(*) FILTER (WHERE CAST(l_quantity AS INTEGER) >= 7) AS firms_count,
      avg(l_extendedprice / 1000.0) FILTER (WHERE CAST(l_quantity AS INTEGER) >= 7) AS firms_frp_mean
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
  WHERE firms_count > 0) WHERE r = 1""", upto="panel"))
def a08_fire_zonal_dedup(spark, sf):
    """Fire pixels (class >= 7) per image, detection days only, duplicates keep first source."""
    fz = PX.fire_zonal(PX.pixel_table(spark, sf))
    return PX.keep_first(fz, ["entity", "day"], [F.col("source_rank"), F.col("image")]).select(
        "entity", "day", "firms_count", "firms_frp_mean")


_SEQ_KEEP = ["split", "ndvi_missing", *C.LABEL_COLS]
_SEQ_SQL = "med AS (" + MEDIANS_SQL + "),\nf AS (SELECT entity, day, " + ", ".join(_SEQ_KEEP) + ", " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median FROM med WHERE feature = '{c}')) AS {c}" for c in C.FEATURE_COLS) + """ FROM featured),
s AS (SELECT *, row_number() OVER w AS rn, """ + ", ".join(f"lag({c}, 29) OVER w AS a_{c}" for c in C.FEATURE_COLS) + """ FROM f
  WINDOW w AS (PARTITION BY entity ORDER BY day))"""


@query("e14_sequences", sql=with_base("SELECT entity, day, " + ", ".join(_SEQ_KEEP) + ", 30 AS step, " + ", ".join(C.FEATURE_COLS)
    + " FROM s WHERE rn >= 30 AND (ndvi_missing = 0 OR split = 'train') UNION ALL SELECT entity, day, " + ", ".join(_SEQ_KEEP) + ", 1 AS step, "
    + ", ".join(f"a_{c}" for c in C.FEATURE_COLS) + " FROM s WHERE rn >= 30 AND (ndvi_missing = 0 OR split = 'train')",
    upto="featured", extra=_SEQ_SQL))
def e14_sequences(spark, sf):
    """30-day sequences of all 20 imputed features, ending at clean rows (labelled) and at train rows without NDVI
    (the unlabelled pool), keyed by (entity, day): first and last step of every one (E14, C16)."""
    f = panels.featured(spark, sf)
    med = ML.fit_medians(f.where("split = 'train' AND ndvi_missing = 0"))
    blocks = RL.sequence_blocks(ML.impute(f, med), ML.IMPUTED, 30, targets=(F.col("ndvi_missing") == 0) | (F.col("split") == "train"), keep=_SEQ_KEEP)
    seq = RL.expand_sequences(blocks, 30)
    steps = seq.select("entity", "day", *_SEQ_KEEP, F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.get("seq", F.lit(k - 1)).alias("v")) for k in (1, 30)])))
    return steps.select("entity", "day", *_SEQ_KEEP, "step", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate(C.FEATURE_COLS)])


@query("e18_centered_mean", sql=with_base("""
SELECT entity, day, ndvi, CASE WHEN count(ndvi) OVER w = 10 THEN avg(ndvi) OVER w END AS ndvi_centered
FROM panel WHERE ndvi IS NOT NULL
WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""", upto="panel"))
def e18_centered_mean(spark, sf):
    """Centred 10-observation NDVI mean over non-NULL rows."""
    return RL.centered_mean(panels.raw_panel(spark, sf).select("entity", "day", "ndvi"), "ndvi")


@query("g04_missing_entities", sql=with_base("""
SELECT n_name AS entity FROM nation EXCEPT ALL SELECT DISTINCT entity FROM (
  SELECT n_name AS entity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 480000)""", upto="panel"))
def g04_missing_entities(spark, sf):
    """Expected entities with no high-value urgent orders: distinct + exceptAll."""
    o = tables.read(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_totalprice").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 480000))
    c = tables.read(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    found = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("entity"))
    return RL.missing_keys(n.select(F.col("n_name").alias("entity")), found)


@query("g02_failed_chunks", sql=with_base("""
SELECT CAST(year(day) AS VARCHAR) AS chunk, CASE year(day) WHEN 1996 THEN 'corrupt' WHEN 1998 THEN 'failed' ELSE 'complete' END AS state,
  CASE WHEN year(day) <> 1998 THEN count(*) END AS expected, CASE WHEN year(day) NOT IN (1996, 1998) THEN count(*) ELSE 0 END AS found,
  CASE WHEN year(day) NOT IN (1996, 1998) THEN sum(precip_units) END AS units FROM panel GROUP BY year(day)""", upto="panel"))
def g02_failed_chunks(spark, sf):
    """Yearly chunks landed through a manifest: the one whose files are broken and the one whose fetch failed are
    reported and left out, the others are whole (G2)."""
    base = fresh_base(spark, "chunks")
    p = panels.raw_panel(spark, sf).select("entity", "day", "precip_units")
    for year in [r["y"] for r in p.select(F.year("day").alias("y")).distinct().collect()]:  # one row a year
        CH.land(base, str(year), p.where(F.year("day") == year) if year != 1998 else p.where(F.raise_error(F.lit("no answer")).isNull()))
    spark.range(3).select(F.lit("not parquet").alias("value")).write.mode("overwrite").text(CH.folder(base, "1996"))
    rows, report = CH.read(spark, base, "entity string, day date, precip_units bigint")
    units = rows.groupBy("chunk").agg(F.sum("precip_units").alias("units"))
    return report.join(units, "chunk", "left").select("chunk", "state", "expected", "found", "units")


@query("g01_union_by_name", sql=with_base("""
SELECT entity, count(*) AS n_rows, count(precipitation) AS n_precip, count(ndvi) AS n_ndvi FROM (
  SELECT entity, day, precipitation, NULL::DOUBLE AS ndvi FROM panel WHERE year(day) <= 1997
  UNION ALL SELECT entity, day, NULL::DOUBLE, ndvi FROM panel WHERE year(day) > 1997) GROUP BY entity""",
    upto="panel"))
def g01_union_by_name(spark, sf):
    """Union of per-period frames with different columns by name, missing -> NULL."""
    p = panels.raw_panel(spark, sf)
    a = p.where(F.year("day") <= 1997).select("entity", "day", "precipitation")
    b = p.where(F.year("day") > 1997).select("entity", "day", "ndvi")
    u = RL.union_frames([a, b])
    return u.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.count("precipitation").alias("n_precip"),
                                   F.count("ndvi").alias("n_ndvi"))


@query("h01_date_functions", sql=with_base("""
SELECT entity, day, CAST(month(day) AS INTEGER) AS month, CAST(dayofyear(day) AS INTEGER) AS doy,
  CAST(year(day) AS INTEGER) AS year, day + 30 AS plus_30, day - 90 AS minus_90,
  CAST(date_diff('day', DATE '1995-01-01', day) AS INTEGER) AS since_start, strftime(day, '%Y-%m-%d') AS iso
FROM panel""", upto="panel"))
def h01_date_functions(spark, sf):
    """month, day-of-year, year, date +/- n, date difference, ISO text (H1)."""
    p = panels.raw_panel(spark, sf)
    d = F.col("day")
    return p.select("entity", "day", F.month(d).alias("month"), F.dayofyear(d).alias("doy"), F.year(d).alias("year"),
                    F.date_add(d, 30).alias("plus_30"), F.date_sub(d, 90).alias("minus_90"),
                    F.datediff(d, F.lit("1995-01-01").cast("date")).alias("since_start"),
                    F.date_format(d, "yyyy-MM-dd").alias("iso"))


@query("h03_log_loss", sql=with_base("""
SELECT threat, -avg(y * ln(pc) + (1 - y) * ln(1 - pc)) AS log_loss, avg(ln(pc / (1 - pc))) AS mean_logit
FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS pc FROM ev) GROUP BY threat"""))
def h03_log_loss(spark, sf):
    """Clipped log-loss and mean logit per threat."""
    lg = panels.eval_long(spark, sf).withColumn("pc", S.clip(F.col("p"), 1e-7, 1 - 1e-7))
    ll = F.col("y") * F.log(F.col("pc")) + (F.lit(1) - F.col("y")) * F.log(F.lit(1.0) - F.col("pc"))
    return lg.groupBy("threat").agg((-F.avg(ll)).alias("log_loss"),
                                    F.avg(F.log(F.col("pc") / (F.lit(1.0) - F.col("pc")))).alias("mean_logit"))


@query("h08_h09_text_currency", sql=with_base("""
SELECT entity, list_aggregate(list_transform(string_split(label, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title,
  CAST(floor(usd * 1600.0 + 0.5) AS BIGINT) AS cost_local FROM (
  SELECT n_name AS entity, unnest(['fire_within_30d', 'drought_within_30d', 'vegetation_within_30d']) AS label,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS usd
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)""", upto="panel"))
def h08_h09_text_currency(spark, sf):
    """snake_case -> Title Case of the label names and fixed-rate currency conversion, half up, of order totals (H8, H9)."""
    o, c = tables.read(spark, sf, "orders", "o_custkey", "o_totalprice"), tables.read(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    usd = (o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy(F.col("n_name").alias("entity"))
           .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100.0).alias("usd")))
    x = usd.select("entity", "usd", F.explode(F.array(*[F.lit(v) for v in C.LABEL_COLS])).alias("label"))
    return x.select("entity", S.snake_to_title(F.col("label")).alias("title"), S.usd_to_local(F.col("usd")).alias("cost_local"))


@query("h16_json_field", sql="""
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum,
  max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type""")
def h16_json_field(spark, sf):
    """JSON field access on a nested payload column."""
    ev = tables.read(spark, sf, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("h18_first_non_null", sql=with_base("""
SELECT entity, coalesce(CAST(max(day) FILTER (WHERE ndvi IS NOT NULL) AS VARCHAR),
  CAST(max(day) FILTER (WHERE precipitation IS NOT NULL) AS VARCHAR), 'Pending') AS last_update
FROM panel GROUP BY entity""", upto="panel"))
def h18_first_non_null(spark, sf):
    """Last refresh text: first non-NULL of several candidates, else 'Pending' (H18)."""
    p = panels.raw_panel(spark, sf)
    return p.groupBy("entity").agg(S.first_non_null(
        F.max(F.when(F.col("ndvi").isNotNull(), F.col("day"))).cast("string"),
        F.max(F.when(F.col("precipitation").isNotNull(), F.col("day"))).cast("string"),
        F.lit("Pending")).alias("last_update"))


@query("f01_sorted_files", sql=with_base("SELECT count(*) AS n_rows, 0 AS rows_out_of_order, 0 AS files_that_overlap FROM fc"))
def f01_sorted_files(spark, sf):
    """Forecasts written in (entity, day) order over files and checked where they lie: rows that break a file's
    order and files that begin before another ends (F1)."""
    base = fresh_base(spark, "sorted")
    SO.write(panels.forecasts(spark, sf).select("entity", "day", *C.PROB_COLS), base, ["entity", "day"], files=8)
    return SO.order_report(spark.read.parquet(base), ["entity", "day"])


@query("a13_sorted_scan", sql=with_base("""
SELECT entity, day, fire_prob, veg_prob, row_number() OVER (ORDER BY entity, day) AS place FROM fc
WHERE entity IN ('NATION_3', 'NATION_11', 'NATION_20') AND day BETWEEN DATE '1996-02-01' AND DATE '1998-09-30' AND ndvi IS NOT NULL"""))
def a13_sorted_scan(spark, sf):
    """Entity, date and not-null predicates over the sorted files, rows in order with their place."""
    base = fresh_base(spark, "sorted")
    SO.write(panels.forecasts(spark, sf).select("entity", "day", "fire_prob", "veg_prob", "ndvi"), base, ["entity", "day"], files=8)
    got = SO.scan(spark.read.parquet(base), {"entity": ["NATION_3", "NATION_11", "NATION_20"]}, ("day", "1996-02-01", "1998-09-30"), ["ndvi"])
    return global_row_number(got, [F.col("entity"), F.col("day")], out="place").select("entity", "day", "fire_prob", "veg_prob", "place")


@query("f02_recent_history", sql=with_base("""
SELECT entity, day, fire_prob, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS recency FROM fc) WHERE recency <= 20"""))
def f02_recent_history(spark, sf):
    """Newest 20 rows per entity, newest first (F2): grouped top-k pruned by WindowGroupLimit."""
    return R.recent_n(panels.forecasts(spark, sf), 20).select("entity", "day", "fire_prob", "recency")


@query("f03_top_spike", sql=with_base("""
SELECT entity, day, threat, prob FROM (
  SELECT entity, day, 'Fire' AS threat, fire_prob AS prob, 0 AS ti FROM fc
  UNION ALL SELECT entity, day, 'Drought', drought_prob, 1 FROM fc
  UNION ALL SELECT entity, day, 'Vegetation', veg_prob, 2 FROM fc) ORDER BY prob DESC, day DESC, entity, ti LIMIT 10"""))
def f03_top_spike(spark, sf):
    """Top-10 entity-day x threat spikes over the whole history (F3): TakeOrderedAndProject."""
    fc = panels.forecasts(spark, sf)
    arr = F.array(*[F.struct(F.lit(n).alias("threat"), F.col(c).alias("prob"), F.lit(i).alias("ti"))
                    for i, (n, c) in enumerate(R.THREAT_PROB)])
    x = fc.select("entity", "day", F.inline(arr))
    return x.orderBy(F.col("prob").desc(), F.col("day").desc(), "entity", "ti").limit(10).drop("ti")


@query("f06_zone_listing", sql=with_base("""
SELECT n_name AS entity, c_mktsegment AS segment, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""", upto="panel"))
def f06_zone_listing(spark, sf):
    """Dimension listing: the zones of every entity."""
    from veldt.plans.q_allocate import zones
    return zones(spark, sf).select("entity", "segment", F.col("weight").cast("bigint").alias("n_customers"))


@query("f06_entity_listing", sql=with_base("""
SELECT n_nationkey AS entity_id, n_name AS entity, r_name AS ecosystem, row_number() OVER (ORDER BY n_nationkey) AS place
FROM nation JOIN region ON n_regionkey = r_regionkey""", upto="panel"))
def f06_entity_listing(spark, sf):
    """All entities in id order with their place."""
    from veldt.sources import panel as P
    return global_row_number(P.entities(spark, sf).select("entity_id", "entity", "ecosystem"), [F.col("entity_id")], out="place")
