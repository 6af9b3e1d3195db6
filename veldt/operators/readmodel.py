"""Read-model queries over a forecast table.

Forecast table: ``(entity, day, fire_prob, drought_prob, veg_prob, ...)``.
Per-entity questions use windows partitioned by entity (one exchange);
cross-entity rankings use the distributed ``global_row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.functions import scalar as S
from veldt.functions.ranking import global_row_number

THREAT_PROB = [("Fire", "fire_prob"), ("Drought", "drought_prob"), ("Vegetation", "veg_prob")]


def latest_per_entity(fc: DataFrame, key: str = "entity", day: str = "day") -> DataFrame:
    """Latest row per entity (E19); ``WindowGroupLimit`` prunes before the sort."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return fc.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recent_n(fc: DataFrame, n: int, key: str = "entity", day: str = "day") -> DataFrame:
    """The most recent ``n`` rows per entity (limit applied newest-first, E20)."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return fc.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def week_ago(fc: DataFrame, lag_days: int = 7, tol_days: int = 4, key: str = "entity",
             day: str = "day", cols=("fire_prob", "drought_prob", "veg_prob")) -> DataFrame:
    """Per entity: the row nearest to (latest - lag_days) within tol_days, the
    latest itself excluded, earliest day winning ties (C8).

    The latest days are one small aggregate joined back, so rows outside the tolerance are
    dropped before anything is shuffled."""
    latest = fc.groupBy(key).agg(F.max(day).alias("_latest"))
    x = fc.select(key, day, *cols).join(latest, key)
    diff = F.abs(F.datediff(F.col(day), F.date_sub(F.col("_latest"), lag_days)))
    cand = x.where((F.col(day) != F.col("_latest")) & (diff <= tol_days))
    best = F.min_by(F.struct(F.col(day).alias("wa_day"), *[F.col(c).alias(f"wa_{c}") for c in cols]),
                    F.struct(diff, F.col(day)))
    return cand.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def week_over_week(fc: DataFrame, key: str = "entity") -> DataFrame:
    """Latest row + week-ago row + delta points per threat (E22, T20 rounding)."""
    latest = latest_per_entity(fc, key)
    wa = week_ago(fc, key=key)
    j = latest.join(wa, key, "left")
    for _, c in THREAT_PROB:
        j = j.withColumn(f"dp_{c}", S.js_round((F.col(c) - F.coalesce(F.col(f"wa_{c}"), F.col(c))) * 100.0))
    return j


def dominant(cols=THREAT_PROB):
    """(name, value) of the highest threat; first in list order wins ties."""
    best_name = F.lit(cols[0][0])
    best_val = F.col(cols[0][1])
    for name, c in cols[1:]:
        better = F.col(c) > best_val
        best_name = F.when(better, F.lit(name)).otherwise(best_name)
        best_val = F.when(better, F.col(c)).otherwise(best_val)
    return best_name, best_val


def alerts(wow: DataFrame) -> DataFrame:
    """Operational alert per entity (H15): high >= .66, or climbing >= 5 pts at p >= .4."""
    name, v = dominant()
    dp = F.lit(0)
    for n, c in THREAT_PROB:
        dp = F.when(name == n, F.when(F.col("wa_day").isNotNull(),
                                      S.js_round((F.col(c) - F.col(f"wa_{c}")) * 100.0))
                    .otherwise(F.lit(0))).otherwise(dp)
    x = wow.select("entity", "day", name.alias("top_threat"), v.alias("top_prob"), dp.alias("delta_pts"))
    high = F.col("top_prob") >= F.lit(C.RISK_HIGH)
    climbing = (F.col("delta_pts") >= 5) & (F.col("top_prob") >= 0.4)
    trend = (F.when(F.col("delta_pts") <= -2, ", though easing this week")
              .when(F.col("delta_pts") >= 2, " and still rising").otherwise(""))
    msg = (F.when(high, F.concat(F.col("top_threat"), F.lit(" is the top threat at "), S.pct_text(F.col("top_prob")),
                                 F.lit(" (high"), trend, F.lit(").")))
            .when(climbing, F.concat(F.col("top_threat"), F.lit(" risk has climbed "),
                                     F.col("delta_pts").cast("string"), F.lit(" pts this week to "),
                                     S.pct_text(F.col("top_prob")), F.lit("."))))
    return (x.withColumn("alert_level", F.when(high, "high").when(climbing, "medium"))
             .withColumn("message", msg))


def national_trend(fc: DataFrame, days: int = 60) -> DataFrame:
    """Daily cross-entity average per threat over the last ``days`` dates."""
    latest = fc.select(F.max("day")).scalar()
    return (fc.where(F.col("day") >= F.date_sub(latest, days - 1))
              .groupBy("day")
              .agg(F.avg("fire_prob").alias("fire"), F.avg("drought_prob").alias("drought"),
                   F.avg("veg_prob").alias("veg")))


def overview(latest: DataFrame) -> DataFrame:
    """National overview numbers from the latest row per entity.

    One aggregate: high-risk count, mean per threat, and the single highest
    entity x threat spike via ``max_by`` (ties -> lowest entity id, threat order)."""
    mx = F.greatest(*[F.col(c) for _, c in THREAT_PROB])
    spikes = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("ti"), F.lit(n).alias("threat"))
                       for i, (n, c) in enumerate(THREAT_PROB)])
    x = latest.withColumn("_max", mx).withColumn("_spike", F.array_max(spikes))
    agg = x.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col("_max") >= F.lit(C.RISK_HIGH)).alias("high_count"),
        F.avg("fire_prob").alias("avg_fire"), F.avg("drought_prob").alias("avg_drought"),
        F.avg("veg_prob").alias("avg_veg"),
        F.max_by(F.col("entity"), F.struct(F.col("_max"), -F.col("entity_id"))).alias("top_entity"),
        F.max_by(F.struct(F.col("entity").alias("e"), F.col("_spike.threat").alias("t"), F.col("_spike.v").alias("v")),
                 F.struct(F.col("_spike.v"), -F.col("entity_id"), F.col("_spike.ti"))).alias("_s"),
        F.max("day").alias("latest_date"))
    name = (F.when((F.col("avg_drought") > F.col("avg_fire")) & (F.col("avg_drought") >= F.col("avg_veg")), "Drought")
             .when((F.col("avg_veg") > F.col("avg_fire")) & (F.col("avg_veg") > F.col("avg_drought")), "Vegetation")
             .otherwise("Fire"))
    return agg.select("n_entities", "high_count", "avg_fire", "avg_drought", "avg_veg",
                      name.alias("dominant_threat"), "top_entity",
                      F.col("_s.e").alias("spike_entity"), F.col("_s.t").alias("spike_threat"),
                      F.col("_s.v").alias("spike_prob"), "latest_date")


def entity_ranking(latest: DataFrame) -> DataFrame:
    """Entities ranked by their highest threat (E21), distributed global order."""
    name, v = dominant()
    x = latest.select("entity", "entity_id", "day", *[c for _, c in THREAT_PROB],
                      F.greatest(*[F.col(c) for _, c in THREAT_PROB]).alias("max_risk"),
                      name.alias("dominant_threat"))
    return global_row_number(x, [F.col("max_risk").desc(), F.col("entity_id").asc()], out="priority")


def threat_ranking(latest: DataFrame) -> DataFrame:
    """Threats ranked within each row, highest first (E21): unpivot + row_number."""
    long = latest.select("entity", "day", *[c for _, c in THREAT_PROB]).unpivot(
        ["entity", "day"], [c for _, c in THREAT_PROB], "threat_col", "prob")
    order = F.when(F.col("threat_col") == "fire_prob", 0).when(F.col("threat_col") == "drought_prob", 1).otherwise(2)
    w = Window.partitionBy("entity", "day").orderBy(F.col("prob").desc(), order)
    return (long.withColumn("threat", F.when(order == 0, "Fire").when(order == 1, "Drought").otherwise("Vegetation"))
                .withColumn("rank", F.row_number().over(w))
                .withColumn("band", S.risk_band(F.col("prob")))
                .withColumn("pct", S.pct_points(F.col("prob")))
                .drop("threat_col"))


def drivers(serve_latest: DataFrame, spec: DataFrame) -> DataFrame:
    """Forecast drivers (J25): unpivot serving features x spec dim -> value text + impact.

    ``spec``: (threat, position, feature, label, unit, direction, threshold)."""
    long = serve_latest.select("entity", "day", *C.FEATURE_COLS).unpivot(
        ["entity", "day"], C.FEATURE_COLS, "feature", "value")
    j = long.join(F.broadcast(spec), "feature")  # spec: 12 fixed rows
    return j.select("entity", "day", "threat", "position", "label",
                    S.fmt_value(F.col("value"), F.col("unit")).alias("value_text"),
                    S.impact(F.col("value"), F.col("direction"), F.col("threshold")).alias("impact"))
