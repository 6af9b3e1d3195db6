"""Registered queries: persisted recommendations and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import allocate as A
from veldt.operators import store as ST
from veldt.plans import q_allocate as QA
from veldt.plans.q_allocate import _CAT_SQL, _RAT_CTES, _SPLIT_SQL, _LINES_SQL, ZONES_SQL, _scored_plans, _zone_split
from veldt.plans.registry import ORACLES, query
from veldt.plans.sql_base import with_base
from veldt.streaming.daily import fresh_base


def _persisted(spark, sf):
    """Stores after three writes: all recommendations, all of them once more with other numbers (which
    must not count), and the first write repeated under its own version."""
    plans, _ = _scored_plans(spark, sf)
    headers = plans.select(
        A.recommendation_id(F.col("entity"), F.col("day"), F.col("scenario_id")).alias("recommendation_id"), "entity", "scenario_id",
        F.col("budget").cast("decimal(12,2)").alias("budget"), F.col("total_cost").cast("decimal(12,2)").alias("total_cost"),
        F.round("total_score", 6).cast("decimal(8,6)").alias("total_risk_reduction"),
        (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("budget").cast("decimal(18,6)"))).alias("created_at"))
    split, cat = _zone_split(spark, sf)
    lines = (split.join(F.broadcast(cat), "pos").join(headers.select("scenario_id", "recommendation_id"), "scenario_id")
             .select("recommendation_id", F.col("id").alias("intervention_id"), "zone_id", "entity", F.col("zone_units").cast("int").alias("units"),
                     (F.col("zone_units") * F.col("cost")).cast("decimal(12,2)").alias("total_cost")))
    held, parts = ST.recommendation_stores(spark, fresh_base(spark, "recommendations"))
    for version, factor in ((0, 1), (1, 7), (0, 1)):
        held.write(headers.withColumn("budget", (F.col("budget") * factor).cast("decimal(12,2)")), version)
        parts.write(lines.withColumn("units", F.col("units") * factor), version)
    return held, parts


@query("s08_persisted_allocations", sql=with_base("""
SELECT z.scenario_id, z.entity, c.id AS intervention_id, z.zone_id, z.zone_units AS units,
  CAST(z.zone_units AS DOUBLE) * c.cost AS total_cost FROM zsplit z JOIN cat c USING (pos)""",
    extra=_RAT_CTES + ",\n" + ZONES_SQL + ",\n" + _LINES_SQL + ",\n" + _SPLIT_SQL + ",\n" + _CAT_SQL))
def s08_persisted_allocations(spark, sf):
    """Allocation lines read back with their headers after repeated writes: unique by (recommendation,
    intervention, zone), the first values kept (S8)."""
    held, parts = _persisted(spark, sf)
    return parts.read().join(held.read().select("recommendation_id", "scenario_id"), "recommendation_id").select(
        "scenario_id", "entity", "intervention_id", "zone_id", "units", "total_cost")


@query("f02_recommendation_history", sql=with_base("""
SELECT entity, scenario_id, budget, total_cost, round(total_score, 6) AS total_risk_reduction,
  CAST(day AS TIMESTAMP) + to_seconds(CAST(budget AS BIGINT)) AS created_at
FROM rp QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CAST(day AS TIMESTAMP) + to_seconds(CAST(budget AS BIGINT)) DESC,
  sha256(concat_ws(chr(31), entity, CAST(day AS VARCHAR), scenario_id))) <= 5""", extra=_RAT_CTES))
def f02_recommendation_history(spark, sf):
    """The five newest stored recommendations of every entity (F2)."""
    held, _ = _persisted(spark, sf)
    return ST.history(held, 5).select("entity", "scenario_id", "budget", "total_cost", "total_risk_reduction", "created_at")


_LINE_SQL = "zone_id || ' ' || intervention_id || ' x' || CAST(units AS BIGINT)"


@query("k15_recommendation_response", sql=f"""
SELECT f.*, r.summary, r.floor_note, r.budget_note, coalesce(z.n_zone_lines, 0) AS n_zone_lines, coalesce(z.zone_lines, '') AS zone_lines, z.zone_cost
FROM ({ORACLES['k15_full_response']}) f JOIN ({ORACLES['k14_rationale']}) r USING (scenario_id)
LEFT JOIN (SELECT scenario_id, count(*) AS n_zone_lines, string_agg({_LINE_SQL}, '; ' ORDER BY {_LINE_SQL}) AS zone_lines, sum(cost) AS zone_cost
           FROM ({ORACLES['c11_zone_allocation_lines']}) GROUP BY scenario_id) z USING (scenario_id)""")
def k15_recommendation_response(spark, sf):
    """The whole response of a recommendation: plan, floors, before and after, baselines, zone lines and rationale."""
    lines = QA.c11_zone_allocation_lines.raw(spark, sf)
    text = F.concat("zone_id", F.lit(" "), "intervention_id", F.lit(" x"), F.col("units").cast("bigint").cast("string"))
    per = lines.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_zone_lines"), F.sum("cost").alias("zone_cost"),
                                           F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("zone_lines"))  # interventions x zones of one plan
    out = QA.k15_full_response.raw(spark, sf).join(QA.k14_rationale.raw(spark, sf), "scenario_id").join(per, "scenario_id", "left")
    return out.na.fill(0, ["n_zone_lines"]).na.fill("", ["zone_lines"])
