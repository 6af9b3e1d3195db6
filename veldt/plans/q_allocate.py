"""Registered queries: allocation plans over data-derived what-if scenarios.

Scenario probabilities are each entity's latest deterministic forecast
(FIXTURES §4); the what-if grid crosses them with budgets and constraint
families, so the work grows with the number of entities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import allocate as A
from veldt.operators import readmodel as R
from veldt.plans import panels
from veldt.plans import sql_alloc as SA
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base

BUDGETS = [0.0, 3000.0, 5000.0, 8000.0, 10000.0, 15000.0]
SWEEP = [float(b) for b in range(2000, 20001, 1000)]
# family, budget, urgency floors?, disabled types, per-type caps, floor multiplier
FAMILIES = ([("plain", b, False, [], {}, 1.0) for b in BUDGETS]
            + [("urgent", 10000.0, True, [], {}, 1.0),
               ("no_water", 10000.0, True, ["water"], {}, 1.0),
               ("cap_patrol", 10000.0, True, [], {"patrol": 3}, 1.0),
               ("strict", 10000.0, True, ["patrol"], {"water": 2}, 2.5)])


def latest_probs(spark, sf):
    l = R.latest_per_entity(panels.forecasts(spark, sf))
    return l.select("entity", "entity_id", "day", F.col("fire_prob").alias("p_fire"),
                    F.col("drought_prob").alias("p_drought"), F.col("veg_prob").alias("p_veg"))


def scenario_grid(spark, sf, families=FAMILIES):
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(b).alias("budget"), F.lit(u).alias("use_floors"),
                              F.array(*[F.lit(x) for x in dis]).cast("array<string>").alias("disabled_types"),
                              F.map_from_arrays(F.array(*[F.lit(k) for k in caps]).cast("array<string>"),
                                                F.array(*[F.lit(v) for v in caps.values()]).cast("array<int>"))
                              .alias("type_caps"),
                              F.lit(m).alias("floor_mult"))
                     for f, b, u, dis, caps, m in families])
    s = latest_probs(spark, sf).select("*", F.inline(grid))
    s = A.urgency_floors(s)
    for t in C.THREATS:
        s = s.withColumn(f"floor_{t}", F.when(F.col("use_floors"), F.col(f"floor_{t}") * F.col("floor_mult"))
                         .otherwise(F.lit(0.0)))
    sid = F.concat_ws(":", F.col("entity"), F.col("family"), F.col("budget").cast("bigint").cast("string"))
    return s.withColumn("scenario_id", sid)


def plans_for(spark, sf, families=FAMILIES):
    """(plans, catalog); the plans of the standard families are solved once and stored."""
    cat = A.catalog_df(spark)
    if families is FAMILIES:
        return panels.materialized(spark, sf, "plans", lambda: A.solve(scenario_grid(spark, sf), cat)), cat
    return A.solve(scenario_grid(spark, sf, families), cat), cat


# ------------------------------------------------------------------ SQL side

def _grid_values(families) -> str:
    rows = []
    for f, b, u, dis, caps, m in families:
        dl = "[" + ", ".join(f"'{x}'" for x in dis) + "]::VARCHAR[]"
        cm = ("MAP {" + ", ".join(f"'{k}': {v}" for k, v in caps.items()) + "}") if caps else "MAP {}::MAP(VARCHAR, INTEGER)"
        rows.append(f"('{f}', {float(b)!r}::DOUBLE, {str(u).lower()}, {dl}, {cm}, {float(m)!r}::DOUBLE)")
    return ", ".join(rows)


def scen_ctes(families=FAMILIES) -> str:
    return f"""
lp AS (SELECT entity, entity_id, day, fire_prob AS p_fire, drought_prob AS p_drought, veg_prob AS p_veg FROM (
        SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fc) WHERE rn = 1),
grid AS (SELECT * FROM (VALUES {_grid_values(families)})
         g(family, budget, use_floors, disabled, type_caps, floor_mult)),
sc0 AS (SELECT lp.*, grid.*, {SA.floors_sql()} FROM lp, grid),
sc1 AS (SELECT * REPLACE (
          CASE WHEN use_floors THEN floor_fire * floor_mult ELSE 0.0 END AS floor_fire,
          CASE WHEN use_floors THEN floor_drought * floor_mult ELSE 0.0 END AS floor_drought,
          CASE WHEN use_floors THEN floor_vegetation * floor_mult ELSE 0.0 END AS floor_vegetation),
          entity || ':' || family || ':' || CAST(CAST(budget AS BIGINT) AS VARCHAR) AS scenario_id FROM sc0),
scen AS (SELECT * FROM {SA.scenario_norm_sql('sc1')})"""


def plan_ctes(families=FAMILIES, max_budget: float = 15000.0) -> str:
    return scen_ctes(families) + ",\n" + SA.enum_ctes(str(int(max_budget * 100))) + f""",
best AS {SA.best_sql('scen')},
plan AS (SELECT s.*, b.u0 IS NOT NULL AS feasible, {', '.join(f'coalesce(b.u{i}, 0) AS u{i}' for i in range(SA.N))},
           coalesce(s.p_fire * b.lin_fire + s.p_drought * b.lin_drought + s.p_veg * b.lin_vegetation, 0.0)
             AS linear_score
         FROM scen s LEFT JOIN best b ON s.scenario_id = b.scenario_id)"""


def _units_str(col="units"):
    return F.array_join(F.col(col), ",")


@query("k01_urgency_floors", sql=with_base(
    "SELECT entity, family, budget, floor_fire, floor_drought, floor_vegetation FROM sc1",
    extra=scen_ctes()))
def k01_urgency_floors(spark, sf):
    """Minimum spend per threat from urgency tiers, scaled into 80 % of budget (K1)."""
    return scenario_grid(spark, sf).select("entity", "family", "budget", "floor_fire", "floor_drought",
                                           "floor_vegetation")


@query("k02_unit_score", sql=with_base(
    "SELECT scenario_id, pos, id, p_fire * ef + p_drought * ed + p_veg * ev AS unit_score FROM scen, (VALUES "
    + ", ".join(f"({i}, '{r[0]}', {SA.d(r[5])}, {SA.d(r[6])}, {SA.d(r[7])})" for i, r in enumerate(C.CATALOG_ROWS))
    + ") c(pos, id, ef, ed, ev) WHERE family = 'urgent'", extra=scen_ctes()))
def k02_unit_score(spark, sf):
    """Linear per-unit score of every intervention for each entity's latest risk (K2)."""
    s = scenario_grid(spark, sf).where("family = 'urgent'")
    return A.unit_score(A.catalog_df(spark), s)


@query("k03_exact_allocation", sql=with_base(
    f"SELECT scenario_id, entity, family, budget, CASE WHEN feasible THEN 'Optimal' ELSE 'Infeasible' END AS status,"
    f" {SA.units_str_sql()} AS plan, linear_score FROM plan", extra=plan_ctes()))
def k03_exact_allocation(spark, sf):
    """Exact integer plan per scenario under budget, caps, toggles, floors and type caps (K3, C12 theta join, H10 map access)."""
    plans, _ = plans_for(spark, sf)
    return plans.select("scenario_id", "entity", "family", "budget", "status", _units_str().alias("plan"),
                        "linear_score")


@query("k04_risk_reduction", sql=with_base(
    f"SELECT scenario_id, {SA.risk_sql()} FROM plan", extra=plan_ctes()))
def k04_risk_reduction(spark, sf):
    """Multiplicative per-threat reduction, before/after and total score per plan (K4, K5)."""
    plans, cat = plans_for(spark, sf)
    rr = A.risk_reduction(plans, cat)
    cols = []
    for t in C.THREATS:
        cols += [f"eff_{t}", f"before_{t}", f"after_{t}", f"reduction_{t}", f"pct_{t}"]
    return rr.select("scenario_id", *cols, "total_score", "total_cost")


_ITEMS_SQL = ("SELECT scenario_id, pos, id, name, units, CAST(units AS DOUBLE) * cost AS cost FROM ("
              + " UNION ALL ".join(f"SELECT scenario_id, {i} AS pos, '{r[0]}' AS id, '{r[1]}' AS name, u{i} AS units, "
                                   f"{SA.d(r[3])} AS cost FROM plan" for i, r in enumerate(C.CATALOG_ROWS))
              + ") WHERE units > 0")


@query("k06_allocation_items", sql=with_base(_ITEMS_SQL, extra=plan_ctes()))
def k06_allocation_items(spark, sf):
    """Selected interventions (units > 0) with name and cost per scenario (K6)."""
    plans, cat = plans_for(spark, sf)
    return A.allocation_items(plans, cat)


def _baseline_sql(kind: str) -> str:
    rows = C.CATALOG_ROWS
    if kind == "even":
        us = [f"CASE WHEN n_en > 0 AND NOT list_contains(disabled, '{r[2]}') THEN "
              f"least({r[4]}, CAST(floor(budget / n_en / {SA.d(r[3])}) AS INTEGER)) ELSE 0 END AS u{i}"
              for i, r in enumerate(rows)]
        n_en = " + ".join(f"(CASE WHEN list_contains(disabled, '{r[2]}') THEN 0 ELSE 1 END)" for r in rows)
        inner = f"(SELECT *, ({n_en}) AS n_en FROM sc1)"
        return f"SELECT scenario_id, {', '.join(us)}, p_fire, p_drought, p_veg FROM {inner}"
    patrol = sorted([(r[3], i, r) for i, r in enumerate(rows) if r[2] == "patrol"])
    sel, rem = [], "budget"
    ctes = "sc1"
    body = []
    for cost, i, r in patrol:
        body.append((i, f"least({r[4]}, CAST(floor(({rem}) / {SA.d(cost)}) AS INTEGER))"))
        rem = f"({rem} - CAST(least({r[4]}, CAST(floor(({rem}) / {SA.d(cost)}) AS INTEGER)) AS DOUBLE) * {SA.d(cost)})"
    got = dict(body)
    us = [f"{got.get(i, '0')} AS u{i}" for i in range(len(rows))]
    return f"SELECT scenario_id, {', '.join(us)}, p_fire, p_drought, p_veg FROM {ctes}"


@query("k07_even_split", sql=with_base(
    f"SELECT scenario_id, {SA.units_str_sql()} AS plan, {SA.risk_sql()} FROM ({_baseline_sql('even')})",
    extra=scen_ctes()))
def k07_even_split(spark, sf):
    """Even-split baseline: budget / #enabled interventions, whole units (K7)."""
    cat = A.catalog_df(spark)
    e = A.even_split(scenario_grid(spark, sf), cat)
    return _baseline_out(A.risk_reduction(e, cat))


@query("k08_patrol_only", sql=with_base(
    f"SELECT scenario_id, {SA.units_str_sql()} AS plan, {SA.risk_sql()} FROM ({_baseline_sql('patrol')})",
    extra=scen_ctes()))
def k08_patrol_only(spark, sf):
    """Patrol-only greedy baseline, patrol catalog sorted by cost."""
    cat = A.catalog_df(spark)
    e = A.patrol_only(scenario_grid(spark, sf), cat)
    return _baseline_out(A.risk_reduction(e, cat))


def _baseline_out(rr):
    cols = []
    for t in C.THREATS:
        cols += [f"eff_{t}", f"before_{t}", f"after_{t}", f"reduction_{t}", f"pct_{t}"]
    return rr.select("scenario_id", _units_str().alias("plan"), *cols, "total_score", "total_cost")


@query("k09_strategy_comparison", sql=with_base(f"""
SELECT scenario_id, strategy, total_score, total_cost,
  100.0 * (max(total_score) OVER (PARTITION BY scenario_id) - total_score)
    / nullif(total_score, 0.0) AS best_uplift_pct
FROM (
  SELECT scenario_id, 'ILP (optimal)' AS strategy, {SA.risk_sql()} FROM plan
  UNION ALL SELECT scenario_id, 'Even split', {SA.risk_sql()} FROM ({_baseline_sql('even')})
  UNION ALL SELECT scenario_id, 'Patrol only', {SA.risk_sql()} FROM ({_baseline_sql('patrol')}))""",
    extra=plan_ctes()))
def k09_strategy_comparison(spark, sf):
    """ILP vs even split vs patrol-only per scenario with uplift of the best (K9)."""
    plans, cat = plans_for(spark, sf)
    scen = scenario_grid(spark, sf)
    ilp = A.risk_reduction(plans, cat).select("scenario_id", F.lit("ILP (optimal)").alias("strategy"),
                                              "total_score", "total_cost")
    ev = A.risk_reduction(A.even_split(scen, cat), cat).select(
        "scenario_id", F.lit("Even split").alias("strategy"), "total_score", "total_cost")
    pa = A.risk_reduction(A.patrol_only(scen, cat), cat).select(
        "scenario_id", F.lit("Patrol only").alias("strategy"), "total_score", "total_cost")
    u = ilp.unionByName(ev).unionByName(pa)
    from pyspark.sql import Window
    w = Window.partitionBy("scenario_id")
    return u.withColumn("best_uplift_pct", F.lit(100.0) * (F.max("total_score").over(w) - F.col("total_score"))
                        / F.nullif(F.col("total_score"), F.lit(0.0)))


SWEEP_FAMILIES = [("sweep", b, False, [], {}, 1.0) for b in SWEEP]


@query("k12_budget_sweep", sql=with_base(
    f"SELECT entity, budget, {SA.units_str_sql()} AS plan, linear_score, {SA.risk_sql()} FROM plan",
    extra=plan_ctes(SWEEP_FAMILIES, 20000.0)))
def k12_budget_sweep(spark, sf):
    """Plans for budgets $2k..$20k step $1k for every entity."""
    plans, cat = plans_for(spark, sf, SWEEP_FAMILIES)
    rr = A.risk_reduction(plans, cat)
    cols = []
    for t in C.THREATS:
        cols += [f"eff_{t}", f"before_{t}", f"after_{t}", f"reduction_{t}", f"pct_{t}"]
    return rr.select("entity", "budget", _units_str().alias("plan"), "linear_score", *cols, "total_score",
                     "total_cost")


@query("k16_infeasibility", sql=with_base("""
SELECT scenario_id, CASE WHEN feasible THEN 'Optimal' ELSE 'Infeasible' END AS status,
  CASE WHEN NOT feasible THEN 'Check if min_spend constraints exceed budget, or all relevant intervention types '
       || 'are toggled off.' END AS hint
FROM plan""", extra=plan_ctes()))
def k16_infeasibility(spark, sf):
    """Status and hint for every scenario; strict floors make some infeasible."""
    plans, _ = plans_for(spark, sf)
    hint = F.when(F.col("status") != "Optimal", F.lit(
        "Check if min_spend constraints exceed budget, or all relevant intervention types are toggled off."))
    return plans.select("scenario_id", "status", hint.alias("hint"))


# ------------------------------------------------------------------ K11 sensitivity

def urgent_scenarios(spark, sf):
    return scenario_grid(spark, sf, [f for f in FAMILIES if f[0] == "urgent"])


_SENS_CTES = (scen_ctes([f for f in FAMILIES if f[0] == "urgent"]) + """,
samples AS (SELECT CAST(range AS INTEGER) AS sample FROM range(0, 100)),
pc AS """ + SA.perturbed_sql() + ",\n" + SA.enum_ctes("1000000", per_sample="pc") + """,
sx AS (SELECT s.*, samples.sample FROM scen s, samples),
best AS """ + SA.best_sql("sx", sample_join=True) + """,
splan AS (SELECT s.scenario_id, s.sample, s.p_fire, s.p_drought, s.p_veg, b.u0 IS NOT NULL AS feasible, """
    + ", ".join(f"coalesce(b.u{i}, 0) AS u{i}" for i in range(SA.N)) + """
  FROM sx s LEFT JOIN best b ON s.scenario_id = b.scenario_id AND s.sample = b.sample),
sscore AS (SELECT *, """ + SA.risk_sql() + " FROM splan)")


def _squant(v: str, q: float) -> str:
    pos = f"({q!r} * CAST(len({v}) - 1 AS DOUBLE))"
    lo = f"CAST(floor({pos}) AS INTEGER)"
    a = f"{v}[{lo} + 1]"
    b = f"{v}[least({lo} + 2, len({v}))]"
    return f"({a} + ({pos} - CAST({lo} AS DOUBLE)) * ({b} - {a}))"


@query("k11_sensitivity", sql=with_base("""
SELECT scenario_id, avg(total_score) AS score_mean, stddev_pop(total_score) AS score_std,
  min(total_score) AS score_min, max(total_score) AS score_max,
  count(*) FILTER (WHERE feasible) AS n_optimal, count(*) AS n_samples,
  list_sort(list(total_score)) AS v
FROM sscore GROUP BY scenario_id""", extra=_SENS_CTES).replace(
    "SELECT scenario_id, avg(total_score) AS score_mean", "SELECT * EXCLUDE (v), " + _squant("v", 0.025)
    + " AS score_ci_lo, " + _squant("v", 0.975) + " AS score_ci_hi FROM (SELECT scenario_id, avg(total_score) AS score_mean", 1)
    + ")")
def k11_sensitivity(spark, sf):
    """Score distribution over 100 +-25 % perturbed catalogs per entity."""
    _, summ = A.sensitivity(urgent_scenarios(spark, sf), A.catalog_df(spark))
    return summ.select("scenario_id", "score_mean", "score_std", "score_min", "score_max", "n_optimal",
                       "n_samples", "score_ci_lo", "score_ci_hi")


@query("k11_selection_frequency", sql=with_base("""
SELECT scenario_id, id, selection_freq, units_mean, units_std,
  row_number() OVER (PARTITION BY scenario_id ORDER BY selection_freq DESC, id) AS place, CASE WHEN selection_freq >= 0.8 THEN 'core' WHEN selection_freq < 0.5 THEN 'opportunistic'
       ELSE 'conditional' END AS class
FROM (""" + " UNION ALL ".join(
    f"SELECT scenario_id, '{r[0]}' AS id, avg(CASE WHEN u{i} > 0 THEN 1.0 ELSE 0.0 END) AS selection_freq, "
    f"avg(CAST(u{i} AS DOUBLE)) AS units_mean, stddev_pop(CAST(u{i} AS DOUBLE)) AS units_std FROM sscore GROUP BY scenario_id"
    for i, r in enumerate(C.CATALOG_ROWS)) + ")", extra=_SENS_CTES))
def k11_selection_frequency(spark, sf):
    """How often each intervention is selected across perturbed catalogs; core/opportunistic."""
    _, summ = A.sensitivity(urgent_scenarios(spark, sf), A.catalog_df(spark))
    return A.selection_classes(summ, [r[0] for r in C.CATALOG_ROWS])


# ------------------------------------------------------------------ zones

def zones(spark, sf):
    """Zones = customer market segments of each entity; weight = customers in it."""
    from pyspark.sql import Window
    from veldt.sources import tables
    c = tables.read(spark, sf, "customer", "c_nationkey", "c_mktsegment")
    n = tables.read(spark, sf, "nation", "n_nationkey", "n_name")
    z = (c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("weight"))
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
          .select(F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("segment"), "weight"))
    w = Window.partitionBy("entity").orderBy("segment")
    return (z.withColumn("zone_idx", F.row_number().over(w) - 1)
             .withColumn("zone_id", F.concat_ws(":", "entity", "segment")))


ZONES_SQL = """zones AS (
  SELECT entity, zone_id, CAST(row_number() OVER (PARTITION BY entity ORDER BY segment) - 1 AS INTEGER) AS zone_idx,
    weight FROM (
    SELECT n_name AS entity, c_mktsegment AS segment, n_name || ':' || c_mktsegment AS zone_id,
      CAST(count(*) AS DOUBLE) AS weight
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment))"""

_LINES_SQL = "lines AS (" + " UNION ALL ".join(
    f"SELECT scenario_id, entity, {i} AS pos, u{i} AS units FROM plan WHERE u{i} > 0"
    for i in range(SA.N)) + ")"

_SPLIT_SQL = """zsplit AS (
  SELECT scenario_id, entity, pos, zone_id, CAST(fl + CASE WHEN r <= rem THEN 1 ELSE 0 END AS INTEGER) AS zone_units
  FROM (SELECT *, units - sum(fl) OVER (PARTITION BY scenario_id, entity, pos) AS rem,
          row_number() OVER (PARTITION BY scenario_id, entity, pos ORDER BY raw - fl DESC, (zone_idx + pos) % nz) AS r
        FROM (SELECT l.*, z.zone_id, z.zone_idx, z.nz, l.units * z.w / z.s AS raw,
                CAST(floor(l.units * z.w / z.s) AS INTEGER) AS fl
              FROM lines l JOIN (
                SELECT *, CASE WHEN wsum > 0 THEN weight ELSE 1.0 END AS w,
                  CASE WHEN wsum > 0 THEN CAST(wsum AS DOUBLE) ELSE CAST(nz AS DOUBLE) END AS s
                FROM (SELECT *, sum(weight) OVER (PARTITION BY entity) AS wsum,
                        count(*) OVER (PARTITION BY entity) AS nz FROM zones)) z USING (entity)))
  WHERE fl + CASE WHEN r <= rem THEN 1 ELSE 0 END > 0)"""

_ZONE_CTES = plan_ctes() + ",\n" + ZONES_SQL + ",\n" + _LINES_SQL + ",\n" + _SPLIT_SQL


def _zone_split(spark, sf):
    plans, cat = plans_for(spark, sf)
    lines = (A.explode_plan(plans, cat, keep=("scenario_id", "entity"))
             .where(F.col("units_n") > 0).select("scenario_id", "entity", "pos", F.col("units_n").alias("units")))
    return A.distribute_units(lines, zones(spark, sf), keys=("scenario_id",)), cat


@query("k13_zone_split", sql=with_base("SELECT * FROM zsplit", extra=_ZONE_CTES))
def k13_zone_split(spark, sf):
    """Largest-remainder split of each plan line over the entity's zones."""
    z, _ = _zone_split(spark, sf)
    return z


_CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', {SA.d(r[3])})" for i, r in enumerate(C.CATALOG_ROWS)) + ") c(pos, id, name, cost))"


@query("c11_zone_allocation_lines", sql=with_base("""
SELECT z.scenario_id, z.zone_id, c.id AS intervention_id, c.name AS intervention_name, z.zone_units AS units,
  CAST(z.zone_units AS DOUBLE) * c.cost AS cost
FROM zsplit z JOIN cat c USING (pos)""", extra=_ZONE_CTES + ",\n" + _CAT_SQL))
def c11_zone_allocation_lines(spark, sf):
    """Intervention x zone allocation rows with names and cost, zero-unit rows dropped (C11)."""
    z, cat = _zone_split(spark, sf)
    return z.join(F.broadcast(cat), "pos").select(
        "scenario_id", "zone_id", F.col("id").alias("intervention_id"), F.col("name").alias("intervention_name"),
        F.col("zone_units").alias("units"), (F.col("zone_units") * F.col("cost")).alias("cost"))


@query("d19_zone_shading", sql=with_base("""
SELECT scenario_id, zone_id, units, 0.15 + 0.55 * units / greatest(1, max(units) OVER (PARTITION BY scenario_id))
  AS shade FROM (SELECT scenario_id, zone_id, CAST(sum(zone_units) AS BIGINT) AS units FROM zsplit
                 GROUP BY scenario_id, zone_id)""", extra=_ZONE_CTES))
def d19_zone_shading(spark, sf):
    """Units per zone and map shade 0.15 + 0.55 * u / max(1, max u)."""
    from pyspark.sql import Window
    z, _ = _zone_split(spark, sf)
    per = z.groupBy("scenario_id", "zone_id").agg(F.sum("zone_units").alias("units"))
    mx = F.greatest(F.lit(1), F.max("units").over(Window.partitionBy("scenario_id")))
    return per.withColumn("shade", F.lit(0.15) + F.lit(0.55) * F.col("units") / mx)


@query("c17_referential_check", sql=with_base("""
SELECT entity, count(*) AS n_violations, sum(zone_units)::BIGINT AS units FROM (
  SELECT entity, zone_units, CASE WHEN zone_units >= 3 THEN 'ELSEWHERE:' || zone_id ELSE zone_id END AS zone_id FROM zsplit) zs
WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.entity = zs.entity AND z.zone_id = zs.zone_id) GROUP BY entity""", extra=_ZONE_CTES))
def c17_referential_check(spark, sf):
    """Allocation lines whose zone is not one of the entity's (C17); lines of three units or more are sent elsewhere first."""
    z, _ = _zone_split(spark, sf)
    moved = z.withColumn("zone_id", F.when(F.col("zone_units") >= 3, F.concat(F.lit("ELSEWHERE:"), F.col("zone_id")))
                         .otherwise(F.col("zone_id")))
    return A.referential_violations(moved, zones(spark, sf)).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_violations"), F.sum("zone_units").alias("units"))


# ------------------------------------------------------------------ K14 / K15 / S8

def _scored_plans(spark, sf):
    plans, cat = plans_for(spark, sf)
    return A.risk_reduction(plans, cat), cat


_TXT = {t: C.THREAT_TEXT[t] for t in C.THREATS}


def _tier_sql(p):
    return f"(CASE WHEN {p} >= 0.85 THEN 'critical' WHEN {p} >= 0.70 THEN 'high' WHEN {p} >= 0.50 THEN 'moderate' ELSE 'low' END)"


_RAT_CTES = plan_ctes() + f""",
rp AS (SELECT *, {SA.risk_sql()} FROM plan),
prof AS (
  SELECT scenario_id, string_agg(lbl || ' ' || CAST(CAST(floor(p * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% ('
                                 || {_tier_sql('p')} || ')', ', ' ORDER BY p DESC, i) AS profile
  FROM (SELECT scenario_id, p_fire AS p, 0 AS i, '{_TXT['fire']}' AS lbl FROM rp
        UNION ALL SELECT scenario_id, p_drought, 1, '{_TXT['drought']}' FROM rp
        UNION ALL SELECT scenario_id, p_veg, 2, '{_TXT['vegetation']}' FROM rp) GROUP BY scenario_id),
fl AS (
  SELECT scenario_id,
    string_agg(lbl, ' and ' ORDER BY f DESC, i) AS names,
    string_agg(CAST(CAST(floor(f / budget * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of the budget on ' || lbl, ', '
               ORDER BY f DESC, i) AS floor_txt
  FROM (SELECT scenario_id, budget, floor_fire AS f, 0 AS i, '{_TXT['fire']}' AS lbl FROM rp
        UNION ALL SELECT scenario_id, budget, floor_drought, 1, '{_TXT['drought']}' FROM rp
        UNION ALL SELECT scenario_id, budget, floor_vegetation, 2, '{_TXT['vegetation']}' FROM rp)
  WHERE f > 0 GROUP BY scenario_id)"""


@query("k14_rationale", sql=with_base("""
SELECT rp.scenario_id,
  'Current 30-day risk is ' || prof.profile || '. The plan spends on the highest risks first, staying within budget.'
    AS summary,
  CASE WHEN fl.names IS NOT NULL THEN 'Because ' || fl.names
       || ' risk is elevated, the planner reserved a minimum spend (' || fl.floor_txt
       || ') before allocating the rest to the best overall value.' END AS floor_note,
  CASE WHEN budget <= 0 THEN 'No budget was available, so no interventions were selected.'
       WHEN floor(total_cost / budget * 100 + 0.5) < 95 THEN 'The plan uses about '
         || CAST(CAST(floor(total_cost / budget * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of the budget. The rest is '
         || 'left unspent because the most effective interventions reached their capacity limits, and weaker ones '
         || 'would not reduce risk enough to be worthwhile.'
       ELSE 'The plan uses essentially the full budget, placing it where it removes the most risk.' END AS budget_note
FROM rp JOIN prof USING (scenario_id) LEFT JOIN fl USING (scenario_id)""", extra=_RAT_CTES))
def k14_rationale(spark, sf):
    """Plain-language risk profile, floor note and budget-use note per plan."""
    rr, cat = _scored_plans(spark, sf)
    return A.rationale(rr, cat).select("scenario_id", "summary", "floor_note", "budget_note")


@query("k14_item_reasons", sql=with_base("""
SELECT scenario_id, id, 'Targets ' || lbl || ' risk: ' || CAST(CAST(floor(e * 100 + 0.5) AS BIGINT) AS VARCHAR)
  || '% reduction per unit.' AS reason
FROM (SELECT l.scenario_id, c.id, t.lbl, t.e, row_number() OVER (PARTITION BY l.scenario_id, l.pos
        ORDER BY t.contrib DESC, t.i) AS r
      FROM lines2 l JOIN cat2 c USING (pos),
      LATERAL (SELECT * FROM (VALUES (0, '""" + _TXT["fire"] + """', l.p_fire * c.ef, c.ef),
                                     (1, '""" + _TXT["drought"] + """', l.p_drought * c.ed, c.ed),
                                     (2, '""" + _TXT["vegetation"] + """', l.p_veg * c.ev, c.ev)) v(i, lbl, contrib, e)) t)
WHERE r = 1""", extra=_RAT_CTES + ",\nlines2 AS (" + " UNION ALL ".join(
    f"SELECT scenario_id, {i} AS pos, p_fire, p_drought, p_veg FROM plan WHERE u{i} > 0" for i in range(SA.N))
    + "),\ncat2 AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{r[0]}', {SA.d(r[5])}, {SA.d(r[6])}, {SA.d(r[7])})" for i, r in enumerate(C.CATALOG_ROWS))
    + ") c(pos, id, ef, ed, ev))"))
def k14_item_reasons(spark, sf):
    """Per selected intervention: the threat it most reduces and its per-unit effect."""
    rr, cat = _scored_plans(spark, sf)
    return A.item_reasons(A.allocation_items(rr, cat), rr, cat).select("scenario_id", "id", "reason")


def _even_patrol(spark, sf, scen, cat):
    ev = A.risk_reduction(A.even_split(scen, cat), cat).select(
        "scenario_id", F.col("total_score").alias("even_score"), F.col("total_cost").alias("even_cost"))
    pa = A.risk_reduction(A.patrol_only(scen, cat), cat).select(
        "scenario_id", F.col("total_score").alias("patrol_score"), F.col("total_cost").alias("patrol_cost"))
    return ev, pa


@query("k15_full_response", sql=with_base("""
SELECT rp.scenario_id, rp.entity, CASE WHEN feasible THEN 'Optimal' ELSE 'Infeasible' END AS status,
  """ + SA.units_str_sql("rp.") + """ AS plan, rp.total_cost, rp.total_score,
  rp.floor_fire, rp.floor_drought, rp.floor_vegetation,
  rp.p_fire AS current_fire, rp.p_drought AS current_drought, rp.p_veg AS current_vegetation,
  rp.after_fire AS post_fire, rp.after_drought AS post_drought, rp.after_vegetation AS post_vegetation,
  e.total_score AS even_score, e.total_cost AS even_cost, pt.total_score AS patrol_score,
  pt.total_cost AS patrol_cost
FROM rp JOIN (SELECT scenario_id, """ + SA.risk_sql() + " FROM (" + _baseline_sql("even") + """)) e USING (scenario_id)
JOIN (SELECT scenario_id, """ + SA.risk_sql() + " FROM (" + _baseline_sql("patrol") + """)) pt USING (scenario_id)""",
    extra=_RAT_CTES))
def k15_full_response(spark, sf):
    """Whole recommendation per scenario: plan, floors, before/after, baselines."""
    rr, cat = _scored_plans(spark, sf)
    scen = scenario_grid(spark, sf)
    ev, pa = _even_patrol(spark, sf, scen, cat)
    out = rr.select("scenario_id", "entity", "status", _units_str().alias("plan"), "total_cost", "total_score",
                    "floor_fire", "floor_drought", "floor_vegetation",
                    F.col("p_fire").alias("current_fire"), F.col("p_drought").alias("current_drought"),
                    F.col("p_veg").alias("current_vegetation"), F.col("after_fire").alias("post_fire"),
                    F.col("after_drought").alias("post_drought"), F.col("after_vegetation").alias("post_vegetation"))
    return out.join(ev, "scenario_id").join(pa, "scenario_id")


@query("s08_recommendation_rows", sql=with_base("""
SELECT count(*) AS n_headers, count(DISTINCT scenario_id) AS n_distinct, sum(total_cost) AS spend,
  sum(CAST(total_cost AS DECIMAL(12,2))) AS spend_decimal
FROM rp""", extra=_RAT_CTES))
def s08_recommendation_rows(spark, sf):
    """Recommendation headers with deterministic ids and DECIMAL(12,2) money."""
    rr, _ = _scored_plans(spark, sf)
    hdr = rr.select(A.recommendation_id(F.col("entity"), F.col("day"), F.col("budget"), F.col("scenario_id"))
                    .alias("recommendation_id"), "scenario_id",
                    F.col("budget").cast("decimal(12,2)").alias("budget"),
                    F.col("total_cost").cast("decimal(12,2)").alias("total_cost_dec"), "total_cost",
                    F.col("total_score").cast("decimal(8,6)").alias("total_risk_reduction"))
    return hdr.agg(F.count(F.lit(1)).alias("n_headers"), F.count_distinct("recommendation_id").alias("n_distinct"),
                   F.sum("total_cost").alias("spend"), F.sum("total_cost_dec").cast("double").alias("spend_decimal"))
