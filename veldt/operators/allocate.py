"""Budget-constrained intervention plans for many scenarios at once.

Exact solver, re-expressed for Spark (K3): branch and bound as a chain of
generators.  Every distinct what-if (budget, risks, floors, toggles, caps, and
its own catalog where it has one) is one row.  For each catalog item the row
is exploded over the item's units, and a partial vector goes on only if it can
still satisfy every constraint and still reach the score of a greedy plan.  So
there is no table of candidates, no join of what-ifs with vectors and no limit
on catalog items or vectors; work grows with the distinct what-ifs and is
spread over tasks by them.  Costs are exact integer cents.

Objective: linear score sum_t p_t * sum_i eff_it * u_i rounded to 9 digits;
ties: cheaper first, then larger units in catalog order (T12).  The order is
carried in one ``max(struct)`` that combines inside the generating stage.

Scenarios with no feasible vector are ``Infeasible`` with an all-zero plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt import config as C

THREATS = C.THREATS
EFF = {"fire": "eff_fire", "drought": "eff_drought", "vegetation": "eff_veg"}
PROB = {"fire": "p_fire", "drought": "p_drought", "vegetation": "p_veg"}
TYPES = C.INTERVENTION_TYPES


def rnd(c: Column, digits: int) -> Column:
    """Half-up rounding by plain IEEE arithmetic (identical in any SQL engine)."""
    k = float(10 ** digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


# ----------------------------------------------------------------- catalog

def catalog_df(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows or C.CATALOG_ROWS
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "pos int, id string, name string, type string, cost double, max_units int, "
              "eff_fire double, eff_drought double, eff_veg double")


def _catalog_items(catalog: DataFrame) -> list:
    """The catalog is a dimension of a few rows; it shapes the plan (one
    generator per item), so it is read on the driver."""
    return [r.asDict() for r in catalog.orderBy("pos").collect()]


def unit_score(catalog: DataFrame, scen: DataFrame) -> DataFrame:
    """Per scenario x intervention linear score sum_t p_t * eff_it (K2).

    The catalog rows are inlined as a generator (``inline`` of an array of
    structs), so this is a per-row expansion, not a join."""
    items = _catalog_items(catalog)
    rows = F.array(*[F.struct(F.lit(it["pos"]).alias("pos"), F.lit(it["id"]).alias("id"),
                              (F.col("p_fire") * F.lit(float(it["eff_fire"]))
                               + F.col("p_drought") * F.lit(float(it["eff_drought"]))
                               + F.col("p_veg") * F.lit(float(it["eff_veg"]))).alias("unit_score"))
                     for it in items])
    return scen.select("scenario_id", F.inline(rows))


# ----------------------------------------------------------------- K1 floors

def urgency_floors(probs: DataFrame, budget: str = "budget") -> DataFrame:
    """Minimum spend per threat from urgency tiers; scaled into 80 % of budget (K1)."""
    def share(p):
        e = F.lit(0.0)
        for thr, _, pct in reversed(C.URGENCY_TIERS):
            e = F.when(F.col(p) >= F.lit(thr), F.lit(pct)).otherwise(e)
        return e
    raw = {t: F.col(budget) * share(PROB[t]) for t in THREATS}
    total = raw["fire"] + raw["drought"] + raw["vegetation"]
    cap = F.col(budget) * F.lit(C.FLOOR_CAP_SHARE)
    scale = F.when(total > cap, cap / total).otherwise(F.lit(1.0))
    out = probs
    for t in THREATS:
        out = out.withColumn(f"floor_{t}", rnd(F.when(total > cap, raw[t] * scale).otherwise(raw[t]), 2))
    return out


# ----------------------------------------------------------------- exact solver

def scenario_params(scen: DataFrame, catalog_items: list) -> DataFrame:
    """Normalise scenario columns: budget cents, effective floors (T18), caps per
    type (-1 = none) and per item: cost in cents, cap (0 if its type is off),
    effectiveness per threat.

    A scenario may bring its own ``cost_<pos>`` / ``eff_<threat>_<pos>`` columns
    (a perturbed catalog, K11); otherwise the catalog's values hold."""
    s = scen
    for col, default in [("disabled_types", F.array().cast("array<string>")),
                         ("type_caps", F.create_map().cast("map<string,int>"))]:
        if col not in s.columns:
            s = s.withColumn(col, default)
    for t in THREATS:
        if f"floor_{t}" not in s.columns:
            s = s.withColumn(f"floor_{t}", F.lit(0.0))
    s = s.withColumn("_bud", F.floor(F.col("budget") * 100 + 1e-6).cast("bigint"))
    for it in catalog_items:
        q = it["pos"]
        cost = F.col(f"cost_{q}") if f"cost_{q}" in s.columns else F.lit(float(it["cost"]))
        off = F.coalesce(F.array_contains("disabled_types", it["type"]), F.lit(False))
        s = s.withColumn(f"_c{q}", F.round(cost * F.lit(100.0)).cast("bigint")) \
             .withColumn(f"_m{q}", F.when(off, F.lit(0)).otherwise(F.lit(int(it["max_units"]))))
        for t in THREATS:
            own = f"eff_{t}_{q}"
            s = s.withColumn(f"_e_{t}_{q}", F.col(own) if own in s.columns else F.lit(float(it[EFF[t]])))
    for t in THREATS:
        # the nominal catalog says which interventions address a threat
        able = [F.col(f"_m{it['pos']}") > 0 for it in catalog_items if it[EFF[t]] > 0]
        active = functools.reduce(Column.__or__, able, F.lit(False)) & (F.col(f"floor_{t}") > 0)
        s = s.withColumn(f"_f_{t}", F.when(active, F.col(f"floor_{t}")).otherwise(F.lit(0.0)))
    for k, typ in enumerate(TYPES):
        s = s.withColumn(f"_t{k}", F.coalesce(F.element_at("type_caps", F.lit(typ)), F.lit(-1)))
    return s


def _params(n: int) -> list[str]:
    return (["_bud", *PROB.values(), *[f"_f_{t}" for t in THREATS], *[f"_t{k}" for k in range(len(TYPES))]]
            + [f"_{x}{q}" for q in range(n) for x in ("c", "m")] + [f"_e_{t}_{q}" for q in range(n) for t in THREATS])


def _total(terms: list[Column], zero) -> Column:
    return functools.reduce(Column.__add__, terms) if terms else F.lit(zero)


def _incumbent(s: DataFrame, items: list) -> DataFrame:
    """``_low``: the score of a greedy plan (best score per cost first, whole units, type
    caps kept), or -1 where that plan misses a floor.  The optimum is never below it."""
    n, kinds = len(items), len(TYPES)
    rows = F.array(*[F.struct((-F.col(f"_v{q}") / F.greatest(F.col(f"_c{q}"), F.lit(1))).alias("r"), F.lit(q).alias("q"),
                              F.col(f"_c{q}").alias("c"), F.col(f"_m{q}").alias("m"), F.col(f"_v{q}").alias("v"),
                              F.lit(TYPES.index(items[q]["type"])).alias("k"),
                              F.array(*[F.col(f"_e_{t}_{q}") > 0 for t in THREATS]).alias("a")) for q in range(n)])
    begin = F.struct(F.col("_bud").alias("left"), F.lit(0.0).alias("score"),
                     F.array(*[F.when(F.col(f"_t{k}") < 0, F.lit(1 << 30)).otherwise(F.col(f"_t{k}")) for k in range(kinds)]).alias("caps"),
                     F.array(*[F.lit(0).cast("bigint") for _ in THREATS]).alias("spent"))

    def take(acc: Column, x: Column) -> Column:
        u = F.least(x["m"].cast("bigint"), F.floor(acc["left"] / F.greatest(x["c"], F.lit(1))).cast("bigint"),
                    F.element_at(acc["caps"], x["k"] + 1).cast("bigint"))
        return F.struct((acc["left"] - u * x["c"]).alias("left"), (acc["score"] + u * x["v"]).alias("score"),
                        F.transform(acc["caps"], lambda c, i: F.when(i == x["k"], c - u.cast("int")).otherwise(c)).alias("caps"),
                        F.transform(acc["spent"], lambda c, i: c + F.when(F.element_at(x["a"], i + 1), u * x["c"])
                                    .otherwise(F.lit(0).cast("bigint"))).alias("spent"))

    g = s.withColumn("_g", F.aggregate(F.array_sort(rows), begin, take))
    met = functools.reduce(Column.__and__, [F.element_at(F.col("_g.spent"), i + 1) / F.lit(100.0) >= F.col(f"_f_{t}")
                                            for i, t in enumerate(THREATS)])
    return g.withColumn("_low", F.when(met, F.col("_g.score") - F.lit(2e-9)).otherwise(F.lit(-1.0))).drop("_g")


def _plans(distinct: DataFrame, items: list) -> DataFrame:
    """All vectors that can still be the best plan of their what-if, item by item.

    One generator per item.  After each, a vector goes on only if it is within
    the budget and the type caps, can still reach every floor with the money
    left, and its score plus a bound on what the rest can add (by their caps,
    and by the money left at the best remaining score per cost) is not below
    the greedy plan's."""
    n = len(items)
    s = distinct
    for q in range(n):
        s = s.withColumn(f"_v{q}", _total([F.col(PROB[t]) * F.col(f"_e_{t}_{q}") for t in THREATS], 0.0))
    s = _incumbent(s, items)
    s = s.withColumn("cost_c", F.lit(0).cast("bigint"))
    for t in THREATS:
        s = s.withColumn(f"lin_{t}", F.lit(0.0)).withColumn(f"spend_{t}_c", F.lit(0).cast("bigint"))
    used: dict[int, list[int]] = {}
    for q, it in enumerate(items):
        k = TYPES.index(it["type"])
        used.setdefault(k, []).append(q)
        s = s.withColumn(f"u{q}", F.explode(F.sequence(F.lit(0), F.col(f"_m{q}"))))
        u = F.col(f"u{q}")
        spent = u.cast("bigint") * F.col(f"_c{q}")
        s = s.withColumn("cost_c", F.col("cost_c") + spent)
        for t in THREATS:
            s = s.withColumn(f"lin_{t}", F.col(f"lin_{t}") + F.col(f"_e_{t}_{q}") * u.cast("double")) \
                 .withColumn(f"spend_{t}_c", F.col(f"spend_{t}_c") + F.when(F.col(f"_e_{t}_{q}") > 0, spent).otherwise(F.lit(0)))
        left, rest = F.col("_bud") - F.col("cost_c"), range(q + 1, n)
        ok = (left >= 0) & ((F.col(f"_t{k}") < 0) | (_total([F.col(f"u{j}") for j in used[k]], 0) <= F.col(f"_t{k}")))
        for t in THREATS:
            more = F.least(left, _total([F.when(F.col(f"_e_{t}_{j}") > 0, F.col(f"_m{j}") * F.col(f"_c{j}")).otherwise(F.lit(0))
                                         for j in rest], 0).cast("bigint"))
            ok = ok & ((F.col(f"spend_{t}_c") + more).cast("double") / F.lit(100.0) >= F.col(f"_f_{t}"))
        bound = F.lit(0.0)
        if rest:
            per_cent = [F.when(F.col(f"_m{j}") > 0, F.col(f"_v{j}") / F.greatest(F.col(f"_c{j}"), F.lit(1))).otherwise(F.lit(0.0))
                        for j in rest]
            best = F.greatest(*per_cent) if len(per_cent) > 1 else per_cent[0]
            free = _total([F.when(F.col(f"_c{j}") <= 0, F.col(f"_m{j}") * F.col(f"_v{j}")).otherwise(F.lit(0.0)) for j in rest], 0.0)
            bound = F.least(_total([F.col(f"_m{j}") * F.col(f"_v{j}") for j in rest], 0.0), left * best + free)
        s = s.where(ok & (_linear() + bound >= F.col("_low")))
    return s


def _linear() -> Column:
    return (F.col("p_fire") * F.col("lin_fire") + F.col("p_drought") * F.col("lin_drought")
            + F.col("p_veg") * F.col("lin_vegetation"))


def solve(scen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact plan per scenario (K3): one row per scenario with ``units`` array,
    ``status``, ``linear_score``.

    ``scen`` needs scenario_id, budget, p_fire, p_drought, p_veg and may have
    floor_<threat>, disabled_types, type_caps and own catalog columns (K11).
    A NULL probability or budget makes a scenario infeasible."""
    items = _catalog_items(catalog)
    n = len(items)
    sp = scenario_params(scen, items)
    params = _params(n)
    # equal what-ifs are solved once; the generators need rows in many tasks, which
    # adaptive coalescing would otherwise gather into one
    tasks = int(scen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = sp.select(*params).distinct().repartition(max(tasks, 32), *params)
    score9 = F.floor(_linear() * F.lit(1e9) + F.lit(0.5)).cast("bigint")
    best = _plans(distinct, items).groupBy(*params).agg(F.max(F.struct(
        score9.alias("s"), (-F.col("cost_c")).alias("c"), F.array(*[F.col(f"u{q}") for q in range(n)]).alias("units"),
        _linear().alias("linear"))).alias("_b"))
    match = functools.reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in params])
    out = sp.alias("s").join(best.alias("b"), match, "left")
    keep = [F.col(f"s.`{c}`") for c in sp.columns if c not in params or c in PROB.values()]
    zero = F.array(*[F.lit(0) for _ in range(n)])
    return out.select(*keep, F.when(F.col("b._b").isNull(), F.lit("Infeasible")).otherwise(F.lit("Optimal")).alias("status"),
                      F.coalesce(F.col("b._b.units"), zero).alias("units"),
                      F.coalesce(F.col("b._b.linear"), F.lit(0.0)).alias("linear_score"))


# ----------------------------------------------------------------- K4-K6

def explode_plan(plans: DataFrame, catalog: DataFrame, keep=("scenario_id",)) -> DataFrame:
    """One row per (scenario, intervention) with units (posexplode of the plan)."""
    x = plans.select(*keep, F.posexplode("units").alias("pos", "units_n"))
    return x.join(F.broadcast(catalog), "pos")


def survival_expr(items: list, threat: str, units: str = "units") -> Column:
    """prod over items (catalog order) with units>0 and eff>0 of (1-eff)^units."""
    surv = F.lit(1.0)
    for it in items:
        e = float(it[EFF[threat]])
        if e > 0:
            u = F.element_at(F.col(units), it["pos"] + 1)
            surv = surv * F.when(u > 0, F.pow(F.lit(1.0 - e), u.cast("double"))).otherwise(F.lit(1.0))
    return surv


def risk_reduction(plans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Multiplicative survival per threat (K4) and total score (K5), row-wise.

    The plan is a fixed-length units array, so survival, cost and the rounded
    reductions are one projection (no shuffle): effectiveness = 1 - survival,
    risk_reduction = p * rounded effectiveness, all rounded as reported."""
    items = _catalog_items(catalog)
    base = plans
    total = None
    cost = F.lit(0.0)
    for it in items:
        cost = cost + F.element_at(F.col("units"), it["pos"] + 1).cast("double") * F.lit(float(it["cost"]))
    for t in THREATS:
        p = F.col(PROB[t])
        base = (base.withColumn(f"_surv_{t}", survival_expr(items, t))
                    .withColumn(f"eff_{t}", rnd(F.lit(1.0) - F.col(f"_surv_{t}"), 4))
                    .withColumn(f"before_{t}", rnd(p, 4))
                    .withColumn(f"after_{t}", rnd(p * F.col(f"_surv_{t}"), 4))
                    .withColumn(f"reduction_{t}", rnd(p * F.col(f"eff_{t}"), 4))
                    .withColumn(f"pct_{t}", rnd(F.col(f"eff_{t}") * F.lit(100.0), 1)))
        total = F.col(f"reduction_{t}") if total is None else total + F.col(f"reduction_{t}")
    base = base.withColumn("total_score", rnd(total, 6)).withColumn("total_cost", rnd(cost, 2))
    return base.drop(*[f"_surv_{t}" for t in THREATS])


def allocation_items(plans: DataFrame, catalog: DataFrame, keep=("scenario_id",)) -> DataFrame:
    """Items with units > 0: id, name, units, cost (K6)."""
    lines = explode_plan(plans, catalog, keep).where(F.col("units_n") > 0)
    return lines.select(*keep, "pos", "id", "name", F.col("units_n").alias("units"),
                        (F.col("units_n") * F.col("cost")).alias("cost"))


# ----------------------------------------------------------------- baselines

def even_split(scen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Budget / #enabled interventions, whole units, capped (K7)."""
    items = _catalog_items(catalog)
    s = scen if "disabled_types" in scen.columns else scen.withColumn("disabled_types", F.array().cast("array<string>"))
    enabled = [~F.array_contains("disabled_types", it["type"]) for it in items]
    n_en = sum([F.when(e, F.lit(1)).otherwise(F.lit(0)) for e in enabled], F.lit(0))
    share = F.col("budget") / n_en
    units = [F.when(e & (n_en > 0), F.least(F.lit(it["max_units"]), F.floor(share / F.lit(float(it["cost"]))).cast("int")))
             .otherwise(F.lit(0)) for e, it in zip(enabled, items)]
    return s.withColumn("units", F.array(*units))


def patrol_only(scen: DataFrame, catalog: DataFrame, patrol_type: str = "patrol") -> DataFrame:
    """Greedy: cheapest patrol intervention first until money runs out (K8)."""
    items = _catalog_items(catalog)
    patrol = sorted([it for it in items if it["type"] == patrol_type], key=lambda it: it["cost"])
    s = scen.withColumn("_rem", F.col("budget"))
    got = {}
    for it in patrol:
        u = F.least(F.lit(it["max_units"]), F.floor(F.col("_rem") / F.lit(float(it["cost"]))).cast("int"))
        s = s.withColumn(f"_u{it['pos']}", u).withColumn("_rem", F.col("_rem") - F.col(f"_u{it['pos']}") * F.lit(float(it["cost"])))
        got[it["pos"]] = F.col(f"_u{it['pos']}")
    units = [got.get(it["pos"], F.lit(0)) for it in items]
    return s.withColumn("units", F.array(*units)).drop("_rem", *[f"_u{p}" for p in got])


# ----------------------------------------------------------------- K13 zones

def distribute_units(lines: DataFrame, zones: DataFrame, keys=("scenario_id",)) -> DataFrame:
    """Largest-remainder split of each line's units over its entity's zones.

    ``lines``: keys + entity, pos (catalog offset), units.  ``zones``: entity,
    zone_id, zone_idx (0-based order), weight.  Non-positive weight sums fall
    back to equal weights; leftover units go to the largest fractional parts,
    ties broken by the rotated index (idx + offset) % n."""
    zw = Window.partitionBy("entity")
    z = (zones.withColumn("_wsum", F.sum("weight").over(zw))
              .withColumn("_n", F.count(F.lit(1)).over(zw))
              .withColumn("_w", F.when(F.col("_wsum") > 0, F.col("weight").cast("double")).otherwise(F.lit(1.0)))
              .withColumn("_s", F.when(F.col("_wsum") > 0, F.col("_wsum").cast("double")).otherwise(F.col("_n").cast("double"))))
    j = lines.where(F.col("units") > 0).join(z, "entity")
    raw = F.col("units") * F.col("_w") / F.col("_s")
    j = j.withColumn("_raw", raw).withColumn("_fl", F.floor("_raw").cast("int"))
    part = [*keys, "entity", "pos"]
    w = Window.partitionBy(*part)
    j = j.withColumn("_rem", F.col("units") - F.sum("_fl").over(w))
    o = Window.partitionBy(*part).orderBy((F.col("_raw") - F.col("_fl")).desc(),
                                          F.pmod(F.col("zone_idx") + F.col("pos"), F.col("_n")))
    j = j.withColumn("_r", F.row_number().over(o))
    j = j.withColumn("zone_units", F.col("_fl") + F.when(F.col("_r") <= F.col("_rem"), 1).otherwise(0))
    return j.where(F.col("zone_units") > 0).select(*keys, "entity", "pos", "zone_id", "zone_units")


# ----------------------------------------------------------------- K14 rationale

def rationale(plans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plain-language summary, floor note and budget-use note per scenario."""
    label = {t: C.THREAT_TEXT[t] for t in THREATS}

    def tier(p):
        e = F.lit("low")
        for thr, name, _ in reversed(C.URGENCY_TIERS):
            e = F.when(p >= F.lit(thr), F.lit(name)).otherwise(e)
        return e
    parts = F.array(*[F.struct(F.col(PROB[t]).alias("p"), F.lit(-i).alias("o"), F.lit(label[t]).alias("l"))
                      for i, t in enumerate(THREATS)])
    ranked = F.reverse(F.array_sort(parts))
    profile = F.array_join(F.transform(ranked, lambda x: F.concat(
        x["l"], F.lit(" "), F.floor(x["p"] * 100 + 0.5).cast("bigint").cast("string"), F.lit("% ("),
        tier(x["p"]), F.lit(")"))), ", ")
    summary = F.concat(F.lit("Current 30-day risk is "), profile,
                       F.lit(". The plan spends on the highest risks first, staying within budget."))
    fl = F.array(*[F.struct(F.col(f"floor_{t}").alias("f"), F.lit(-i).alias("o"), F.lit(label[t]).alias("l"))
                   for i, t in enumerate(THREATS)])
    forced = F.reverse(F.array_sort(F.filter(fl, lambda x: x["f"] > 0)))
    floor_txt = F.array_join(F.transform(forced, lambda x: F.concat(
        F.floor(x["f"] / F.col("budget") * 100 + 0.5).cast("bigint").cast("string"),
        F.lit("% of the budget on "), x["l"])), ", ")
    names = F.transform(forced, lambda x: x["l"])
    floor_note = F.when(F.size(forced) > 0, F.concat(
        F.lit("Because "), F.array_join(names, " and "),
        F.lit(" risk is elevated, the planner reserved a minimum spend ("), floor_txt,
        F.lit(") before allocating the rest to the best overall value.")))
    pct = F.floor(F.col("total_cost") / F.col("budget") * 100 + 0.5).cast("bigint")
    budget_note = (F.when(F.col("budget") <= 0, F.lit("No budget was available, so no interventions were selected."))
                    .when(pct < 95, F.concat(F.lit("The plan uses about "), pct.cast("string"), F.lit(
                        "% of the budget. The rest is left unspent because the most effective interventions "
                        "reached their capacity limits, and weaker ones would not reduce risk enough to be "
                        "worthwhile.")))
                    .otherwise(F.lit("The plan uses essentially the full budget, placing it where it removes "
                                     "the most risk.")))
    return plans.withColumn("summary", summary).withColumn("floor_note", floor_note).withColumn("budget_note", budget_note)


def item_reasons(items: DataFrame, scen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per selected intervention: the threat it most reduces (p*eff, first wins ties)."""
    effs = catalog.select("pos", *EFF.values())  # a few catalog rows
    j = (items.join(scen.select("scenario_id", *PROB.values()), "scenario_id")
              .join(F.broadcast(effs), "pos"))
    contrib = F.array(*[F.struct((F.col(PROB[t]) * F.col(EFF[t])).alias("c"), F.lit(-i).alias("o"),
                                 F.lit(C.THREAT_TEXT[t]).alias("l"), F.col(EFF[t]).alias("e"))
                        for i, t in enumerate(THREATS)])
    main = F.array_max(contrib)
    return j.withColumn("_m", main).select(
        *items.columns,
        F.concat(F.lit("Targets "), F.col("_m.l"), F.lit(" risk: "),
                 F.floor(F.col("_m.e") * 100 + 0.5).cast("bigint").cast("string"),
                 F.lit("% reduction per unit.")).alias("reason"))


# ----------------------------------------------------------------- K10 perturbation

def uniform(seed: int, *parts: Column) -> Column:
    """Deterministic U[0,1) from md5 of 'seed:part1:part2:...' (same text in SQL)."""
    txt = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def perturbed_catalogs(samples: DataFrame, catalog: DataFrame, pct: float = 0.25, seed: int = 42) -> DataFrame:
    """One wide row per sample: cost_<pos>, eff_<threat>_<pos> perturbed by
    U(-pct, pct) factors; cost min 1 rounded to cents, eff clipped to [0, 1] (K10)."""
    items = _catalog_items(catalog)
    out = samples
    for it in items:
        p = it["pos"]
        fc = F.lit(1.0) + (uniform(seed, F.col("sample"), F.lit(it["id"]), F.lit("cost")) * 2 - 1) * F.lit(pct)
        out = out.withColumn(f"cost_{p}", rnd(F.greatest(F.lit(1.0), F.lit(float(it["cost"])) * fc), 2))
        for t in THREATS:
            fe = F.lit(1.0) + (uniform(seed, F.col("sample"), F.lit(it["id"]), F.lit(t)) * 2 - 1) * F.lit(pct)
            out = out.withColumn(f"eff_{t}_{p}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(it[EFF[t]])) * fe)))
    return out


# ----------------------------------------------------------------- K11 sensitivity

def sensitivity(scen: DataFrame, catalog: DataFrame, n_samples: int = 100, pct: float = 0.25,
                seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Perturbed-catalog re-solves per scenario.

    Every (scenario, sample) is a what-if with its own catalog columns, joined
    on the sample; work is spread over tasks by what-if.
    Each sample's plan is scored with the NOMINAL catalog (T10).

    Returns (per-sample plans with scores, per-scenario summary)."""
    spark = scen.sparkSession
    items = _catalog_items(catalog)
    samples = spark.range(n_samples).select(F.col("id").cast("int").alias("sample"))
    pc = perturbed_catalogs(samples, catalog, pct, seed)
    sx = scen.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).join(pc, "sample")
    plans = solve(sx, catalog).select(*scen.columns, "sample", "status", "units", "linear_score")
    scored = risk_reduction(plans, catalog)
    n = len(items)
    aggs = [F.avg("total_score").alias("score_mean"), F.stddev_pop("total_score").alias("score_std"),
            F.min("total_score").alias("score_min"), F.max("total_score").alias("score_max"),
            F.sort_array(F.collect_list("total_score")).alias("_vals"),
            F.count_if(F.col("status") == "Optimal").alias("n_optimal"), F.count(F.lit(1)).alias("n_samples")]
    for it in items:
        u = F.element_at("units", it["pos"] + 1)
        aggs += [F.avg(F.when(u > 0, 1.0).otherwise(0.0)).alias(f"sel_{it['id']}"),
                 F.avg(u.cast("double")).alias(f"units_mean_{it['id']}"),
                 F.stddev_pop(u.cast("double")).alias(f"units_std_{it['id']}")]
    summary = scored.groupBy("scenario_id").agg(*aggs)
    # the group holds exactly n_samples values (a parameter, not data-sized)
    summary = summary.select("*", sorted_quantile("_vals", 0.025).alias("score_ci_lo"),
                             sorted_quantile("_vals", 0.975).alias("score_ci_hi")).drop("_vals")
    return scored, summary


def sorted_quantile(arr: str, q: float) -> Column:
    """Linear-interpolated quantile (NumPy default) of a sorted array column."""
    n = F.size(arr)
    pos = F.lit(q) * (n - 1).cast("double")
    lo = F.floor(pos).cast("int")
    frac = pos - lo.cast("double")
    a = F.element_at(arr, lo + 1)
    b = F.element_at(arr, F.least(lo + 2, n))
    return a + frac * (b - a)


def selection_classes(summary: DataFrame, catalog_ids: list[str], core: float = 0.80,
                      opportunistic: float = 0.50) -> DataFrame:
    """Long selection frequency per intervention with core/opportunistic class, mean and deviation
    of its units, and its place by frequency, highest first, then by id (K11, F5)."""
    arr = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"sel_{i}").alias("selection_freq"), F.col(f"units_mean_{i}").alias("units_mean"),
                             F.col(f"units_std_{i}").alias("units_std")) for i in catalog_ids])
    x = summary.select("scenario_id", F.inline(arr))
    cls = (F.when(F.col("selection_freq") >= core, "core")
            .when(F.col("selection_freq") < opportunistic, "opportunistic").otherwise("conditional"))
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.col("selection_freq").desc(), "id"))  # the catalog's rows
    return x.withColumn("class", cls).withColumn("place", place)


# ----------------------------------------------------------------- S8 / C17

def recommendation_id(*cols: Column) -> Column:
    """Deterministic recommendation id from its defining values."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def referential_violations(allocs: DataFrame, zones: DataFrame) -> DataFrame:
    """Allocation lines whose (entity, zone) pair is not a zone of that entity (C17): must be empty."""
    return allocs.join(zones.select("entity", "zone_id"), ["entity", "zone_id"], "left_anti")
