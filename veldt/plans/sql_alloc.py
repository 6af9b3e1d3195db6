"""DuckDB SQL for the allocation oracles, generated from the fixed catalog.

The oracle enumerates unit vectors with nested ``range()`` joins and picks
the optimum per scenario with ``row_number()`` over the explicit ordering
(score rounded to 9 digits desc, cost asc, units in catalog order desc) —
a different formulation from the packed-key aggregate of the Spark side.
"""

from __future__ import annotations

from veldt import config as C

CAT = C.CATALOG_ROWS
N = len(CAT)
TYPES = C.INTERVENTION_TYPES
EFFI = {"fire": 5, "drought": 6, "vegetation": 7}


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def cents(x: float) -> int:
    return int(round(x * 100))


def enum_ctes(budget_c_sql: str, per_sample: str | None = None, prefix: str = "c") -> str:
    """CTEs c0..c{N-1} enumerating units with pruned cost, then ``cands``.

    ``per_sample``: name of a relation with columns sample, cc<i>, e_<threat>_<i>
    (perturbed cents / efficiencies) — enumeration runs per sample."""
    ctes = []
    for i, row in enumerate(CAT):
        cap = row[4]
        cc = f"cc{i}" if per_sample else str(cents(row[3]))
        if i == 0:
            src = f"{per_sample} ps, range(0, {cap + 1}) t(u0)" if per_sample else f"range(0, {cap + 1}) t(u0)"
            keep = "ps.*, " if per_sample else ""
            ctes.append(f"{prefix}0 AS (SELECT {keep}u0, CAST(u0 AS BIGINT) * {cc} AS cost_c FROM {src} "
                        f"WHERE CAST(u0 AS BIGINT) * {cc} <= {budget_c_sql})")
        else:
            prev = ", ".join(f"u{k}" for k in range(i))
            keep = "p.* EXCLUDE (cost_c), " if per_sample else ""
            cols = f"{keep}" if per_sample else f"{prev}, "
            ctes.append(f"{prefix}{i} AS (SELECT {cols}u{i}, cost_c + CAST(u{i} AS BIGINT) * {cc} AS cost_c "
                        f"FROM {prefix}{i - 1} p, range(0, {cap + 1}) t(u{i}) "
                        f"WHERE cost_c + CAST(u{i} AS BIGINT) * {cc} <= {budget_c_sql})")
    lin, spend = {}, {}
    for t, k in EFFI.items():
        terms, sp = [], []
        for i, row in enumerate(CAT):
            e = f"e_{t}_{i}" if per_sample else d(row[k])
            terms.append(f"{e} * CAST(u{i} AS DOUBLE)")
            cc = f"cc{i}" if per_sample else str(cents(row[3]))
            rel = f"{e} > 0" if per_sample else ("true" if row[k] > 0 else "false")
            sp.append(f"CASE WHEN {rel} THEN CAST(u{i} AS BIGINT) * {cc} ELSE 0 END")
        lin[t] = " + ".join(terms)
        spend[t] = " + ".join(sp)
    tu = []
    for k, typ in enumerate(TYPES):
        us = [f"u{i}" for i, row in enumerate(CAT) if row[2] == typ] or ["0"]
        tu.append(f"({' + '.join(us)}) AS tu{k}")
    mask = " | ".join(f"(CASE WHEN ({' + '.join([f'u{i}' for i, r in enumerate(CAT) if r[2] == typ] or ['0'])}) > 0 "
                      f"THEN {1 << k} ELSE 0 END)" for k, typ in enumerate(TYPES))
    samp = "sample, " if per_sample else "0 AS sample, "
    ucols = ", ".join(f"u{i}" for i in range(N))
    ctes.append(
        f"{prefix}ands AS (SELECT {samp}{ucols}, cost_c, "
        + ", ".join(f"({lin[t]}) AS lin_{t}" for t in EFFI) + ", "
        + ", ".join(f"({spend[t]}) AS spend_{t}_c" for t in EFFI) + ", "
        + ", ".join(tu) + f", ({mask}) AS type_mask FROM {prefix}{N - 1})")
    return ",\n".join(ctes)


def feasible_sql(s: str = "s", c: str = "c") -> str:
    conds = [f"{c}.cost_c <= {s}.budget_c", f"({c}.type_mask & {s}.disabled_mask) = 0"]
    for t in EFFI:
        conds.append(f"CAST({c}.spend_{t}_c AS DOUBLE) / 100.0 >= {s}.efloor_{t}")
    for k in range(len(TYPES)):
        conds.append(f"({s}.cap{k} < 0 OR {c}.tu{k} <= {s}.cap{k})")
    return " AND ".join(conds)


def scenario_norm_sql(src: str) -> str:
    """Add budget_c, disabled_mask, efloor_<threat> (T18) and cap<k> to a
    scenario relation with columns disabled (VARCHAR[]), caps_patrol etc."""
    dis = " | ".join(f"(CASE WHEN list_contains(disabled, '{typ}') THEN {1 << k} ELSE 0 END)"
                     for k, typ in enumerate(TYPES))
    ef = []
    for t, k in EFFI.items():
        rel = 0
        for row in CAT:
            if row[k] > 0:
                rel |= 1 << TYPES.index(row[2])
        ef.append(f"CASE WHEN ({rel} & ~disabled_mask) <> 0 AND floor_{t} > 0 THEN floor_{t} ELSE 0.0 END "
                  f"AS efloor_{t}")
    caps = ", ".join(f"coalesce(type_caps['{typ}'], -1) AS cap{k}" for k, typ in enumerate(TYPES))
    return (f"(SELECT *, " + ", ".join(ef) + f", {caps} FROM (SELECT *, "
            f"CAST(floor(budget * 100 + 1e-6) AS BIGINT) AS budget_c, ({dis}) AS disabled_mask FROM {src}))")


def best_sql(scen: str, cands: str = "cands", sample_join: bool = False) -> str:
    order = ", ".join([f"c.u{i} DESC" for i in range(N)])
    samp = "AND c.sample = s.sample " if sample_join else ""
    part = "s.scenario_id, s.sample" if sample_join else "s.scenario_id"
    return (f"(SELECT * FROM (SELECT s.scenario_id, c.*, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY floor((s.p_fire * c.lin_fire + s.p_drought * c.lin_drought + s.p_veg * c.lin_vegetation)"
            f" * 1e9 + 0.5) DESC, c.cost_c ASC, {order}) AS rn "
            f"FROM {scen} s JOIN {cands} c ON {feasible_sql()} {samp}) WHERE rn = 1)")


def floors_sql(budget: str = "budget") -> str:
    """Urgency floors (K1) as three columns from p_fire/p_drought/p_veg."""
    def share(p):
        return (f"(CASE WHEN {p} >= 0.85 THEN 0.40 WHEN {p} >= 0.70 THEN 0.25 "
                f"WHEN {p} >= 0.50 THEN 0.10 ELSE 0.0 END)")
    raw = {t: f"({budget} * CAST({share(p)} AS DOUBLE))" for t, p in
           [("fire", "p_fire"), ("drought", "p_drought"), ("vegetation", "p_veg")]}
    tot = f"({raw['fire']} + {raw['drought']} + {raw['vegetation']})"
    cap = f"({budget} * CAST(0.8 AS DOUBLE))"
    return ", ".join(
        f"CAST(floor(CASE WHEN {tot} > {cap} THEN {raw[t]} * ({cap} / {tot}) ELSE {raw[t]} END * 100.0 + 0.5)"
        f" AS DOUBLE) / 100.0 AS floor_{t}" for t in raw)


def units_str_sql(prefix: str = "") -> str:
    return "concat_ws(',', " + ", ".join(f"coalesce({prefix}u{i}, 0)" for i in range(N)) + ")"


def risk_sql(u: str = "u", p: dict | None = None) -> str:
    """Risk-reduction columns (K4/K5) from unit columns u0..u{N-1}."""
    p = p or {"fire": "p_fire", "drought": "p_drought", "vegetation": "p_veg"}
    cols = []
    red = []
    for t, k in EFFI.items():
        factors = [f"(CASE WHEN coalesce({u}{i}, 0) > 0 THEN pow({d(1.0 - row[k])}, CAST({u}{i} AS DOUBLE)) "
                   f"ELSE 1.0 END)" for i, row in enumerate(CAT) if row[k] > 0]
        surv = "(1.0 * " + " * ".join(factors) + ")"
        eff = f"(CAST(floor((1.0 - {surv}) * 1e4 + 0.5) AS DOUBLE) / 1e4)"
        cols += [f"{eff} AS eff_{t}",
                 f"CAST(floor({p[t]} * 1e4 + 0.5) AS DOUBLE) / 1e4 AS before_{t}",
                 f"CAST(floor({p[t]} * {surv} * 1e4 + 0.5) AS DOUBLE) / 1e4 AS after_{t}",
                 f"CAST(floor({p[t]} * {eff} * 1e4 + 0.5) AS DOUBLE) / 1e4 AS reduction_{t}",
                 f"CAST(floor({eff} * 100.0 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS pct_{t}"]
        red.append(f"(CAST(floor({p[t]} * {eff} * 1e4 + 0.5) AS DOUBLE) / 1e4)")
    cost = " + ".join(f"CAST(coalesce({u}{i}, 0) AS DOUBLE) * {d(row[3])}" for i, row in enumerate(CAT))
    cols.append(f"CAST(floor(({' + '.join(red)}) * 1e6 + 0.5) AS DOUBLE) / 1e6 AS total_score")
    cols.append(f"CAST(floor((0.0 + {cost}) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS total_cost")
    return ", ".join(cols)


def uniform_sql(sample: str, ident: str, param: str, seed: int = 42) -> str:
    txt = f"concat_ws(':', '{seed}', CAST({sample} AS VARCHAR), '{ident}', '{param}')"
    return f"(CAST(('0x' || substr(md5({txt}), 1, 8)) AS BIGINT) / 4294967296.0)"


def perturbed_sql(samples: str = "samples", pct: float = 0.25) -> str:
    """Relation (sample, cc<i>, e_<threat>_<i>) of perturbed catalogs."""
    cols = []
    for i, row in enumerate(CAT):
        f = f"(1.0 + ({uniform_sql('sample', row[0], 'cost')} * 2 - 1) * {d(pct)})"
        cost = f"(CAST(floor(greatest(1.0, {d(row[3])} * {f}) * 100.0 + 0.5) AS DOUBLE) / 100.0)"
        cols.append(f"CAST(round({cost} * 100.0) AS BIGINT) AS cc{i}")
        for t, k in EFFI.items():
            fe = f"(1.0 + ({uniform_sql('sample', row[0], t)} * 2 - 1) * {d(pct)})"
            cols.append(f"least(1.0, greatest(0.0, {d(row[k])} * {fe})) AS e_{t}_{i}")
    return f"(SELECT sample, {', '.join(cols)} FROM {samples})"
