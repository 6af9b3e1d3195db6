"""Column-expression helpers (H1-H18).  All are built-in Spark expressions,
so they stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldt import config as C


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: half up toward +inf."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def pct_points(p: Column) -> Column:
    """Percent rounding half up of a probability (H5): Math.round((p ?? 0) * 100)."""
    return js_round(F.coalesce(p, F.lit(0.0)) * F.lit(100.0))


def pct_text(p: Column) -> Column:
    return F.concat(pct_points(p).cast("string"), F.lit("%"))


def risk_band(p: Column) -> Column:
    """High >= .66, Medium >= .33, else Low (H4)."""
    return (F.when(p >= F.lit(C.RISK_HIGH), "High")
             .when(p >= F.lit(C.RISK_MEDIUM), "Medium").otherwise("Low"))


def urgency_tier(p: Column) -> Column:
    """critical >= .85, high >= .70, moderate >= .50, else low (H4)."""
    e = None
    for thr, name, _ in C.URGENCY_TIERS:
        e = F.when(p >= F.lit(thr), name) if e is None else e.when(p >= F.lit(thr), name)
    return e.otherwise("low")


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip to [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def usd_to_local(usd: Column, rate: float = C.CURRENCY_RATE) -> Column:
    """Fixed-rate currency conversion, rounded half up (H9)."""
    return js_round(F.coalesce(usd, F.lit(0.0)) * F.lit(float(rate)))


def local_to_usd(local: Column, rate: float = C.CURRENCY_RATE) -> Column:
    return js_round(F.coalesce(local, F.lit(0.0)) / F.lit(float(rate)))


def snake_to_title(c: Column) -> Column:
    """``fire_within_30d`` -> ``Fire Within 30d`` (H8)."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def fmt_value(v: Column, unit: Column) -> Column:
    """Unit-aware value text (H6): mm/degC one decimal, days integer, ndvi two
    decimals, bool Yes/No; NULL renders as 'nan'."""
    txt = (F.when(unit == "mm", F.format_string("%.1f mm", v))
            .when(unit == "degC", F.format_string("%.1f °C", v))
            .when(unit == "days", F.format_string("%d days", v.cast("bigint")))
            .when(unit == "ndvi", F.format_string("%.2f", v))
            .when(unit == "bool", F.when(v >= 0.5, "Yes").otherwise("No"))
            .otherwise(F.format_string("%.2f", v)))
    return F.when(v.isNull() & (unit != "bool"), F.lit("nan")).otherwise(txt)


def impact(v: Column, direction: Column, threshold: Column) -> Column:
    """raises/lowers rule per direction (H7); NULL compares false -> lowers."""
    raises = (F.when(direction == "bool", v >= 0.5)
               .when(direction == "lowval", v < 0)
               .when(direction == "low", v < F.coalesce(threshold, F.lit(0.0)))
               .when(direction == "high", v > F.coalesce(threshold, F.lit(0.0)))
               .otherwise(F.lit(False)))
    return F.when(F.coalesce(raises, F.lit(False)), "raises").otherwise("lowers")


def qa_clear(qa: Column, bits=(0, 1)) -> Column:
    """True when all given QA bits are 0."""
    mask = 0
    for b in bits:
        mask |= 1 << b
    return (qa.bitwiseAND(F.lit(mask)) == 0)


def first_non_null(*cols: Column) -> Column:
    """First non-NULL across columns."""
    return F.coalesce(*cols)


def doy_encoding(day: Column) -> tuple[Column, Column]:
    doy = F.dayofyear(day).cast("double")
    a = F.lit(2 * math.pi) * doy / F.lit(365.25)
    return F.sin(a), F.cos(a)


# ----------------------------------------------------------------- Student's t

def _ln_gamma_step(x: Column) -> Column:
    """ln(Gamma(x + 1/2) / Gamma(x)) for x > 0: sixteen steps of the recurrence, then the asymptotic series."""
    y = x + F.lit(16.0)
    series = F.log(y) / 2 - 1 / (8 * y) + 1 / (192 * F.pow(y, F.lit(3.0))) - 1 / (640 * F.pow(y, F.lit(5.0))) \
        + 17 / (14336 * F.pow(y, F.lit(7.0))) - 31 / (18432 * F.pow(y, F.lit(9.0)))
    for k in range(16):
        series = series - F.log1p(F.lit(0.5) / (x + k))
    return series


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forwards (modified Lentz); it takes
    of the order of sqrt(a) terms."""
    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def pair(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    first = 1 / safe(1 - (a + b) * x / (a + 1))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return pair(c2, d2, s["h"] * d1 * c1 * d2 * c2)

    terms = F.sequence(F.lit(1), F.ceil(F.lit(60.0) + 6 * F.sqrt(a)).cast("int"))
    return F.aggregate(terms, pair(F.lit(1.0), first, first), step, lambda s: s["h"])


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with ``df`` >= 1 degrees of freedom: the regularised incomplete beta
    function I_x(df / 2, 1 / 2) at x = df / (df + t^2); NULL where either is NULL, 0 beyond |t| = 1e150."""
    a, t2, v = df.cast("double") / 2, t * t, df.cast("double")
    half = F.lit(0.5)
    x, rest = v / (v + t2), t2 / (v + t2)
    front = F.exp(_ln_gamma_step(a) - a * F.log1p(t2 / v) + F.log(rest) / 2) / F.sqrt(F.pi())
    near = x < (a + 1) / (a + 2.5)
    p = F.when(near, front * _beta_fraction(a, half, x) / a).otherwise(1 - front * _beta_fraction(half, a, rest) / half)
    return F.when(t2 == 0, F.lit(1.0)).when((F.abs(t) > 1e150) & df.isNotNull(), F.lit(0.0)).when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
