"""Row-frame window building blocks over an (entity, day) panel.

All helpers share ONE partition/order spec (entity, day) so that Spark plans
a single exchange + sort for every rolling/lag/forward column of a panel;
consecutive ``Window`` operators reuse that distribution.  ``rowsBetween``
equals days only on a complete spine (see ``veldt.sources.panel``).

Pandas-style ``rolling(k, min_periods=m)`` semantics: NULLs are skipped, the
result is NULL until m non-NULL observations are in the frame (E1/E2).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_entity(entity: str = "entity", order: str = "day") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(order)


def trailing(k: int, entity: str = "entity", order: str = "day") -> WindowSpec:
    return by_entity(entity, order).rowsBetween(-(k - 1), 0)


def rolling_sum(c: Column, k: int, min_periods: int, **kw) -> Column:
    w = trailing(k, **kw)
    return F.when(F.count(c).over(w) >= min_periods, F.sum(c).over(w))


def rolling_sum_fixed(units: Column, k: int, min_periods: int, scale: float, **kw) -> Column:
    """Rolling sum over a fixed-point BIGINT column, converted once to DOUBLE.

    Integer accumulation is exact, so the result is independent of frame
    evaluation order (and equal across engines)."""
    w = trailing(k, **kw)
    return F.when(F.count(units).over(w) >= min_periods,
                  F.sum(units).over(w).cast("double") / F.lit(scale))


def rolling_mean_fixed(units: Column, k: int, min_periods: int, scale: float, **kw) -> Column:
    """Rolling mean over a fixed-point BIGINT column (exact sum / count)."""
    w = trailing(k, **kw)
    n = F.count(units).over(w)
    return F.when(n >= min_periods,
                  F.sum(units).over(w).cast("double") / (n.cast("double") * F.lit(scale)))


def group_mean_fixed(units: Column, w: WindowSpec, scale: float, times: float = 1.0) -> Column:
    """Mean of a fixed-point column over a window, times a factor, as DOUBLE."""
    return (F.sum(units).over(w).cast("double") * F.lit(times)
            / (F.count(units).over(w).cast("double") * F.lit(scale)))


def rolling_mean(c: Column, k: int, min_periods: int, **kw) -> Column:
    w = trailing(k, **kw)
    return F.when(F.count(c).over(w) >= min_periods, F.avg(c).over(w))


def ffill(c: Column, limit: int, **kw) -> Column:
    """Forward fill at most ``limit`` consecutive NULL rows."""
    return F.last(c, ignorenulls=True).over(by_entity(**kw).rowsBetween(-limit, 0))


def days_since(flag: Column, day: Column, cap: int, **kw) -> Column:
    """Days since the latest flagged row (inclusive), capped; none -> cap."""
    w = by_entity(**kw).rowsBetween(Window.unboundedPreceding, 0)
    last_day = F.last(F.when(flag, day), ignorenulls=True).over(w)
    return F.least(F.coalesce(F.datediff(day, last_day), F.lit(cap)), F.lit(cap))


def forward_any(flag: Column, horizon: int, **kw) -> Column:
    """1 if the flag is set in the next ``horizon`` rows (today excluded);
    NULL unless all ``horizon`` rows exist (E8)."""
    w = by_entity(**kw).rowsBetween(1, horizon)
    return F.when(F.count(F.lit(1)).over(w) == horizon,
                  F.max(flag.cast("int")).over(w)).cast("int")


def flag(cond: Column) -> Column:
    """Comparison to a boolean flag where NULL compares as false."""
    return F.coalesce(cond, F.lit(False))
