"""Display-side labels: demand class and risk (F20-F21), scenario delta (F22),
peak label (F19), prediction clip (F24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.schema import (PEAK_LABELS, DEMAND_CLASS_CUTS, DEMAND_CLASS_ELSE, DELTA_HIGH, DELTA_LOW,
                             RISK_CAP, RISK_SCALE, STATUS_HIGH, STATUS_LOW, STATUS_STABLE)


def demand_class(demand: Column) -> Column:
    expr = None
    for cut, name in DEMAND_CLASS_CUTS:
        expr = F.when(demand < cut, name) if expr is None else expr.when(demand < cut, name)
    return F.when(demand.isNotNull(), expr.otherwise(DEMAND_CLASS_ELSE))


def risk_pct(demand: Column) -> Column:
    """min(100, int(500 * demand)); int() truncates toward zero, no lower bound."""
    # least() skips NULLs, so guard: a missing demand has no risk score
    return F.when(demand.isNotNull(), F.least(F.lit(RISK_CAP), (demand * RISK_SCALE).cast("int")))


def pct_delta(new: Column, base: Column) -> Column:
    """Percent change; NULL when the baseline is zero (instead of raising)."""
    return F.try_divide(new - base, base) * 100.0


def delta_status(delta: Column) -> Column:
    return (F.when(delta > DELTA_HIGH, STATUS_HIGH)
            .when(delta < DELTA_LOW, STATUS_LOW)
            .when(delta.isNotNull(), STATUS_STABLE))


def peak_label(is_peak: Column) -> Column:
    return F.when(is_peak == 1, PEAK_LABELS[1]).when(is_peak == 0, PEAK_LABELS[0])


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    if lo is not None:
        c = F.greatest(F.lit(float(lo)), c)
    if hi is not None:
        c = F.least(F.lit(float(hi)), c)
    return c
