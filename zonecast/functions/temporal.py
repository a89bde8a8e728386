"""Time-of-day features (F1-F6) from the ``H:M`` timestamp text and the day number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.schema import PEAK_HOURS, TIME_BLOCK_ELSE, TIME_BLOCKS, WEEKEND_DAYS


def hour_of(ts: Column) -> Column:
    # exactly one ':' is required; anything else is malformed -> NULL
    parts = F.split(ts, ":")
    return F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(1)).try_cast("int"))


def leading_hour(ts: Column) -> Column:
    """The number before the first ':', or the whole text where there is none (``"7"`` is hour 7); anything else is NULL."""
    return F.substring_index(ts, ":", 1).try_cast("int")


def minute_of(ts: Column) -> Column:
    parts = F.split(ts, ":")
    return F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("int"))


def is_peak(hour: Column) -> Column:
    """1 / 0; a malformed time (NULL hour) stays NULL."""
    return F.when(hour.isin(PEAK_HOURS), 1).when(hour.isNotNull(), 0)


def time_block(hour: Column) -> Column:
    expr = None
    for lo, hi, name in TIME_BLOCKS:
        cond = (hour >= lo) & (hour < hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.when(hour.isNotNull(), TIME_BLOCK_ELSE)


def with_time_features(df: DataFrame, ts: str = "timestamp", day: str = "day") -> DataFrame:
    df = df.withColumns({"hour": hour_of(F.col(ts)), "minute": minute_of(F.col(ts))})
    h = F.col("hour")
    angle = F.lit(2 * math.pi) * h / F.lit(24.0)
    dow = F.pmod(F.col(day), F.lit(7))
    return df.withColumns({
        "total_minutes": h * 60 + F.col("minute"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_peak_hour": is_peak(h),
        "day_of_week": dow,
        "is_weekend": F.when(dow.isin(WEEKEND_DAYS), 1).when(dow.isNotNull(), 0),
        "time_block": time_block(h),
    })
