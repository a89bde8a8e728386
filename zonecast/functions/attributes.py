"""Road (F9-F12), weather (F13-F14) and interaction (F15-F17) features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.schema import HEAVY_VEHICLE_VALUE, WEATHER_SEVERITY, WEATHER_SEVERITY_DEFAULT


def lane_text(lanes: Column) -> Column:
    """Integer lanes rendered as text (``3``), as string concatenation needs."""
    return lanes.cast("int").cast("string")


def weather_severity(weather: Column) -> Column:
    expr = None
    for name, sev in WEATHER_SEVERITY.items():
        expr = (F.when(weather == name, sev) if expr is None
                else expr.when(weather == name, sev))
    return expr.otherwise(WEATHER_SEVERITY_DEFAULT)


def with_road_features(df: DataFrame) -> DataFrame:
    """F9-F11.  F12 needs ``geo_mean_demand`` and is added by ``with_ratio``."""
    return df.withColumns({
        "lane_capacity": F.col("NumberofLanes").cast("double"),
        "heavy_vehicle_score": F.when(F.col("LargeVehicles") == HEAVY_VEHICLE_VALUE, 1).otherwise(0),
        "road_lane_interaction": F.concat(F.col("RoadType"), F.lit("_"),
                                          lane_text(F.col("NumberofLanes"))),
    })


def with_ratio(df: DataFrame) -> DataFrame:
    """congestion ratio = zone mean / max(lane capacity, 1)."""
    return df.withColumn("congestion_capacity_ratio",
                         F.col("geo_mean_demand") / F.greatest(F.col("lane_capacity"), F.lit(1.0)))


def with_weather_features(df: DataFrame) -> DataFrame:
    sev = weather_severity(F.col("Weather"))
    return df.withColumns({
        "weather_severity": sev,
        "temp_weather_interaction": F.col("Temperature") * sev,
    })


def with_interactions(df: DataFrame) -> DataFrame:
    """F15-F17 (needs hour, severity, heavy score and geo_prefix_5)."""
    hour_txt = F.col("hour").cast("string")
    return df.withColumns({
        "temp_hour": F.col("Temperature") * F.col("hour"),
        "lane_temp": F.col("NumberofLanes") * F.col("Temperature"),
        "weather_hour": F.col("weather_severity") * F.col("hour"),
        "road_weather": F.concat(F.col("RoadType"), F.lit("_"), F.col("Weather")),
        "road_hour": F.concat(F.col("RoadType"), F.lit("_"), hour_txt),
        "lane_vehicle": F.col("NumberofLanes") * F.col("heavy_vehicle_score"),
        "geo_hour": F.concat(F.col("geo_prefix_5"), F.lit("_"), hour_txt),
        "peak_weather": F.col("is_peak_hour") * F.col("weather_severity"),
    })
