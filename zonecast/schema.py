"""Observation schema, feature lists and the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Observation schema (one row per zone, day and time of day).  ``row_id`` is the
# row key (``Index`` in submission files); ``lanes_text`` is an optional raw
# text form of the lane count used to exercise numeric coercion.
OBS_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("geohash", T.StringType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("RoadType", T.StringType()),
    T.StructField("NumberofLanes", T.DoubleType()),
    T.StructField("LargeVehicles", T.StringType()),
    T.StructField("Landmarks", T.StringType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Weather", T.StringType()),
    T.StructField("demand", T.DoubleType()),
])

ID = "row_id"
TARGET = "demand"

# --- Fixed values (must equal the reference for identical results) ---------
CATEGORY_FILL = "Unknown"
CATEGORY_FILL_COLUMNS = ["RoadType", "Weather", "LargeVehicles", "Landmarks"]
STRIP_COLUMNS = ["geohash", "timestamp", "RoadType", "LargeVehicles", "Landmarks", "Weather"]
PEAK_HOURS = [7, 8, 9, 17, 18, 19]
WEEKEND_DAYS = [5, 6]
# time blocks: [5,12) Morning, [12,17) Afternoon, [17,21) Evening, else Night
TIME_BLOCKS = [(5, 12, "Morning"), (12, 17, "Afternoon"), (17, 21, "Evening")]
TIME_BLOCK_ELSE = "Night"
WEATHER_SEVERITY = {"Sunny": 1.0, "Cloudy": 2.0, "Unknown": 2.0, "Rainy": 3.5,
                    "Foggy": 4.0, "Snowy": 5.0}
WEATHER_SEVERITY_DEFAULT = 2.0
HEAVY_VEHICLE_VALUE = "Allowed"
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# demand classes: < 0.05 LOW, < 0.15 MEDIUM, else HIGH; risk = min(100, int(500 * demand))
DEMAND_CLASS_CUTS = [(0.05, "LOW"), (0.15, "MEDIUM")]
DEMAND_CLASS_ELSE = "HIGH"
RISK_SCALE = 500
RISK_CAP = 100
# scenario status: delta % > 15 HIGH, < -5 ALLEVIATED, else STABLE
DELTA_HIGH = 15.0
DELTA_LOW = -5.0
STATUS_HIGH = "HIGH CONGESTION RISK"
STATUS_LOW = "CONGESTION ALLEVIATED"
STATUS_STABLE = "STABLE CONDITIONS"
# event surge multipliers by event type
EVENT_MULTIPLIER = {"Music Concert": 1.4, "Sports Game": 1.5, "City Festival": 1.3,
                    "Conference": 1.15}
# incidents: lanes after an accident max(1, base - sev div 2), construction
# max(1, base - sev); flood turns weather to Rainy when sev > 3 else Cloudy;
# simulated demand scaled by 1 + 0.15 * sev
INCIDENT_SURGE_PER_SEVERITY = 0.15
BLEND_PAIR = {"cat": 0.6, "lgb": 0.4}
BLEND_TRIO = {"cat": 0.5, "lgb": 0.3, "xgb": 0.2}
EXPECTED_SUBMISSION_COLUMNS = ["Index", "demand"]
PEAK_LABELS = {1: "Peak Rush Hours", 0: "Off-Peak Hours"}
# columns of the small and the large correlation matrix
CORR_COLUMNS = ["demand", "hour", "NumberofLanes", "Temperature", "day"]
CORR_FEATURES = ["demand", "hour", "minute", "total_minutes", "latitude", "longitude",
                 "NumberofLanes", "Temperature", "weather_severity", "lane_capacity",
                 "geo_freq", "geo_mean_demand", "geo_density", "geo_rank",
                 "congestion_capacity_ratio", "temp_weather_interaction"]
# the request form's values, used as the base observation of incident scenarios
BASE_REQUEST = {"day": 48, "timestamp": "08:30", "RoadType": "Highway", "NumberofLanes": 4, "LargeVehicles": "Allowed",
                "Landmarks": "No", "Temperature": 18.0, "Weather": "Cloudy"}

CATEGORICAL_FEATURES = ["RoadType", "LargeVehicles", "Landmarks", "Weather",
                        "time_block", "road_lane_interaction", "road_weather"]

NUMERIC_FEATURES = [
    "day", "NumberofLanes", "Temperature",
    "hour", "minute", "total_minutes", "hour_sin", "hour_cos", "is_peak_hour",
    "day_of_week", "is_weekend", "latitude", "longitude",
    "geo_mean_demand", "geo_std_demand", "geo_median_demand", "geo_freq",
    "geo_rank", "geo_density",
    "lane_capacity", "heavy_vehicle_score", "congestion_capacity_ratio",
    "weather_severity", "temp_weather_interaction",
    "temp_hour", "lane_temp", "weather_hour", "lane_vehicle", "peak_weather",
]
# ---------------------------------------------------------------------------
