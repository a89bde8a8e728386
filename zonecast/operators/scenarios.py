"""What-if scenarios (W1-W3) for every zone at once.

A scenario list is a small parameter table given by the caller; it is attached
to each base row with ``explode`` of a literal array (a generator inside the
same stage, no join and no shuffle), then the ordinary feature / scoring plan
runs over the expanded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.labels import delta_status, pct_delta
from zonecast.schema import EVENT_MULTIPLIER, INCIDENT_SURGE_PER_SEVERITY

INCIDENT_TYPES = ["accident", "construction", "flood"]
# What-if overrides (W1): lane closure, weather and temperature changes.
OVERRIDES = [{"scenario": "lanes_1", "sim_lanes": 1, "sim_weather": None, "sim_temperature": None},
             {"scenario": "snow", "sim_lanes": None, "sim_weather": "Snowy", "sim_temperature": None},
             {"scenario": "heat", "sim_lanes": None, "sim_weather": None, "sim_temperature": 40.0}]


def explode_scenarios(df: DataFrame, scenarios: list[dict]) -> DataFrame:
    """One copy of every row per scenario, scenario fields as columns."""
    if not scenarios:
        raise ValueError("at least one scenario is required")
    keys = list(scenarios[0])
    arr = F.array(*[F.struct(*[F.lit(s.get(k)).alias(k) for k in keys]) for s in scenarios])
    return df.withColumn("__s", F.explode(arr)).select("*", *[F.col(f"__s.{k}").alias(k)
                                                             for k in keys]).drop("__s")


def apply_overrides(df: DataFrame, lanes: str = "sim_lanes", weather: str = "sim_weather",
                    temperature: str = "sim_temperature") -> DataFrame:
    """Scenario values replace the observation's where given."""
    out = df
    for src, dst in ((lanes, "NumberofLanes"), (weather, "Weather"), (temperature, "Temperature")):
        if src in df.columns:
            out = out.withColumn(dst, F.coalesce(F.col(src).cast(df.schema[dst].dataType),
                                                 F.col(dst)))
    return out


def event_surge(baseline: DataFrame, events: list[dict], base_col: str = "baseline") -> DataFrame:
    """surge = base * (1 + (type multiplier - 1) * attendance_k / 100)."""
    ev = explode_scenarios(baseline, events)
    mult = None
    for name, m in EVENT_MULTIPLIER.items():
        mult = (F.when(F.col("event_type") == name, m) if mult is None
                else mult.when(F.col("event_type") == name, m))
    factor = F.lit(1.0) + (mult - F.lit(1.0)) * (F.col("attendance_k") / F.lit(100.0))
    surge = F.col(base_col) * factor
    return (ev.withColumn("multiplier", factor).withColumn("surge", surge)
            .withColumn("delta_pct", pct_delta(F.col("surge"), F.col(base_col))))


def incident_parameters(df: DataFrame, lanes: str = "NumberofLanes",
                        weather: str = "Weather") -> DataFrame:
    """W3 parameters per (incident, severity) row: simulated lanes, weather and
    the demand surge factor."""
    sev = F.col("severity")
    base_lanes = F.col(lanes)
    sim_lanes = (F.when(F.col("incident") == "accident",
                        F.greatest(F.lit(1), base_lanes - F.floor(sev / 2).cast("int")))
                 .when(F.col("incident") == "construction",
                       F.greatest(F.lit(1), base_lanes - sev))
                 .otherwise(base_lanes))
    sim_weather = (F.when(F.col("incident") == "flood",
                          F.when(sev > 3, F.lit("Rainy")).otherwise(F.lit("Cloudy")))
                   .otherwise(F.col(weather)))
    return df.withColumns({
        "sim_lanes": sim_lanes.cast("int"), "sim_weather": sim_weather,
        "surge_factor": F.lit(1.0) + sev * F.lit(INCIDENT_SURGE_PER_SEVERITY)})


def incident_grid(max_severity: int = 5) -> list[dict]:
    return [{"incident": t, "severity": s} for t in INCIDENT_TYPES
            for s in range(1, max_severity + 1)]
