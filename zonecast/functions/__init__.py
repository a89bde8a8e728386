from zonecast.functions.attributes import (lane_text, weather_severity, with_interactions,
                                          with_ratio, with_road_features, with_weather_features)
from zonecast.functions.geo import (geo_prefix, geohash_latlon, with_geo_prefixes,
                                   with_geohash_latlon)
from zonecast.functions.labels import (clip, delta_status, demand_class, pct_delta,
                                      peak_label, risk_pct)
from zonecast.functions.temporal import (hour_of, is_peak, minute_of, time_block,
                                        with_time_features)

__all__ = [
    "lane_text", "weather_severity", "with_interactions", "with_ratio", "with_road_features",
    "with_weather_features", "geo_prefix", "geohash_latlon", "with_geo_prefixes",
    "with_geohash_latlon", "clip", "delta_status", "demand_class", "pct_delta", "peak_label",
    "risk_pct", "hour_of", "is_peak", "minute_of", "time_block",
    "with_time_features",
]
