"""zonecast: Spark-native traffic-demand analytics.

Observation tables (zone, day, time of day, road, weather, demand) are cleaned,
feature-engineered, target-encoded per zone, summarised, modelled with Spark ML
and scored in batch or as a stream.  Everything is a DataFrame transformation;
actions happen only when fitting statistics, training models or writing sinks.
"""

from zonecast.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
