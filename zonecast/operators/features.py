"""Full feature pipeline (F1-F18): time, geohash, prefixes, zone encoding,
road, weather and interaction columns, all native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from zonecast.functions.attributes import (with_interactions, with_ratio, with_road_features,
                                          with_weather_features)
from zonecast.functions.geo import with_geo_prefixes, with_geohash_latlon
from zonecast.functions.temporal import with_time_features
from zonecast.operators.encoding import ZoneEncoding, fit_encoding, no_stats_encoding


def row_features(df: DataFrame, decode: bool = True) -> DataFrame:
    """Everything that depends on the row alone (no fitted statistics).  With
    ``decode=False`` latitude/longitude are left to the zone encoding, which
    carries them per fitted zone (decoded once per zone, not per row)."""
    out = with_time_features(df)
    if decode:
        out = with_geohash_latlon(out)
    return with_geo_prefixes(out)


def engineer(df: DataFrame, enc: ZoneEncoding | None = None, fit: bool = False,
             density_scope: str = "fitted") -> tuple[DataFrame, ZoneEncoding | None]:
    """With ``fit`` and no ``enc`` the statistics are fitted on ``df``
    itself; with ``enc`` they are applied; with neither, placeholders (F18)."""
    if enc is None and fit:
        enc = fit_encoding(df)
    base = row_features(df, decode=enc is None)
    out = enc.transform(base, density_scope) if enc is not None else no_stats_encoding(base)
    out = with_road_features(out)
    out = with_ratio(out)
    out = with_weather_features(out)
    out = with_interactions(out)
    return out, enc


def finish_features(df: DataFrame) -> DataFrame:
    """Columns that follow the zone encoding (ratio uses ``geo_mean_demand``)."""
    out = with_road_features(df)
    out = with_ratio(out)
    out = with_weather_features(out)
    return with_interactions(out)


def categorical_frame(df: DataFrame) -> DataFrame:
    """The seven categorical features need no fitted statistics: derive them
    from the row alone (time block, road x lanes, road x weather)."""
    return finish_features(no_stats_encoding(row_features(df)))
