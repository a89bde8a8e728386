"""DuckDB texts equivalent to the registered queries (the correctness oracle).

Written independently of the Spark plans: statistics are computed from rows
(not from partials), medians with ``quantile_cont``, geohash decoding with list
functions.  Doubles are rounded like the Spark side.
"""

from __future__ import annotations

from zonecast.schema import CORR_COLUMNS, CORR_FEATURES
from zonecast.sources.adapter import adapter_sql

R = 9  # rounding digits for doubles
# 60 bits of md5('42:' || row_id): the fold and sample order of seed 42
_MIX = "CAST(('0x' || substr(md5('42:' || coalesce(CAST(row_id AS VARCHAR), '')), 1, 15)) AS BIGINT)"
# the block of five that the shuffled row number __i of __n falls into; the first __n % 5 blocks have one row more
_BLOCK = "CAST(CASE WHEN __i < (__n // 5 + 1) * (__n % 5) THEN __i // (__n // 5 + 1) ELSE __n % 5 + (__i - (__n // 5 + 1) * (__n % 5)) // (__n // 5) END AS INTEGER)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _hour(ts: str) -> str:
    return (f"CASE WHEN len(string_split({ts}, ':')) = 2 "
            f"THEN TRY_CAST(string_split({ts}, ':')[1] AS INTEGER) END")


def _minute(ts: str) -> str:
    return (f"CASE WHEN len(string_split({ts}, ':')) = 2 "
            f"THEN TRY_CAST(string_split({ts}, ':')[2] AS INTEGER) END")


def _bits_value(bits: str) -> str:
    return (f"list_sum(list_transform(range(length({bits})), lambda i: "
            f"CAST(substr({bits}, i + 1, 1) AS DOUBLE) * pow(2, length({bits}) - 1 - i)))")


def _latlon(g: str) -> tuple[str, str]:
    digits = (f"list_transform(string_split(lower({g}), ''), "
              f"lambda ch: lpad(bin(instr('0123456789bcdefghjkmnpqrstuvwxyz', ch) - 1), 5, '0'))")
    bits = f"array_to_string({digits}, '')"
    lon_bits = f"regexp_replace({bits}, '(.)(.?)', '\\1', 'g')"
    lat_bits = f"regexp_replace({bits}, '(.)(.?)', '\\2', 'g')"
    valid = f"regexp_full_match(lower({g}), '[0-9b-hjkmnp-z]+')"
    lat = (f"CASE WHEN {valid} THEN -90.0 + 180.0 * ({_bits_value(lat_bits)} + 0.5) "
           f"/ pow(2, length({lat_bits})) END")
    lon = (f"CASE WHEN {valid} THEN -180.0 + 360.0 * ({_bits_value(lon_bits)} + 0.5) "
           f"/ pow(2, length({lon_bits})) END")
    return lat, lon


def _sev(w: str) -> str:
    return (f"CAST(CASE WHEN {w} = 'Sunny' THEN 1.0 WHEN {w} = 'Cloudy' THEN 2.0 "
            f"WHEN {w} = 'Unknown' THEN 2.0 WHEN {w} = 'Rainy' THEN 3.5 "
            f"WHEN {w} = 'Foggy' THEN 4.0 WHEN {w} = 'Snowy' THEN 5.0 ELSE 2.0 END AS DOUBLE)")


def _block(h: str) -> str:
    return (f"CASE WHEN {h} >= 5 AND {h} < 12 THEN 'Morning' WHEN {h} >= 12 AND {h} < 17 "
            f"THEN 'Afternoon' WHEN {h} >= 17 AND {h} < 21 THEN 'Evening' WHEN {h} IS NOT NULL THEN 'Night' END")


def _clean_select(src: str) -> str:
    return f"""SELECT row_id, {_strip('geohash')} AS geohash, day, {_strip('timestamp')} AS timestamp,
      {_strip("coalesce(RoadType, 'Unknown')")} AS RoadType,
      CAST(trunc(coalesce(NumberofLanes, CAST(l_med AS DOUBLE))) AS INTEGER) AS NumberofLanes,
      lanes_text,
      {_strip("coalesce(LargeVehicles, 'Unknown')")} AS LargeVehicles,
      {_strip("coalesce(Landmarks, 'Unknown')")} AS Landmarks,
      coalesce(Temperature, t_med) AS Temperature,
      {_strip("coalesce(Weather, 'Unknown')")} AS Weather, demand
    FROM {src} CROSS JOIN med"""


LAT, LON = _latlon("geohash")

BASE = f"""WITH obs AS ({adapter_sql()}),
tr AS (SELECT DISTINCT * EXCLUDE (is_train) FROM obs WHERE is_train),
med AS (SELECT quantile_cont(Temperature, 0.5) AS t_med,
          CAST(round_even(coalesce(quantile_cont(NumberofLanes, 0.5), 1), 0) AS INTEGER) AS l_med
        FROM tr),
ct AS ({_clean_select('tr')}),
cs AS ({_clean_select("(SELECT * EXCLUDE (is_train) FROM obs WHERE NOT is_train)")}),
an AS (SELECT *, {_hour('timestamp')} AS hour, {_minute('timestamp')} AS minute,
         CASE WHEN {_hour('timestamp')} IN (7, 8, 9, 17, 18, 19) THEN 1 WHEN {_hour('timestamp')} IS NOT NULL THEN 0 END AS is_peak_hour,
         {LAT} AS latitude, {LON} AS longitude
       FROM ct),
ans AS (SELECT *, {_hour('timestamp')} AS hour, {_minute('timestamp')} AS minute,
         CASE WHEN {_hour('timestamp')} IN (7, 8, 9, 17, 18, 19) THEN 1 WHEN {_hour('timestamp')} IS NOT NULL THEN 0 END AS is_peak_hour,
         {LAT} AS latitude, {LON} AS longitude
       FROM cs),
lc AS ({_clean_select("(SELECT DISTINCT * EXCLUDE (is_train) FROM obs)")}),
zs AS (SELECT geohash, avg(demand) AS m, coalesce(stddev_samp(demand), 0.0) AS s,
         quantile_cont(demand, 0.5) AS md, count(demand) AS c
       FROM ct WHERE geohash IS NOT NULL GROUP BY geohash),
zr AS (SELECT *, CAST(row_number() OVER (ORDER BY CAST(m AS DECIMAL(38, 12)) DESC NULLS LAST, geohash) AS INTEGER) AS rk
       FROM zs),
ps AS (SELECT 5 AS level, substr(geohash, 1, 5) AS prefix, avg(demand) AS pm FROM ct
         WHERE geohash IS NOT NULL GROUP BY 2
       UNION ALL SELECT 4, substr(geohash, 1, 4), avg(demand) FROM ct
         WHERE geohash IS NOT NULL GROUP BY 2
       UNION ALL SELECT 3, substr(geohash, 1, 3), avg(demand) FROM ct
         WHERE geohash IS NOT NULL GROUP BY 2),
gs AS (SELECT avg(demand) AS gm, quantile_cont(demand, 0.5) AS gmed,
         (SELECT count(*) FROM zs) AS nz, (SELECT greatest(max(c), 1) FROM zs) AS mxf FROM ct)
"""


def _encode(src: str) -> str:
    """Target encoding of ``src`` rows with the full-train statistics."""
    return f"""SELECT f.*,
      coalesce(z.m, p5.pm, p4.pm, p3.pm, g.gm) AS geo_mean_demand,
      coalesce(z.s, 0.0) AS geo_std_demand,
      coalesce(z.md, g.gmed) AS geo_median_demand,
      coalesce(CAST(z.c AS DOUBLE), 1.0) AS geo_freq,
      CAST(coalesce(z.rk, g.nz + 1) AS INTEGER) AS geo_rank,
      coalesce(CAST(z.c AS DOUBLE), 1.0) / CAST(g.mxf AS DOUBLE) AS geo_density,
      CAST(f.NumberofLanes AS DOUBLE) AS lane_capacity,
      CASE WHEN z.m IS NOT NULL THEN 'exact' WHEN p5.pm IS NOT NULL THEN 'p5'
           WHEN p4.pm IS NOT NULL THEN 'p4' WHEN p3.pm IS NOT NULL THEN 'p3'
           ELSE 'global' END AS fallback_level
    FROM {src} f
    LEFT JOIN zr z ON z.geohash = f.geohash
    LEFT JOIN ps p5 ON p5.level = 5 AND p5.prefix = substr(f.geohash, 1, 5)
    LEFT JOIN ps p4 ON p4.level = 4 AND p4.prefix = substr(f.geohash, 1, 4)
    LEFT JOIN ps p3 ON p3.level = 3 AND p3.prefix = substr(f.geohash, 1, 3)
    CROSS JOIN gs g"""


def rd(x: str, digits: int = R) -> str:
    """Round through DECIMAL(38,12) (same rule as the Spark side)."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def r(x: str, name: str, digits: int = R) -> str:
    return f"{rd(x, digits)} AS {name}"


OBS_COLS = ("row_id, geohash, day, timestamp, RoadType, NumberofLanes, lanes_text, LargeVehicles, "
            "Landmarks, Temperature, Weather, demand")


def _round_clean_cols() -> str:
    return ("row_id, geohash, day, timestamp, RoadType, NumberofLanes, lanes_text, LargeVehicles, "
            f"Landmarks, {rd('Temperature')} AS Temperature, Weather, {rd('demand')} AS demand")


def _mean_by(key: str, src: str = "an") -> str:
    return (f"{BASE} SELECT {key}, {rd('avg(demand)')} AS mean_demand FROM {src} "
            f"WHERE {key} IS NOT NULL GROUP BY {key}")


def _corr(cols: list[str], src: str, digits: int) -> str:
    parts = []
    for a in cols:
        for b in cols:
            x = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            expr = (f"CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN "
                    f"covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r(expr, 'r', digits)} FROM {src}")
    return " UNION ALL ".join(parts)


def _feat(src: str = "an") -> str:
    """Full feature rows of ``src`` (for feature correlation and category codes)."""
    return f"""SELECT e.*, {_sev('Weather')} AS weather_severity,
      Temperature * {_sev('Weather')} AS temp_weather_interaction,
      {_hour('timestamp')} * 60 + {_minute('timestamp')} AS total_minutes,
      geo_mean_demand / greatest(lane_capacity, 1.0) AS congestion_capacity_ratio,
      {_block(_hour('timestamp'))} AS time_block,
      RoadType || '_' || CAST(NumberofLanes AS VARCHAR) AS road_lane_interaction,
      RoadType || '_' || Weather AS road_weather
    FROM ({_encode(src)}) e"""


CATS = ["RoadType", "LargeVehicles", "Landmarks", "Weather", "time_block",
        "road_lane_interaction", "road_weather"]


def _oof() -> str:
    k = 5
    return f"""
cv AS (SELECT * EXCLUDE (__i, __n), {_BLOCK} AS fold FROM (
    SELECT *, row_number() OVER (ORDER BY {_MIX}, row_id) - 1 AS __i, count(*) OVER () AS __n FROM lc WHERE day <= 24) s),
ho AS (SELECT lc.*, f.fold FROM lc CROSS JOIN range(0, {k}) f(fold) WHERE day > 24),
ex AS (SELECT cv.* EXCLUDE (fold), f.fold FROM cv CROSS JOIN range(0, {k}) f(fold)
       WHERE f.fold <> cv.fold),
fz AS (SELECT fold, geohash, avg(demand) AS m, coalesce(stddev_samp(demand), 0.0) AS s,
         quantile_cont(demand, 0.5) AS md, count(demand) AS c
       FROM ex WHERE geohash IS NOT NULL GROUP BY fold, geohash),
fzr AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY CAST(m AS DECIMAL(38, 12)) DESC NULLS LAST, geohash)
          AS INTEGER) AS rk FROM fz),
fp AS (SELECT fold, 5 AS level, substr(geohash, 1, 5) AS prefix, avg(demand) AS pm FROM ex
         WHERE geohash IS NOT NULL GROUP BY 1, 3
       UNION ALL SELECT fold, 4, substr(geohash, 1, 4), avg(demand) FROM ex
         WHERE geohash IS NOT NULL GROUP BY 1, 3
       UNION ALL SELECT fold, 3, substr(geohash, 1, 3), avg(demand) FROM ex
         WHERE geohash IS NOT NULL GROUP BY 1, 3),
fg AS (SELECT fold, avg(demand) AS gm, quantile_cont(demand, 0.5) AS gmed FROM ex GROUP BY fold),
fn AS (SELECT fold, count(*) AS nz FROM fz GROUP BY fold),
fenc AS (SELECT r.row_id, r.fold, r.split,
      coalesce(z.m, p5.pm, p4.pm, p3.pm, g.gm) AS geo_mean_demand,
      coalesce(z.s, 0.0) AS geo_std_demand, coalesce(z.md, g.gmed) AS geo_median_demand,
      coalesce(CAST(z.c AS DOUBLE), 1.0) AS geo_freq,
      CAST(coalesce(z.rk, n.nz + 1) AS INTEGER) AS geo_rank
    FROM (SELECT row_id, geohash, fold, 'val' AS split FROM cv
          UNION ALL SELECT row_id, geohash, fold, 'holdout' FROM ho) r
    LEFT JOIN fzr z ON z.fold = r.fold AND z.geohash = r.geohash
    LEFT JOIN fp p5 ON p5.fold = r.fold AND p5.level = 5 AND p5.prefix = substr(r.geohash, 1, 5)
    LEFT JOIN fp p4 ON p4.fold = r.fold AND p4.level = 4 AND p4.prefix = substr(r.geohash, 1, 4)
    LEFT JOIN fp p3 ON p3.fold = r.fold AND p3.level = 3 AND p3.prefix = substr(r.geohash, 1, 3)
    LEFT JOIN fg g ON g.fold = r.fold
    LEFT JOIN fn n ON n.fold = r.fold)
"""


def _blend_sql() -> str:
    cat, lgb = "geo_mean_demand", "geo_median_demand"
    xgb = "(geo_mean_demand * 0.5 + geo_median_demand * 0.5)"
    return f"""{BASE} SELECT row_id,
      {r(f"{cat} * 0.6 + {lgb} * 0.4", 'blend_pair')},
      {r(f"{cat} * 0.5 + {lgb} * 0.3 + {xgb} * 0.2", 'blend_trio')},
      {r(f"{cat} * (1.0 / 3) + {lgb} * (1.0 / 3) + {xgb} * (1.0 / 3)", 'blend_uniform')},
      {r(f"{cat} * 0.5 + {lgb} * 0.5 + {xgb} * 0.0", 'blend_normalized')},
      {r(f"least(0.15, greatest(0.05, {cat} * (1.0 / 3) + {lgb} * (1.0 / 3) + {xgb} * (1.0 / 3)))",
         'blend_clipped')}
    FROM ({_encode('an')}) e"""


def _events() -> str:
    rows = []
    for t, m in [("Music Concert", 1.4), ("Sports Game", 1.5), ("City Festival", 1.3),
                 ("Conference", 1.15)]:
        for k in (20, 50, 100):
            rows.append(f"('{t}', {k}, {m})")
    return "VALUES " + ", ".join(rows)


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    raw = (f"row_id, geohash, day, timestamp, RoadType, {rd('NumberofLanes')} AS NumberofLanes, "
           f"lanes_text, LargeVehicles, Landmarks, {rd('Temperature')} AS Temperature, Weather, "
           f"{rd('demand')} AS demand, is_train")
    s["scan_observations"] = f"WITH obs AS ({adapter_sql()}) SELECT {raw} FROM obs"
    s["dedup"] = (f"WITH obs AS ({adapter_sql()}) SELECT DISTINCT {raw} FROM "
                  f"(SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE row_id % 29 = 0)")
    s["train_medians"] = f"{BASE} SELECT {rd('t_med')} AS Temperature, l_med AS NumberofLanes FROM med"
    s["coerce_numeric"] = (f"WITH obs AS ({adapter_sql()}) SELECT row_id, lanes_text, "
                           f"{rd('TRY_CAST(lanes_text AS DOUBLE)')} AS lanes_value FROM obs")
    s["impute"] = f"""{BASE} SELECT row_id, geohash, day, timestamp,
        coalesce(RoadType, 'Unknown') AS RoadType,
        CAST(trunc(coalesce(NumberofLanes, CAST(l_med AS DOUBLE))) AS INTEGER) AS NumberofLanes,
        lanes_text, coalesce(LargeVehicles, 'Unknown') AS LargeVehicles,
        coalesce(Landmarks, 'Unknown') AS Landmarks,
        {rd('coalesce(Temperature, t_med)')} AS Temperature,
        coalesce(Weather, 'Unknown') AS Weather, {rd('demand')} AS demand
      FROM tr CROSS JOIN med"""
    s["standardize"] = f"""WITH obs AS ({adapter_sql()}) SELECT row_id, {_strip('geohash')} AS geohash,
        day, {_strip('timestamp')} AS timestamp, {_strip('RoadType')} AS RoadType,
        {rd('NumberofLanes')} AS NumberofLanes,
        lanes_text, {_strip('LargeVehicles')} AS LargeVehicles, {_strip('Landmarks')} AS Landmarks,
        {rd('Temperature')} AS Temperature, {_strip('Weather')} AS Weather,
        {rd('demand')} AS demand, is_train FROM obs"""
    s["clean_train"] = f"{BASE} SELECT {_round_clean_cols()} FROM ct"
    s["impute_score"] = f"{BASE} SELECT {_round_clean_cols()} FROM cs"
    s["impute_score_local"] = f"""WITH obs AS ({adapter_sql()}),
      sr AS (SELECT * EXCLUDE (is_train) FROM obs WHERE NOT is_train),
      med AS (SELECT quantile_cont(Temperature, 0.5) AS t_med, 1 AS l_med FROM sr),
      x AS ({_clean_select('sr')}) SELECT {_round_clean_cols()} FROM x"""
    null_parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM obs"
        for c in ["row_id", "geohash", "day", "timestamp", "RoadType", "NumberofLanes",
                  "lanes_text", "LargeVehicles", "Landmarks", "Temperature", "Weather",
                  "demand", "is_train"])
    s["null_audit"] = f"WITH obs AS ({adapter_sql()}) {null_parts}"
    s["null_audit_total"] = f"""{BASE} SELECT CAST(
        count(*) * 12 - count(row_id) - count(geohash) - count(day) - count(timestamp)
        - count(RoadType) - count(NumberofLanes) - count(lanes_text) - count(LargeVehicles)
        - count(Landmarks) - count(Temperature) - count(Weather) - count(demand) AS BIGINT)
        AS total_missing FROM ct"""
    s["preview"] = f"{BASE} SELECT {_round_clean_cols()} FROM ct ORDER BY row_id LIMIT 10"
    s["shape_report"] = f"{BASE} SELECT count(*) AS rows, 12 AS columns FROM ct"
    s["split_by_day"] = (f"{BASE} SELECT row_id, day, CASE WHEN day <= 24 THEN 'train' "
                         f"ELSE 'holdout' END AS split FROM lc")
    s["align_schema"] = (f"{BASE} SELECT row_id, {rd('coalesce(Temperature, 0)')} AS Temperature, "
                         f"coalesce(NumberofLanes, 0) AS NumberofLanes, "
                         f"{rd('coalesce(demand, 0)')} AS demand, 0 AS absent_feature FROM cs")
    h, mi = _hour("ts"), _minute("ts")
    s["time_features"] = f"""WITH obs AS ({adapter_sql()}),
      t AS (SELECT row_id, day, {_strip('timestamp')} AS ts FROM obs),
      u AS (SELECT row_id, day, {h} AS hour, {mi} AS minute, TRY_CAST(split_part(ts, ':', 1) AS INTEGER) AS leading_hour FROM t)
      SELECT row_id, hour, minute, leading_hour, hour * 60 + minute AS total_minutes,
        {r('sin(2 * pi() * hour / 24.0)', 'hour_sin')}, {r('cos(2 * pi() * hour / 24.0)', 'hour_cos')},
        CASE WHEN hour IN (7, 8, 9, 17, 18, 19) THEN 1 WHEN hour IS NOT NULL THEN 0 END AS is_peak_hour,
        CAST(((day % 7) + 7) % 7 AS INTEGER) AS day_of_week,
        CASE WHEN ((day % 7) + 7) % 7 IN (5, 6) THEN 1 WHEN day IS NOT NULL THEN 0 END AS is_weekend,
        {_block('hour')} AS time_block FROM u"""
    s["geohash_decode"] = (f"WITH obs AS ({adapter_sql()}), z AS (SELECT DISTINCT "
                           f"{_strip('geohash')} AS geohash FROM obs) "
                           f"SELECT geohash, {r(LAT, 'latitude')}, {r(LON, 'longitude')} FROM z")
    s["geo_prefix"] = (f"WITH obs AS ({adapter_sql()}), z AS (SELECT row_id, {_strip('geohash')} "
                       f"AS g FROM obs) SELECT row_id, substr(g, 1, 5) AS geo_prefix_5, "
                       f"substr(g, 1, 4) AS geo_prefix_4, substr(g, 1, 3) AS geo_prefix_3 FROM z")
    s["road_features"] = (f"{BASE} SELECT row_id, CAST(NumberofLanes AS DOUBLE) AS lane_capacity, "
                          f"CASE WHEN LargeVehicles = 'Allowed' THEN 1 ELSE 0 END AS heavy_vehicle_score, "
                          f"RoadType || '_' || CAST(NumberofLanes AS VARCHAR) AS road_lane_interaction FROM ct")
    s["weather_features"] = (f"{BASE} SELECT row_id, {_sev('Weather')} AS weather_severity, "
                             f"{r('Temperature * ' + _sev('Weather'), 'temp_weather_interaction')} FROM ct")
    sev = _sev("Weather")
    heavy = "CASE WHEN LargeVehicles = 'Allowed' THEN 1 ELSE 0 END"
    s["interactions"] = f"""{BASE} SELECT row_id, {r('Temperature * hour', 'temp_hour')},
        {r('NumberofLanes * Temperature', 'lane_temp')}, {r(f'{sev} * hour', 'weather_hour')},
        RoadType || '_' || Weather AS road_weather,
        RoadType || '_' || CAST(hour AS VARCHAR) AS road_hour,
        NumberofLanes * {heavy} AS lane_vehicle,
        substr(geohash, 1, 5) || '_' || CAST(hour AS VARCHAR) AS geo_hour,
        {r(f'is_peak_hour * {sev}', 'peak_weather')} FROM an"""
    s["features_nostats"] = (f"{BASE} SELECT row_id, CAST(0 AS DOUBLE) AS geo_mean_demand, "
                             f"CAST(0 AS DOUBLE) AS geo_std_demand, CAST(0 AS DOUBLE) AS geo_median_demand, "
                             f"CAST(1 AS DOUBLE) AS geo_freq, 1 AS geo_rank, CAST(1 AS DOUBLE) AS geo_density, "
                             f"{r('0.0 / greatest(CAST(NumberofLanes AS DOUBLE), 1.0)', 'congestion_capacity_ratio')} "
                             f"FROM ct")
    s["demand_category"] = f"""{BASE} SELECT row_id, {rd('demand')} AS demand,
        CASE WHEN demand < 0.05 THEN 'LOW' WHEN demand < 0.15 THEN 'MEDIUM'
             WHEN demand IS NOT NULL THEN 'HIGH' END AS category,
        CASE WHEN demand IS NOT NULL THEN CAST(least(100, trunc(demand * 500)) AS INTEGER) END AS risk_pct
        FROM ct"""
    zcols = (f"geohash, {r('m', 'geo_mean_demand')}, {r('s', 'geo_std_demand')}, "
             f"{r('md', 'geo_median_demand')}, c AS geo_freq")
    s["zone_stats"] = f"{BASE} SELECT {zcols}, rk AS geo_rank FROM zr"
    s["zone_stats_direct"] = f"{BASE} SELECT {zcols} FROM zs"
    s["prefix_stats"] = f"{BASE} SELECT level, prefix, {r('pm', 'prefix_mean')} FROM ps"
    s["global_stats"] = f"{BASE} SELECT {r('gm', 'global_mean')}, {r('gmed', 'global_median')} FROM gs"
    s["zone_rank"] = f"{BASE} SELECT geohash, rk AS geo_rank FROM zr"
    enc_sel = (f"row_id, geohash, {r('geo_mean_demand', 'geo_mean_demand')}, "
               f"{r('geo_std_demand', 'geo_std_demand')}, "
               f"{r('geo_median_demand', 'geo_median_demand')}, {r('geo_freq', 'geo_freq')}, "
               f"geo_rank, {r('geo_density', 'geo_density')}, "
               f"{r('geo_mean_demand / greatest(lane_capacity, 1.0)', 'congestion_capacity_ratio')}")
    s["target_encode"] = f"{BASE} SELECT {enc_sel} FROM ({_encode('cs')}) e"
    s["target_encode_batch"] = (f"{BASE}, e AS ({_encode('cs')}) SELECT "
                                + enc_sel.replace(r('geo_density', 'geo_density'),
                                                  r('geo_freq / (SELECT max(geo_freq) FROM e)',
                                                    'geo_density'))
                                + " FROM e")
    s["fallback_levels"] = (f"{BASE} SELECT fallback_level AS level, count(*) AS n "
                            f"FROM ({_encode('cs')}) e GROUP BY 1")
    s["unseen_zones"] = (f"{BASE} SELECT row_id, geohash FROM cs WHERE geohash IS NULL OR "
                         f"geohash NOT IN (SELECT geohash FROM zs)")
    cat_union = " UNION ".join(
        f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS category FROM ft"
        for c in CATS)
    s["category_codes"] = (f"{BASE}, ft AS ({_feat()}), u AS ({cat_union}) SELECT column_name, "
                           f"category, CAST(row_number() OVER (PARTITION BY column_name ORDER BY "
                           f"category) - 1 AS INTEGER) AS code FROM u")
    score_ft = _feat("ans")
    code_cols = ", ".join(
        f"coalesce((SELECT code FROM codes k WHERE k.column_name = '{c}' AND "
        f"k.category = coalesce(CAST(sf.{c} AS VARCHAR), 'nan')), -1) AS {c}_code" for c in CATS)
    s["category_codes_apply"] = (f"{BASE}, ft AS ({_feat()}), u AS ({cat_union}), codes AS ("
                                 f"SELECT column_name, category, CAST(row_number() OVER (PARTITION BY "
                                 f"column_name ORDER BY category) - 1 AS INTEGER) AS code FROM u), "
                                 f"sf AS ({score_ft}) SELECT row_id, {code_cols} FROM sf")
    s["hourly_demand"] = _mean_by("hour")
    s["weather_mean"] = _mean_by("Weather")
    s["road_mean"] = _mean_by("RoadType")
    s["lane_mean"] = _mean_by("NumberofLanes")
    s["weather_summary"] = (f"{BASE} SELECT Weather, {rd('round_even(avg(demand), 5)')} AS mean_demand, "
                            f"{rd('round_even(stddev_samp(demand), 5)')} AS std_demand, count(demand) AS n "
                            f"FROM an WHERE Weather IS NOT NULL GROUP BY Weather")
    s["peak_contrast"] = (f"{BASE} SELECT is_peak_hour, {r('avg(demand)', 'mean_demand')}, "
                          f"CASE WHEN is_peak_hour = 1 THEN 'Peak Rush Hours' ELSE 'Off-Peak Hours' END "
                          f"AS label FROM an GROUP BY is_peak_hour")
    s["vehicle_landmark_mean"] = (
        f"{BASE} SELECT 'LargeVehicles' AS attribute, LargeVehicles AS value, "
        f"{r('avg(demand)', 'mean_demand')} FROM an WHERE LargeVehicles IS NOT NULL GROUP BY 2 "
        f"UNION ALL SELECT 'Landmarks', Landmarks, {r('avg(demand)', 'mean_demand')} FROM an "
        f"WHERE Landmarks IS NOT NULL GROUP BY 2")
    zone_map = (f"SELECT geohash, avg(demand) AS mean_demand, "
                f"arg_min(NumberofLanes, row_id) FILTER (WHERE NumberofLanes IS NOT NULL) AS lanes, "
                f"any_value(latitude) AS lat, any_value(longitude) AS lon "
                f"FROM an WHERE geohash IS NOT NULL GROUP BY geohash")
    s["zone_map"] = (f"{BASE}, zm AS ({zone_map}) SELECT geohash, {r('mean_demand', 'mean_demand')}, "
                     f"lanes, {r('lat', 'lat')}, {r('lon', 'lon')} FROM zm WHERE lat IS NOT NULL")
    hcols = ", ".join(f"{rd(f'coalesce(avg(demand) FILTER (WHERE hour = {i}), 0.0)')} AS h{i}"
                      for i in range(24))
    s["heatmap_road_hour"] = f"{BASE} SELECT RoadType, {hcols} FROM an WHERE RoadType IS NOT NULL GROUP BY RoadType"
    lcols = ", ".join(f"{rd(f'coalesce(avg(demand) FILTER (WHERE NumberofLanes = {i}), 0.0)')} "
                      f"AS lanes_{i}" for i in range(1, 6))
    s["heatmap_road_lanes"] = f"{BASE} SELECT RoadType, {lcols} FROM an WHERE RoadType IS NOT NULL GROUP BY RoadType"
    s["zone_kpis"] = (f"{BASE}, zm AS ({zone_map}) SELECT {r('max(mean_demand)', 'max_zone_mean')}, "
                      f"{r('min(mean_demand)', 'min_zone_mean')}, count(*) AS n_zones FROM zm "
                      f"WHERE lat IS NOT NULL")
    best = []
    for kpi, key, desc in [("peak_hour", "hour", True), ("worst_zone", "geohash", True),
                           ("worst_weather", "Weather", True), ("best_weather", "Weather", False),
                           ("worst_road", "RoadType", True)]:
        best.append(f"(SELECT '{kpi}' AS kpi, CAST({key} AS VARCHAR) AS key, {rd('m')} AS value "
                    f"FROM (SELECT {key}, avg(demand) AS m FROM an WHERE {key} IS NOT NULL GROUP BY {key}) "
                    f"ORDER BY round(CAST(m AS DECIMAL(38, 12)), 9) {'DESC' if desc else 'ASC'}, {key} LIMIT 1)")
    s["executive_summary"] = f"{BASE} " + " UNION ALL ".join(best)
    s["top_hotspots"] = (f"{BASE}, zm AS ({zone_map}) SELECT geohash, {r('mean_demand', 'mean_demand')}, "
                         f"lanes, {r('lat', 'lat')}, {r('lon', 'lon')} FROM zm WHERE lat IS NOT NULL "
                         f"ORDER BY mean_demand DESC, geohash LIMIT 10")
    s["top_zones_5"] = (f"{BASE} SELECT geohash, {r('avg(demand)', 'mean_demand')} FROM an "
                        f"WHERE geohash IS NOT NULL GROUP BY geohash "
                        f"ORDER BY CAST(avg(demand) AS DECIMAL(38, 12)) DESC, geohash LIMIT 5")
    s["top_hours"] = (f"{BASE} SELECT hour, {r('avg(demand)', 'mean_demand')} FROM an "
                      f"WHERE hour IS NOT NULL GROUP BY hour "
                      f"ORDER BY CAST(avg(demand) AS DECIMAL(38, 12)) DESC, hour LIMIT 2")
    s["demand_profile"] = (f"{BASE} SELECT {r('min(demand)', 'min')}, {r('max(demand)', 'max')}, "
                           f"{r('avg(demand)', 'mean')}, {r('stddev_samp(demand)', 'std')}, "
                           f"{r('quantile_cont(demand, 0.5)', 'median')} FROM an")
    s["correlation"] = f"{BASE} " + _corr(CORR_COLUMNS,
                                          "an", 6)
    s["feature_correlation"] = (f"{BASE}, ft AS ({_feat()}) " + _corr(
        CORR_FEATURES, "ft", 6))
    s["weather_box"] = f"""{BASE}, b AS (SELECT Weather, demand FROM an
          WHERE Weather IS NOT NULL AND demand IS NOT NULL),
        q AS (SELECT Weather, quantile_cont(demand, 0.25) AS q1, quantile_cont(demand, 0.5) AS median,
                quantile_cont(demand, 0.75) AS q3 FROM b GROUP BY Weather),
        f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
        SELECT f.Weather, {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')},
          {r('min(CASE WHEN demand BETWEEN lo_f AND hi_f THEN demand END)', 'lower_whisker')},
          {r('max(CASE WHEN demand BETWEEN lo_f AND hi_f THEN demand END)', 'upper_whisker')},
          count(CASE WHEN NOT (demand BETWEEN lo_f AND hi_f) THEN 1 END) AS n_outliers
        FROM b JOIN f USING (Weather) GROUP BY f.Weather, q1, median, q3"""
    s["demand_histogram"] = f"""{BASE}, mm AS (SELECT min(demand) AS lo, max(demand) AS hi FROM an),
        w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS width FROM mm),
        h AS (SELECT CAST(least(floor((demand - lo) / width) + 1, 50) AS INTEGER) AS bin, count(*) AS n
              FROM an CROSS JOIN w WHERE demand IS NOT NULL GROUP BY 1)
        SELECT CAST(g.i AS INTEGER) AS bin, {r('lo + (g.i - 1) * width', 'bin_lo')}, {r('lo + g.i * width', 'bin_hi')}, coalesce(n, 0) AS n
        FROM range(1, 51) g(i) CROSS JOIN w LEFT JOIN h ON h.bin = g.i"""
    s["demand_kde"] = f"""{BASE}, st AS (SELECT min(demand) AS lo, max(demand) AS hi,
          count(demand) AS n, stddev_samp(demand) AS sd FROM an),
        p AS (SELECT lo, hi, n, sd * pow(n, -1.0 / 5.0) AS h, (hi - lo) / 4096 AS width,
          (hi - lo) / 99 AS step FROM st),
        c AS (SELECT CAST(least(floor((demand - lo) / width), 4095) AS INTEGER) AS b, count(*) AS cnt
              FROM an CROSS JOIN p WHERE demand IS NOT NULL GROUP BY 1),
        g AS (SELECT i FROM range(0, 100) t(i))
        SELECT CAST(g.i AS INTEGER) AS i, {r('lo + g.i * step', 'x', 6)},
          {rd('sum(cnt * exp(-0.5 * pow((lo + g.i * step - (lo + (b + 0.5) * width)) / h, 2))) * (1.0 / (n * h * sqrt(2 * pi())))', 6)} AS density
        FROM c CROSS JOIN g CROSS JOIN p GROUP BY g.i, lo, step, n, h"""
    s["temp_trend"] = (f"{BASE} SELECT {r('regr_slope(demand, Temperature)', 'slope', 7)}, "
                       f"{r('regr_intercept(demand, Temperature)', 'intercept', 7)} FROM an")
    s["temp_trend_line"] = f"""{BASE}, t AS (SELECT regr_slope(demand, Temperature) AS slope,
          regr_intercept(demand, Temperature) AS intercept,
          min(CASE WHEN demand IS NOT NULL THEN Temperature END) AS x_min,
          max(CASE WHEN demand IS NOT NULL THEN Temperature END) AS x_max FROM an)
        SELECT CAST(i AS INTEGER) AS i, {r('x_min + i * ((x_max - x_min) / 99)', 'x', 7)},
          {r('slope * (x_min + i * ((x_max - x_min) / 99)) + intercept', 'y', 7)}
        FROM t CROSS JOIN range(0, 100) g(i)"""
    s["sample_rows"] = (f"{BASE} SELECT row_id, {r('Temperature', 'Temperature')}, "
                        f"{r('demand', 'demand')} FROM ct "
                        f"ORDER BY {_MIX}, row_id LIMIT 1000")
    s["kfold_assign"] = (f"{BASE} SELECT row_id, {_BLOCK} AS fold FROM (SELECT row_id, row_number() OVER (ORDER BY {_MIX}, row_id) - 1 AS __i, "
                         f"count(*) OVER () AS __n FROM lc WHERE day <= 24) s")
    s["oof_target_encode"] = (f"{BASE}, {_oof()} SELECT row_id, fold, split, "
                              f"{r('geo_mean_demand', 'geo_mean_demand')}, "
                              f"{r('geo_std_demand', 'geo_std_demand')}, "
                              f"{r('geo_median_demand', 'geo_median_demand')}, "
                              f"{r('geo_freq', 'geo_freq')}, geo_rank FROM fenc")
    s["blend"] = _blend_sql()
    s["submission_roundtrip"] = f"{BASE} SELECT row_id AS Index, {r('geo_mean_demand', 'demand')} FROM ({_encode('cs')}) e"
    s["encoder_roundtrip"] = s["stream_encode"] = s["target_encode"]
    s["category_maps_roundtrip"] = s["category_codes_apply"]
    members = "fenc JOIN lc USING (row_id)"
    s["oof_assembly"] = (f"{BASE}, {_oof()} SELECT row_id AS Index, {r('demand', 'demand_true')}, fold, {r('geo_mean_demand', 'pred_cat')}, "
                         f"{r('geo_median_demand', 'pred_lgb')}, {r('0.6 * geo_mean_demand + 0.4 * geo_median_demand', 'pred_ensemble_blend')} "
                         f"FROM {members} WHERE split = 'val'")
    s["holdout_average"] = (f"{BASE}, {_oof()} SELECT row_id, {r('avg(geo_mean_demand)', 'pred_cat')}, {r('avg(geo_median_demand)', 'pred_lgb')} "
                            f"FROM fenc WHERE split = 'holdout' GROUP BY row_id")
    mid = "(0.5 * geo_mean_demand + 0.5 * geo_median_demand)"
    trio = f"0.5 * geo_mean_demand + 0.3 * geo_median_demand + 0.2 * {mid}"
    s["trio_submission_roundtrip"] = f"{BASE} SELECT row_id AS Index, {r(trio, 'demand')} FROM ({_encode('cs')}) e"
    s["oof_roundtrip"] = (f"{BASE}, {_oof()} SELECT row_id AS Index, {r('demand', 'demand_true')}, {r('geo_mean_demand', 'pred_cat')}, "
                          f"{r('geo_median_demand', 'pred_lgb')}, {r(mid, 'pred_xgb')}, "
                          f"{r('0.6 * geo_mean_demand + 0.4 * geo_median_demand', 'pred_ensemble_blend')}, {r(trio, 'pred_ensemble_trio')} "
                          f"FROM {members} WHERE split = 'val'")
    s["prediction_vectors"] = f"""{BASE}, {_oof()}, v AS (
          SELECT row_id, 'oof' AS split, fold, geo_mean_demand AS c, geo_median_demand AS l FROM fenc WHERE split = 'val'
          UNION ALL SELECT row_id, 'holdout', NULL, avg(geo_mean_demand), avg(geo_median_demand) FROM fenc WHERE split = 'holdout' GROUP BY row_id)
        SELECT row_id, split, CAST(fold AS INTEGER) AS fold, 'cat' AS model, {r('c', 'prediction')} FROM v
        UNION ALL SELECT row_id, split, CAST(fold AS INTEGER), 'lgb', {rd('l')} FROM v"""
    s["scenario_parameters"] = f"""{BASE}, o(scenario, lanes, weather, temperature) AS (VALUES
          ('lanes_1', 1, NULL, NULL), ('snow', NULL, 'Snowy', NULL), ('heat', NULL, NULL, 40.0)),
        x AS (SELECT row_id, RoadType, scenario, coalesce(o.lanes, NumberofLanes) AS lanes, coalesce(o.weather, cs.Weather) AS Weather,
                coalesce(o.temperature, cs.Temperature) AS Temperature FROM cs CROSS JOIN o)
        SELECT row_id, scenario, CAST(lanes AS INTEGER) AS NumberofLanes, Weather, {r('Temperature', 'Temperature')},
          {_sev('Weather')} AS weather_severity, {r('Temperature * ' + _sev('Weather'), 'temp_weather_interaction')},
          RoadType || '_' || CAST(CAST(lanes AS INTEGER) AS VARCHAR) AS road_lane_interaction FROM x"""
    s["optional_scan"] = """SELECT 'events' AS name, true AS present, count(*) AS n_rows FROM events
        UNION ALL SELECT 'documents', true, count(*) FROM documents UNION ALL SELECT 'absent_table', false, 0"""
    s["fold_metrics_baseline"] = f"""{BASE}, {_oof()}, v AS (SELECT * FROM {members} WHERE split = 'val'),
        l AS (SELECT fold, demand, 'zone_mean' AS model, geo_mean_demand AS prediction FROM v
              UNION ALL SELECT fold, demand, 'zone_median', geo_median_demand FROM v)
        SELECT fold, model, {r('1 - sum(pow(demand - prediction, 2)) / (var_pop(demand) * count(*))', 'r2')},
          {r('sqrt(sum(pow(demand - prediction, 2)) / count(*))', 'rmse')}, {r('avg(abs(demand - prediction))', 'mae')}, count(*) AS n
        FROM l WHERE demand IS NOT NULL AND prediction IS NOT NULL GROUP BY fold, model"""
    s["dedup_report"] = f"""WITH obs AS ({adapter_sql()}), d AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE row_id % 29 = 0)
        SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS kept,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dropped FROM d"""
    s["regression_metrics"] = f"""{BASE}, e AS ({_encode('an')}),
        l AS (SELECT CASE WHEN day <= 24 THEN 'train' ELSE 'holdout' END AS split, demand,
                'zone_mean' AS model, geo_mean_demand AS prediction FROM e
              UNION ALL SELECT CASE WHEN day <= 24 THEN 'train' ELSE 'holdout' END, demand,
                'zone_median', geo_median_demand FROM e)
        SELECT split, model,
          {r('1 - sum(pow(demand - prediction, 2)) / (var_pop(demand) * count(*))', 'r2')},
          {r('sqrt(sum(pow(demand - prediction, 2)) / count(*))', 'rmse')},
          {r('avg(abs(demand - prediction))', 'mae')}, count(*) AS n
        FROM l WHERE demand IS NOT NULL AND prediction IS NOT NULL GROUP BY split, model"""
    s["validate_submission"] = f"""{BASE}, sub AS (SELECT row_id AS Index, geo_mean_demand AS demand
          FROM ({_encode('cs')}) e),
        st AS (SELECT count(*) AS rows, count(*) - count(demand) AS missing, min(demand) AS mn,
          max(demand) AS mx, avg(demand) AS mean FROM sub),
        ex AS (SELECT count(*) AS n FROM obs WHERE NOT is_train)
        SELECT 'rows' AS "check", {rd('CAST(rows AS DOUBLE)')} AS value,
          CASE WHEN rows = (SELECT n FROM ex) THEN 'PASS' ELSE 'FAIL' END AS status FROM st
        UNION ALL SELECT 'columns', 2.0, 'PASS'
        UNION ALL SELECT 'missing', CAST(missing AS DOUBLE),
          CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END FROM st
        UNION ALL SELECT 'min', {rd('mn')}, 'INFO' FROM st
        UNION ALL SELECT 'max', {rd('mx')}, 'INFO' FROM st
        UNION ALL SELECT 'mean', {rd('mean')}, 'INFO' FROM st"""
    s["scenario_event"] = f"""{BASE}, z AS (SELECT geohash, avg(demand) AS baseline FROM an
          WHERE geohash IS NOT NULL GROUP BY geohash),
        ev AS (SELECT * FROM ({_events()}) v(event_type, attendance_k, mult)),
        j AS (SELECT z.geohash, ev.event_type, ev.attendance_k, z.baseline,
          1.0 + (ev.mult - 1.0) * (ev.attendance_k / 100.0) AS multiplier FROM z CROSS JOIN ev)
        SELECT geohash, event_type, attendance_k, {r('baseline', 'baseline')},
          {r('multiplier', 'multiplier')}, {r('baseline * multiplier', 'surge')},
          {r('CASE WHEN baseline <> 0 THEN (baseline * multiplier - baseline) / baseline * 100.0 END',
             'delta_pct')} FROM j"""
    s["scenario_incident"] = f"""{BASE}, zm AS ({zone_map}),
        z AS (SELECT geohash, lanes AS NumberofLanes FROM zm WHERE lat IS NOT NULL AND lanes IS NOT NULL),
        g AS (SELECT * FROM (VALUES ('accident'), ('construction'), ('flood')) a(incident)
              CROSS JOIN range(1, 6) s(severity))
        SELECT geohash, incident, CAST(severity AS INTEGER) AS severity, NumberofLanes,
          CAST(CASE WHEN incident = 'accident' THEN greatest(1, NumberofLanes - CAST(floor(severity / 2) AS INTEGER))
               WHEN incident = 'construction' THEN greatest(1, NumberofLanes - severity)
               ELSE NumberofLanes END AS INTEGER) AS sim_lanes,
          CASE WHEN incident = 'flood' THEN CASE WHEN severity > 3 THEN 'Rainy' ELSE 'Cloudy' END
               ELSE 'Cloudy' END AS sim_weather,
          {r('1.0 + CAST(severity AS DOUBLE) * 0.15', 'surge_factor')}
        FROM z CROSS JOIN g"""
    s["scenario_delta"] = f"""{BASE}, z AS (SELECT geohash,
          avg(CASE WHEN is_peak_hour = 0 THEN demand END) AS base,
          avg(CASE WHEN is_peak_hour = 1 THEN demand END) AS sim FROM an
          WHERE geohash IS NOT NULL GROUP BY geohash)
        SELECT geohash, {r('base', 'base')}, {r('sim', 'sim')},
          {r('CASE WHEN base <> 0 THEN (sim - base) / base * 100.0 END', 'delta_pct')},
          CASE WHEN base = 0 OR base IS NULL OR sim IS NULL THEN NULL
               WHEN (sim - base) / base * 100.0 > 15 THEN 'HIGH CONGESTION RISK'
               WHEN (sim - base) / base * 100.0 < -5 THEN 'CONGESTION ALLEVIATED'
               ELSE 'STABLE CONDITIONS' END AS status FROM z"""
    return s
