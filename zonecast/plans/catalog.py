"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each runs over the whole adapter view of the driver's ``events`` table.  Double
columns are rounded to 9 digits at the very end (comparison only).  The
matching DuckDB texts live in ``zonecast.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast import sources
from zonecast.functions.attributes import with_interactions, with_road_features, with_weather_features
from zonecast.functions.geo import geohash_latlon, with_geo_prefixes
from zonecast.functions.labels import delta_status, demand_class, pct_delta, risk_pct
from zonecast.functions.temporal import leading_hour, with_time_features
from zonecast.operators import analytics as A
from zonecast.operators import cleaning
from zonecast.operators.blend import blend
from zonecast.operators.categories import apply_codes, category_table
from zonecast.operators.encoding import (ZoneEncoding, apply_encoding, global_stats, no_stats_encoding,
                                         prefix_stats, unseen_zones, zone_rank, zone_stats)
from zonecast.operators.folds import assign_folds
from zonecast.operators.joins import maybe_broadcast
from zonecast.operators.metrics import regression_metrics
from zonecast.operators.oof import oof_encode
from zonecast.operators.scenarios import (OVERRIDES, apply_overrides, event_surge, explode_scenarios, incident_grid,
                                          incident_parameters)
from zonecast.operators.validation import validate_submission
from zonecast.operators.features import categorical_frame, engineer
from zonecast.plans.context import context, rounded
from zonecast.session import cut_lineage, scratch_dir
from zonecast.sources import sinks
from zonecast.sources.readers import read_submission
from zonecast.streaming.scoring import observation_stream, require_all_rows
from zonecast.schema import BLEND_PAIR, BLEND_TRIO, CATEGORICAL_FEATURES, CORR_COLUMNS, CORR_FEATURES

Query = Callable[[SparkSession, str], DataFrame]

# Day split of the fixture: days 1-24 train / validate, later days are holdout.
TRAIN_DAY_MAX = 24
FOLDS = 5
SEED = 42
EVENTS = [{"event_type": t, "attendance_k": k}
          for t in ["Music Concert", "Sports Game", "City Festival", "Conference"]
          for k in (20, 50, 100)]


# --- scans and cleaning ------------------------------------------------------

def q_scan_observations(spark, sf):
    return rounded(sources.observations(spark, sf))


def q_dedup(spark, sf):
    return rounded(cleaning.dedup(sources.obs_dup(spark, sf)))


def q_train_medians(spark, sf):
    return rounded(context(spark, sf).medians.to_df(spark))


def q_coerce_numeric(spark, sf):
    obs = sources.observations(spark, sf)
    return obs.select("row_id", "lanes_text",
                      cleaning.coerce_numeric("lanes_text").alias("lanes_value"))


def q_impute(spark, sf):
    ctx = context(spark, sf)
    return rounded(cleaning.impute(cleaning.dedup(ctx.train_raw), ctx.medians))


def q_standardize(spark, sf):
    return rounded(cleaning.standardize(sources.observations(spark, sf)))


def q_clean_train(spark, sf):
    return rounded(context(spark, sf).train_clean)


def q_impute_score(spark, sf):
    return rounded(context(spark, sf).score_clean)


def q_impute_score_local(spark, sf):
    """C7 without fitted medians: local Temperature median, 1 lane."""
    return rounded(cleaning.clean(sources.obs_score(spark, sf), None))


def q_null_audit(spark, sf):
    return cleaning.missing_counts(sources.observations(spark, sf))


def q_null_audit_total(spark, sf):
    return cleaning.total_missing(context(spark, sf).train_clean)


def q_split_by_day(spark, sf):
    ctx = context(spark, sf)
    tr, ho = cleaning.split_by_day(ctx.labelled_clean, lambda d: d <= TRAIN_DAY_MAX,
                                   lambda d: d > TRAIN_DAY_MAX)
    return (tr.select("row_id", "day", F.lit("train").alias("split"))
            .unionByName(ho.select("row_id", "day", F.lit("holdout").alias("split"))))


def q_align_schema(spark, sf):
    cols = ["row_id", "Temperature", "NumberofLanes", "demand", "absent_feature"]
    return rounded(cleaning.align_schema(context(spark, sf).score_clean, cols))


def q_preview(spark, sf):
    """Head-10 preview in row order."""
    return rounded(context(spark, sf).train_clean.orderBy("row_id").limit(10))


def q_shape_report(spark, sf):
    """V5: rows and columns of the cleaned training table."""
    from zonecast.operators.validation import shape_report
    return shape_report(context(spark, sf).train_clean)


# --- row-wise features ---------------------------------------------------------

def q_time_features(spark, sf):
    df = with_time_features(cleaning.standardize(sources.observations(spark, sf))).withColumn("leading_hour", leading_hour(F.col("timestamp")))
    return rounded(df.select("row_id", "hour", "minute", "leading_hour", "total_minutes", "hour_sin",
                             "hour_cos", "is_peak_hour", "day_of_week", "is_weekend",
                             "time_block"))


def q_geohash_decode(spark, sf):
    zones = cleaning.standardize(sources.observations(spark, sf)).select("geohash").distinct()
    lat, lon = geohash_latlon(F.col("geohash"))
    return rounded(zones.select("geohash", lat.alias("latitude"), lon.alias("longitude")))


def q_geo_prefix(spark, sf):
    df = with_geo_prefixes(cleaning.standardize(sources.observations(spark, sf)))
    return df.select("row_id", "geo_prefix_5", "geo_prefix_4", "geo_prefix_3")


def q_road_features(spark, sf):
    df = with_road_features(context(spark, sf).train_clean)
    return rounded(df.select("row_id", "lane_capacity", "heavy_vehicle_score",
                             "road_lane_interaction"))


def q_weather_features(spark, sf):
    df = with_weather_features(context(spark, sf).train_clean)
    return rounded(df.select("row_id", "weather_severity", "temp_weather_interaction"))


def q_interactions(spark, sf):
    df = context(spark, sf).train_rows
    df = with_interactions(with_weather_features(with_road_features(df)))
    return rounded(df.select("row_id", "temp_hour", "lane_temp", "weather_hour", "road_weather",
                             "road_hour", "lane_vehicle", "geo_hour", "peak_weather"))


def q_features_nostats(spark, sf):
    df = with_road_features(no_stats_encoding(context(spark, sf).train_clean))
    df = df.withColumn("congestion_capacity_ratio",
                       F.col("geo_mean_demand") / F.greatest(F.col("lane_capacity"), F.lit(1.0)))
    return rounded(df.select("row_id", "geo_mean_demand", "geo_std_demand", "geo_median_demand",
                             "geo_freq", "geo_rank", "geo_density", "congestion_capacity_ratio"))


def q_demand_category(spark, sf):
    df = context(spark, sf).train_clean
    return rounded(df.select("row_id", "demand", demand_class(F.col("demand")).alias("category"),
                             risk_pct(F.col("demand")).alias("risk_pct")))


# --- fitted statistics and target encoding -----------------------------------------

def q_zone_stats(spark, sf):
    z = context(spark, sf).encoding.zones
    return rounded(z.select("geohash", "geo_mean_demand", "geo_std_demand",
                            "geo_median_demand", "geo_freq", "geo_rank"))


def q_zone_stats_direct(spark, sf):
    """A1 straight from the rows (no fitted-encoder reuse)."""
    return rounded(zone_stats(context(spark, sf).train_clean).drop("sum_demand"))


def q_prefix_stats(spark, sf):
    return rounded(prefix_stats(context(spark, sf).train_clean))


def q_global_stats(spark, sf):
    return rounded(global_stats(context(spark, sf).train_clean))


def q_zone_rank(spark, sf):
    z = zone_stats(context(spark, sf).train_clean)
    return zone_rank(z).select("geohash", "geo_rank")


_ENC_COLS = ["row_id", "geohash", "geo_mean_demand", "geo_std_demand", "geo_median_demand",
             "geo_freq", "geo_rank", "geo_density", "congestion_capacity_ratio"]


def q_target_encode(spark, sf):
    return rounded(context(spark, sf).score_features.select(*_ENC_COLS))


def q_target_encode_batch(spark, sf):
    ctx = context(spark, sf)
    df = with_road_features(apply_encoding(ctx.score_clean, ctx.encoding, "batch"))
    df = df.withColumn("congestion_capacity_ratio",
                       F.col("geo_mean_demand") / F.greatest(F.col("lane_capacity"), F.lit(1.0)))
    return rounded(df.select(*_ENC_COLS))


def q_fallback_levels(spark, sf):
    ctx = context(spark, sf)
    enc = ctx.encoding
    df = with_geo_prefixes(ctx.score_clean).select("geohash", "geo_prefix_5", "geo_prefix_4",
                                                   "geo_prefix_3")
    z = enc.zones.where(F.col("geo_mean_demand").isNotNull()).select(
        "geohash", F.lit(1).alias("__z"))
    df = df.join(maybe_broadcast(z, enc.n_zones), "geohash", "left")
    for n in (5, 4, 3):
        p = enc.prefixes.where(F.col("level") == n).select(
            F.col("prefix").alias(f"geo_prefix_{n}"), F.lit(1).alias(f"__p{n}"))
        df = df.join(maybe_broadcast(p, enc.n_prefixes), f"geo_prefix_{n}", "left")
    level = (F.when(F.col("__z").isNotNull(), "exact").when(F.col("__p5").isNotNull(), "p5")
             .when(F.col("__p4").isNotNull(), "p4").when(F.col("__p3").isNotNull(), "p3")
             .otherwise("global"))
    return df.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def q_unseen_zones(spark, sf):
    ctx = context(spark, sf)
    return unseen_zones(ctx.score_clean, ctx.encoding.zones).select("row_id", "geohash")


def q_category_codes(spark, sf):
    return category_table(categorical_frame(context(spark, sf).train_clean), CATEGORICAL_FEATURES)


def q_category_codes_apply(spark, sf):
    """Codes fitted on training rows applied to scoring rows (unseen -> -1);
    the code table is materialised once and broadcast after one size check."""
    ctx = context(spark, sf)
    table = cut_lineage(category_table(categorical_frame(ctx.train_clean), CATEGORICAL_FEATURES))
    n = table.count()
    rows = categorical_frame(ctx.score_clean).select("row_id", *CATEGORICAL_FEATURES)
    return apply_codes(rows, table, CATEGORICAL_FEATURES, n_rows=n)


# --- analytics --------------------------------------------------------------------

def _tie_safe(c: str):
    """Means compared at 12 decimals: equal means tie regardless of float noise."""
    return F.col(c).cast("decimal(38,12)")


def _an(spark, sf) -> DataFrame:
    return context(spark, sf).train_rows


def q_hourly_demand(spark, sf):
    return rounded(A.mean_by(_an(spark, sf), "hour"))


def q_weather_mean(spark, sf):
    return rounded(A.mean_by(_an(spark, sf), "Weather", ascending=True))


def q_weather_summary(spark, sf):
    return rounded(A.summary_by(_an(spark, sf), "Weather"))


def q_road_mean(spark, sf):
    return rounded(A.mean_by(_an(spark, sf), "RoadType", ascending=False))


def q_peak_contrast(spark, sf):
    return rounded(A.peak_contrast(_an(spark, sf)))


def q_lane_mean(spark, sf):
    return rounded(A.mean_by(_an(spark, sf), "NumberofLanes"))


def q_vehicle_landmark_mean(spark, sf):
    return rounded(A.means_by_each(_an(spark, sf), ["LargeVehicles", "Landmarks"]))


def q_zone_map(spark, sf):
    return rounded(A.zone_map(_an(spark, sf)))


def q_heatmap_road_hour(spark, sf):
    return rounded(A.pivot_mean(_an(spark, sf), "RoadType", "hour", list(range(24)), "h"))


def q_heatmap_road_lanes(spark, sf):
    df = _an(spark, sf)
    lanes = A.distinct_values(df, "NumberofLanes")
    return rounded(A.pivot_mean(df, "RoadType", "NumberofLanes", lanes, "lanes_"))


def q_zone_kpis(spark, sf):
    return rounded(A.zone_kpis(A.zone_map(_an(spark, sf))))


def q_executive_summary(spark, sf):
    """A15 KPIs as rows (kpi, key, value): arg-max / arg-min of group means."""
    df = _an(spark, sf)
    return rounded(A.best_of_each(df, [
        ("peak_hour", "hour", True), ("worst_zone", "geohash", True), ("worst_weather", "Weather", True),
        ("best_weather", "Weather", False), ("worst_road", "RoadType", True)]))


def q_top_hotspots(spark, sf):
    z = A.zone_map(_an(spark, sf))
    t = (z.orderBy(_tie_safe("mean_demand").desc(), F.col("geohash")).limit(10))
    return rounded(t.select("geohash", "mean_demand", "lanes", "lat", "lon"))


def q_top_zones_5(spark, sf):
    df = _an(spark, sf)
    m = A.mean_by(df, "geohash")
    return rounded(m.orderBy(_tie_safe("mean_demand").desc(), F.col("geohash")).limit(5))


def q_top_hours(spark, sf):
    m = A.mean_by(_an(spark, sf), "hour")
    return rounded(m.orderBy(_tie_safe("mean_demand").desc(), F.col("hour")).limit(2))


def q_demand_profile(spark, sf):
    return rounded(A.describe(_an(spark, sf), "demand"))


def q_correlation(spark, sf):
    return rounded(A.correlation(_an(spark, sf), CORR_COLUMNS), 6)


def q_feature_correlation(spark, sf):
    return rounded(A.correlation(context(spark, sf).train_features, CORR_FEATURES), 6)


def q_weather_box(spark, sf):
    return rounded(A.box_stats(_an(spark, sf), "Weather"))


def q_demand_histogram(spark, sf):
    return rounded(A.histogram(_an(spark, sf), "demand", 50))


def q_demand_kde(spark, sf):
    return rounded(A.kde(_an(spark, sf), "demand", 100, 4096), 6)


def q_temp_trend(spark, sf):
    return rounded(A.linear_trend(_an(spark, sf)).select("slope", "intercept"), 7)


def q_temp_trend_line(spark, sf):
    return rounded(A.trend_line(A.linear_trend(_an(spark, sf)), 100), 7)


def q_sample_rows(spark, sf):
    return rounded(A.hash_sample(_an(spark, sf), 1000, SEED).select("row_id", "Temperature",
                                                                   "demand"))


# --- folds, out-of-fold encoding, metrics, blends ------------------------------------

def _cv_rows(spark, sf):
    return context(spark, sf).labelled_clean.where(F.col("day") <= TRAIN_DAY_MAX)


def _holdout_rows(spark, sf):
    return context(spark, sf).labelled_clean.where(F.col("day") > TRAIN_DAY_MAX)


def q_kfold_assign(spark, sf):
    return assign_folds(_cv_rows(spark, sf), FOLDS, SEED).select("row_id", "fold")


def q_oof_target_encode(spark, sf):
    val, hold = oof_encode(assign_folds(_cv_rows(spark, sf), FOLDS, SEED),
                           _holdout_rows(spark, sf), FOLDS)
    cols = ["row_id", "fold", "geo_mean_demand", "geo_std_demand", "geo_median_demand",
            "geo_freq", "geo_rank"]
    return rounded(val.select(*cols, F.lit("val").alias("split"))
                   .unionByName(hold.select(*cols, F.lit("holdout").alias("split"))))


def _baseline_predictions(spark, sf) -> DataFrame:
    """Deterministic member predictions from the fitted encoder: zone mean,
    zone median and prefix-level means, over training features."""
    f = context(spark, sf).train_features
    return f.select("row_id", "day", "demand",
                    F.col("geo_mean_demand").alias("pred_mean"),
                    F.col("geo_median_demand").alias("pred_median"),
                    (F.col("geo_mean_demand") * 0.5 + F.col("geo_median_demand") * 0.5)
                    .alias("pred_mid"))


def q_blend(spark, sf):
    p = _baseline_predictions(spark, sf)
    m = {"cat": F.col("pred_mean"), "lgb": F.col("pred_median"), "xgb": F.col("pred_mid")}
    return rounded(p.select(
        "row_id",
        blend({"cat": m["cat"], "lgb": m["lgb"]}, {"cat": 0.6, "lgb": 0.4}).alias("blend_pair"),
        blend(m, {"cat": 0.5, "lgb": 0.3, "xgb": 0.2}).alias("blend_trio"),
        blend(m).alias("blend_uniform"),
        blend(m, {"cat": 1.0, "lgb": 1.0}).alias("blend_normalized"),
        blend(m, None, (0.05, 0.15)).alias("blend_clipped")))


def q_regression_metrics(spark, sf):
    p = _baseline_predictions(spark, sf)
    long = p.select("day", "demand", F.explode(F.array(
        F.struct(F.lit("zone_mean").alias("model"), F.col("pred_mean").alias("prediction")),
        F.struct(F.lit("zone_median").alias("model"), F.col("pred_median").alias("prediction"))))
        .alias("m")).select(
        F.when(F.col("day") <= TRAIN_DAY_MAX, "train").otherwise("holdout").alias("split"),
        "demand", F.col("m.model").alias("model"), F.col("m.prediction").alias("prediction"))
    return rounded(regression_metrics(long, keys=["split", "model"]))


def q_validate_submission(spark, sf):
    ctx = context(spark, sf)
    sub = ctx.score_features.select(F.col("row_id").alias("Index"),
                                    F.col("geo_mean_demand").alias("demand"))
    expected = ctx.score_raw.count()
    return rounded(validate_submission(sub, expected))


# --- persistence, assembly and streams with deterministic members ------------------------
# The zone mean and median stand in for fitted members, so every step around the models has an oracle.

def _scratch(spark, name: str) -> str:
    return scratch_dir(spark, name)


def q_submission_roundtrip(spark, sf):
    """K1 then S4: a submission of zone means written as CSV and read back typed."""
    path = _scratch(spark, "submission-roundtrip")
    sinks.write_submission(context(spark, sf).score_features, path, "geo_mean_demand")
    return rounded(read_submission(spark, path))


def q_encoder_roundtrip(spark, sf):
    """K4 then S5: medians and encoder saved, loaded and applied to the scoring rows."""
    ctx = context(spark, sf)
    path = _scratch(spark, "encoder-roundtrip")
    ctx.medians.save(spark, f"{path}/medians")
    ctx.encoding.save(f"{path}/encoding")
    enc = ZoneEncoding.load(spark, f"{path}/encoding")
    clean = cleaning.clean(ctx.score_raw, cleaning.Medians.load(spark, f"{path}/medians"))
    return rounded(engineer(clean, enc)[0].select(*_ENC_COLS))


def q_category_maps_roundtrip(spark, sf):
    """K4 then S5 and J7: category maps saved, loaded and applied to the scoring rows."""
    ctx = context(spark, sf)
    path = _scratch(spark, "category-maps")
    sinks.write_table(category_table(categorical_frame(ctx.train_clean), CATEGORICAL_FEATURES), path)
    rows = categorical_frame(ctx.score_clean).select("row_id", *CATEGORICAL_FEATURES)
    return apply_codes(rows, spark.read.parquet(path), CATEGORICAL_FEATURES)


def _fold_members(spark, sf):
    return oof_encode(assign_folds(_cv_rows(spark, sf), FOLDS, SEED), _holdout_rows(spark, sf), FOLDS)


def q_oof_assembly(spark, sf):
    """One row per validation row with its fold's members and their blend."""
    val, _ = _fold_members(spark, sf)
    m = {"cat": F.col("geo_mean_demand"), "lgb": F.col("geo_median_demand")}
    return rounded(val.select(F.col("row_id").alias("Index"), F.col("demand").alias("demand_true"), "fold",
                              m["cat"].alias("pred_cat"), m["lgb"].alias("pred_lgb"),
                              blend(m, {"cat": 0.6, "lgb": 0.4}).alias("pred_ensemble_blend")))


def q_holdout_average(spark, sf):
    """Holdout predictions averaged over the folds."""
    _, hold = _fold_members(spark, sf)
    return rounded(hold.groupBy("row_id").agg(F.avg("geo_mean_demand").alias("pred_cat"), F.avg("geo_median_demand").alias("pred_lgb")))


def q_fold_metrics_baseline(spark, sf):
    """A23 per fold: metrics of the fold means and medians on their validation rows."""
    val, _ = _fold_members(spark, sf)
    long = val.select("fold", "demand", F.explode(F.array(
        F.struct(F.lit("zone_mean").alias("model"), F.col("geo_mean_demand").alias("prediction")),
        F.struct(F.lit("zone_median").alias("model"), F.col("geo_median_demand").alias("prediction")))).alias("m"))
    return rounded(regression_metrics(long.select("fold", "demand", "m.model", "m.prediction"), keys=["fold", "model"]))


def _three(mean, median) -> dict:
    """Zone mean, median and their middle in place of the three members."""
    return {"cat": mean, "lgb": median, "xgb": mean * 0.5 + median * 0.5}


def q_trio_submission_roundtrip(spark, sf):
    """K2 then S4: the blend of three members written as the second submission and read back typed."""
    path = _scratch(spark, "trio-roundtrip")
    f = context(spark, sf).score_features
    trio = blend(_three(F.col("geo_mean_demand"), F.col("geo_median_demand")), BLEND_TRIO)
    sinks.write_submission(f.withColumn("trio", trio), path, "trio")
    return rounded(read_submission(spark, path))


def q_oof_roundtrip(spark, sf):
    """K3 then S4: the out-of-fold table in its seven columns written as CSV and read back typed."""
    path = _scratch(spark, "oof-roundtrip")
    val, _ = _fold_members(spark, sf)
    m = _three(F.col("geo_mean_demand"), F.col("geo_median_demand"))
    sinks.write_oof(val.select(F.col("row_id").alias("Index"), F.col("demand").alias("demand_true"), *[c.alias(f"pred_{k}") for k, c in m.items()],
                               blend({k: m[k] for k in BLEND_PAIR}, BLEND_PAIR).alias("pred_ensemble_blend"),
                               blend(m, BLEND_TRIO).alias("pred_ensemble_trio")), path)
    return rounded(read_submission(spark, path))


def q_prediction_vectors(spark, sf):
    """K6: out-of-fold and holdout predictions of the members, one row a model, written by split and read back."""
    path = _scratch(spark, "prediction-vectors")
    val, hold = _fold_members(spark, sf)
    m = {"cat": F.col("geo_mean_demand"), "lgb": F.col("geo_median_demand")}
    mean = hold.groupBy("row_id").agg(*[F.avg(c).alias(f"m_{k}") for k, c in m.items()])
    models = lambda cols: F.explode(F.array(*[F.struct(F.lit(k).alias("model"), c.alias("prediction")) for k, c in cols.items()])).alias("p")
    both = (val.select("row_id", F.lit("oof").alias("split"), "fold", models(m))
            .unionByName(mean.select("row_id", F.lit("holdout").alias("split"), F.lit(None).cast("int").alias("fold"), models({k: F.col(f"m_{k}") for k in m}))))
    rows = both.select("row_id", "fold", "p.model", "p.prediction", "split")
    sinks.write_table(rows, path, ["split"])
    return rounded(spark.read.schema(rows.schema).parquet(path))


def q_scenario_parameters(spark, sf):
    """Every scoring row under every override, with the features that follow from them."""
    rows = apply_overrides(explode_scenarios(context(spark, sf).score_clean, OVERRIDES))
    feats = with_weather_features(with_road_features(rows))
    return rounded(feats.select("row_id", "scenario", F.col("NumberofLanes").cast("int").alias("NumberofLanes"), "Weather", "Temperature",
                                "weather_severity", "temp_weather_interaction", "road_lane_interaction"))


def q_optional_scan(spark, sf):
    """Rows of the tables that are there; one that is not has none and is no error."""
    out = None
    for name in ("events", "documents", "absent_table"):
        found = sources.read_optional(spark, f"{sf.rstrip('/')}/{name}.parquet")
        rows = spark.createDataFrame([], "nothing int") if found is None else found
        one = rows.agg(F.lit(name).alias("name"), F.lit(found is not None).alias("present"), F.count("*").alias("n_rows"))
        out = one if out is None else out.union(one)
    return out


def q_stream_encode(spark, sf):
    """The scoring rows as a stream, cleaned and encoded with the fitted tables, read back from the sink."""
    ctx = context(spark, sf)
    rows = observation_stream(spark, sf).where(~F.col("is_train")).drop("is_train")
    feats = engineer(cleaning.clean(rows, ctx.medians), ctx.encoding)[0].select(*_ENC_COLS)
    path = _scratch(spark, "stream-encode")
    query = (feats.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    fresh = sources.observations(spark, sf).where(~F.col("is_train")).select("is_train")
    return rounded(require_all_rows(fresh, spark.read.schema(feats.schema).parquet(f"{path}/data")))


def q_dedup_report(spark, sf):
    """C1's row counts on the fixture with planted copies."""
    obs = sources.observations(spark, sf)
    return cleaning.dedup_report(obs.unionByName(obs.where(F.col("row_id") % 29 == 0)))


# --- scenarios ------------------------------------------------------------------------

def q_scenario_event(spark, sf):
    zones = A.mean_by(_an(spark, sf), "geohash", name="baseline")
    return rounded(event_surge(zones, EVENTS).select(
        "geohash", "event_type", "attendance_k", "baseline", "multiplier", "surge", "delta_pct"))


def q_scenario_incident(spark, sf):
    z = A.zone_map(_an(spark, sf)).select("geohash", F.col("lanes").alias("NumberofLanes"),
                                          F.lit("Cloudy").alias("Weather"))
    grid = explode_scenarios(z.where(F.col("NumberofLanes").isNotNull()), incident_grid())
    return rounded(incident_parameters(grid).select(
        "geohash", "incident", "severity", "NumberofLanes", "sim_lanes", "sim_weather",
        "surge_factor"))


def q_scenario_delta(spark, sf):
    """F22 over data: per zone, peak-hour mean vs off-peak mean."""
    df = _an(spark, sf).where(F.col("geohash").isNotNull())
    z = df.groupBy("geohash").agg(
        F.avg(F.when(F.col("is_peak_hour") == 0, F.col("demand"))).alias("base"),
        F.avg(F.when(F.col("is_peak_hour") == 1, F.col("demand"))).alias("sim"))
    d = pct_delta(F.col("sim"), F.col("base"))
    return rounded(z.select("geohash", "base", "sim", d.alias("delta_pct"),
                            delta_status(d).alias("status")))


def queries() -> dict[str, Query]:
    out = {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}
    from zonecast.plans import modelling
    out.update(modelling.queries())
    return out
