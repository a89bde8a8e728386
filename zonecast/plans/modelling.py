"""Registered model queries (rows-only checks): cross-validated members,
out-of-fold table, holdout mean, leaderboard, importance, batch and stream
scoring, what-if scoring.  One experiment per (session, data folder) is run
and shared by these keys."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions.labels import delta_status, demand_class, pct_delta, risk_pct
from zonecast.ml.members import MemberConfig
from zonecast.ml.protocol import CVResult, FittedEnsemble, cross_validate, fit_final, oof_table
from zonecast.operators import cleaning
from zonecast.operators.analytics import zone_map
from zonecast.operators.scenarios import (OVERRIDES, apply_overrides, explode_scenarios, incident_grid,
                                          incident_parameters)
from zonecast.operators.validation import validate_submission
from zonecast.plans.context import context, rounded
from zonecast.schema import BASE_REQUEST
from zonecast.session import materialize, scratch_dir, spread

# The reference's length, as on the command line: 1000 rounds with patience 50 in CV, 1200 final.
CONFIG = MemberConfig(rounds=1000, patience=50)
FINAL_ROUNDS = 1200
TRAIN_DAY_MAX = 24
_EXP: dict = {}


class Experiment:
    def __init__(self, spark: SparkSession, sf: str):
        self.ctx = context(spark, sf)
        self.spark = spark

    @cached_property
    def cv(self) -> CVResult:
        lab = self.ctx.labelled_clean
        return cross_validate(lab.where(F.col("day") <= TRAIN_DAY_MAX),
                              lab.where(F.col("day") > TRAIN_DAY_MAX), CONFIG)

    @cached_property
    def final(self) -> FittedEnsemble:
        return fit_final(self.ctx.train_clean, CONFIG, FINAL_ROUNDS)

    @cached_property
    def scored(self) -> DataFrame:
        """Ids and predictions of the scoring rows, written once for every query that reads them."""
        return materialize(self.final.score(self.ctx.score_dealt, features=False), scratch_dir(self.spark, "scored"))


def experiment(spark, sf) -> Experiment:
    key = (id(spark), sf.rstrip("/"))
    if key not in _EXP:
        _EXP[key] = Experiment(spark, sf)
    return _EXP[key]


def q_cv_metrics(spark, sf):
    return rounded(experiment(spark, sf).cv.metrics)


def q_fold_metrics(spark, sf):
    return rounded(experiment(spark, sf).cv.fold_metrics)


def q_oof_table(spark, sf):
    return rounded(oof_table(experiment(spark, sf).cv))


def q_holdout_mean(spark, sf):
    return rounded(experiment(spark, sf).cv.holdout)


def q_leaderboard(spark, sf):
    m = experiment(spark, sf).cv.metrics
    return rounded(m.orderBy(F.col("split"), F.col("r2").desc(), F.col("model")))


def q_score_ensemble(spark, sf):
    s = experiment(spark, sf).scored
    return rounded(s.select(F.col("row_id").alias("Index"),
                            F.col("pred_ensemble_blend").alias("demand")))


def q_score_trio(spark, sf):
    s = experiment(spark, sf).scored
    return rounded(s.select(F.col("row_id").alias("Index"),
                            F.col("pred_ensemble_trio").alias("demand")))


def q_score_members(spark, sf):
    s = experiment(spark, sf).scored
    b = F.col("pred_ensemble_blend")
    return rounded(s.select("row_id", "pred_cat", "pred_lgb", "pred_xgb", "pred_ensemble_blend",
                            "pred_ensemble_trio", demand_class(b).alias("category"),
                            risk_pct(b).alias("risk_pct")))


def q_submission_profile(spark, sf):
    """A16 on the submission: min, max, mean, exact median, std of predictions."""
    from zonecast.operators.analytics import describe
    s = experiment(spark, sf).scored.select(F.col("pred_ensemble_blend").alias("demand"))
    return rounded(describe(s, "demand"))


def q_validate_model_submission(spark, sf):
    e = experiment(spark, sf)
    sub = e.scored.select(F.col("row_id").alias("Index"), F.col("pred_ensemble_blend").alias("demand"))
    return rounded(validate_submission(sub, e.ctx.score_raw.count()))


def q_feature_importance(spark, sf):
    imp = experiment(spark, sf).final.importance("cat")[:20]
    df = spark.createDataFrame([(n, float(v)) for n, v in imp], "feature string, importance double")
    return rounded(df)


def _with_base_score(e: Experiment, rows: DataFrame) -> DataFrame:
    """``rows`` with their own score as ``base``, carried along so that no join on a repeatable id is needed."""
    packed = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return e.final.score(packed, keep=["__row"], features=False).select("__row.*", F.col("pred_ensemble_blend").alias("base"))


def _scenario_scores(e: Experiment, base: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Score base rows and every (row, scenario) variant; delta vs the base."""
    sims = apply_overrides(explode_scenarios(_with_base_score(e, base), scenarios))
    keys = [k for k in scenarios[0] if k not in ("sim_lanes", "sim_weather", "sim_temperature")]
    sim_pred = e.final.score(sims.drop(*[c for c in ("sim_lanes", "sim_weather",
                                                      "sim_temperature") if c in sims.columns]),
                             keep=[*keys, "base"], features=False)
    out = sim_pred.select("row_id", *keys, F.col("pred_ensemble_blend").alias("sim"), "base")
    d = pct_delta(F.col("sim"), F.col("base"))
    return out.withColumn("delta_pct", d).withColumn("status", delta_status(d))


def q_scenario_override(spark, sf):
    e = experiment(spark, sf)
    return rounded(_scenario_scores(e, e.ctx.score_dealt, OVERRIDES))


def q_scenario_incident_scores(spark, sf):
    """W3 over every zone: a fixed base observation per zone (reference form
    values), each incident x severity re-scored, times the surge factor."""
    e = experiment(spark, sf)
    zones = zone_map(e.ctx.train_rows).select("geohash")
    base = zones.select(
        F.xxhash64("geohash").alias("row_id"), "geohash", *[F.lit(v).alias(c) for c, v in BASE_REQUEST.items()],
        F.lit(None).cast("double").alias("demand"))
    grid = incident_parameters(explode_scenarios(_with_base_score(e, spread(base)), incident_grid()))
    sims = grid.withColumns({"NumberofLanes": F.col("sim_lanes"), "Weather": F.col("sim_weather")})
    sim = e.final.score(sims.drop("sim_lanes", "sim_weather"),
                        keep=["geohash", "incident", "severity", "surge_factor", "base"], features=False)
    out = sim.select("row_id", "geohash", "incident", "severity",
                     (F.col("pred_ensemble_blend") * F.col("surge_factor")).alias("sim"), "base")
    d = pct_delta(F.col("sim"), F.col("base"))
    return rounded(out.withColumn("delta_pct", d).withColumn("status", delta_status(d)))


def q_model_roundtrip(spark, sf):
    """K4/K5 then S5/S6: save medians, encoder and members, load them back and
    score the scoring rows with the loaded artefacts."""
    e = experiment(spark, sf)
    path = scratch_dir(spark, "models")
    e.ctx.medians.save(spark, f"{path}/train_medians")
    e.final.save(f"{path}/models")
    med = cleaning.Medians.load(spark, f"{path}/train_medians")
    loaded = FittedEnsemble.load(spark, f"{path}/models")
    s = loaded.score(cleaning.clean(spread(e.ctx.score_raw), med), features=False)
    return rounded(s.select(F.col("row_id").alias("Index"),
                            F.col("pred_ensemble_blend").alias("demand")))


def q_submission_csv(spark, sf):
    """K1 then S4: the submission written as CSV (part files) and read back."""
    from zonecast.sources import sinks
    from zonecast.sources.readers import read_submission
    path = scratch_dir(spark, "submission")
    sinks.write_submission(experiment(spark, sf).scored, path, "pred_ensemble_blend")
    back = read_submission(spark, path)
    return back


def q_stream_score(spark, sf):
    from zonecast.streaming.scoring import score_stream_once
    e = experiment(spark, sf)
    return rounded(score_stream_once(spark, sf, e.final, e.ctx.medians))


def queries() -> dict:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}
