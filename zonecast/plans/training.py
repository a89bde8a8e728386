"""End-to-end training (3.1) and batch inference (3.2) with all sinks.

    python -m zonecast.plans.training train  --train <path> --out <dir> [--csv]
    python -m zonecast.plans.training infer  --test <path> --models <dir> --out <dir> [--csv]
    python -m zonecast.plans.training final  --train <path> --out <dir of an earlier train> [--csv]
    python -m zonecast.plans.training validate --submission <path> [--expected-rows N]

Inputs are observation tables (parquet by default, CSV with ``--csv``).  The
training days / holdout days split is a parameter (reference: 48 / 49).
Every artefact is written below ``--out`` (a shared folder on a cluster).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.ml.members import MemberConfig
from zonecast.ml.protocol import FittedEnsemble, cross_validate, fit_final, oof_table
from zonecast.operators import cleaning
from zonecast.operators.categories import apply_codes, category_table
from zonecast.operators.features import finish_features, row_features
from zonecast.operators.folds import assign_folds
from zonecast.operators.oof import fold_encoders
from zonecast.operators.validation import require_valid, validate_submission
from zonecast.schema import CATEGORICAL_FEATURES
from zonecast.session import materialize, scratch_dir, spread
from zonecast.sources import sinks
from zonecast.sources.readers import read_observations, read_submission


def train_and_evaluate(spark: SparkSession, train: DataFrame, out: str, cfg: MemberConfig,
                       train_days=(48,), holdout_days=(49,), final_rounds: int | None = None,
                       k: int = 5, seed: int = 42) -> DataFrame:
    """Returns the cross-validation metrics table; writes medians, fold
    statistics, category maps, OOF CSV, predictions and final models."""
    # one dedup shuffle, written once; later passes read only the columns they use
    d = materialize(cleaning.dedup(train), f"{out}/work/train_dedup")
    medians = cleaning.fit_medians(d)
    medians.save(spark, f"{out}/train_medians")
    clean = cleaning.clean(d, medians)
    cv_rows, hold = cleaning.split_by_day(clean, train_days, holdout_days)
    encoders = zones, prefixes, glob = fold_encoders(assign_folds(cv_rows, k, seed), k)
    sinks.write_table(zones, f"{out}/fold_stats/zones", ["fold"])
    sinks.write_table(prefixes, f"{out}/fold_stats/prefixes", ["fold"])
    sinks.write_table(glob, f"{out}/fold_stats/globals")
    cv = cross_validate(cv_rows, hold, cfg, k, seed, encoders, f"{out}/fold_models")
    sinks.write_table(cleaning.dedup_report(train), f"{out}/dedup_report")
    sinks.write_table(cv.fold_metrics, f"{out}/fold_metrics")
    sinks.write_oof(oof_table(cv), f"{out}/oof_predictions_csv")
    preds = (cv.oof.select("row_id", F.lit("oof").alias("split"), "fold", "pred_cat", "pred_lgb",
                           "pred_xgb")
             .unionByName(cv.holdout.select("row_id", F.lit("holdout").alias("split"),
                                            F.lit(None).cast("int").alias("fold"), "pred_cat",
                                            "pred_lgb", "pred_xgb")))
    sinks.write_table(preds, f"{out}/predictions", ["split"])
    final = fit_final(clean, cfg, final_rounds)
    final.save(f"{out}/models")
    feats = finish_features(final.encoding.transform(row_features(clean)))
    sinks.write_table(category_table(feats, CATEGORICAL_FEATURES), f"{out}/category_maps")
    sinks.write_table(cv.metrics, f"{out}/cv_metrics")
    return cv.metrics


def run_inference(spark: SparkSession, test: DataFrame, models: str, out: str,
                  expected_rows: int | None = None) -> DataFrame:
    """Score a test table with saved artefacts; write both submissions;
    return the validation table (raises on wrong columns / missing values)."""
    medians = cleaning.Medians.load(spark, f"{models}/train_medians")
    ens = FittedEnsemble.load(spark, f"{models}/models")
    # the two columns that both submissions need, scored once
    scored = materialize(ens.score(cleaning.clean(spread(test), medians), features=False).select("row_id", "pred_ensemble_blend", "pred_ensemble_trio"),
                         scratch_dir(spark, "inference-scores"))
    sinks.write_submission(scored, f"{out}/submission", "pred_ensemble_blend")
    sinks.write_submission(scored, f"{out}/submission_trio", "pred_ensemble_trio")
    sub = scored.select(F.col("row_id").alias("Index"), F.col("pred_ensemble_blend").alias("demand"))
    require_valid(sub)
    return validate_submission(sub, expected_rows)


def retrain_final(spark: SparkSession, train: DataFrame, out: str, cfg: MemberConfig, final_rounds: int | None = None) -> None:
    """Only the final members, on all training rows cleaned with the medians saved below ``out``; the encoder and members are
    published as a new version, then the category maps are replaced."""
    medians = cleaning.Medians.load(spark, f"{out}/train_medians")
    clean = materialize(cleaning.clean(cleaning.dedup(train), medians), scratch_dir(spark, "final-train"))
    final = fit_final(clean, cfg, final_rounds)
    final.save(f"{out}/models")
    feats = finish_features(final.encoding.transform(row_features(clean)))
    sinks.write_table(category_table(feats, CATEGORICAL_FEATURES), f"{out}/category_maps")


def validate_file(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """V1-V3 on a submission file that was written earlier."""
    return validate_submission(read_submission(spark, path), expected_rows)


def load_category_codes(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    """Saved category maps applied to new rows (unseen values: -1)."""
    return apply_codes(rows, spark.read.parquet(f"{out}/category_maps"), CATEGORICAL_FEATURES)


def _main() -> None:
    from zonecast.session import get_session
    ap = argparse.ArgumentParser()
    ap.add_argument("mode", choices=["train", "infer", "final", "validate"])
    ap.add_argument("--train")
    ap.add_argument("--test")
    ap.add_argument("--models")
    ap.add_argument("--out")
    ap.add_argument("--csv", action="store_true")
    ap.add_argument("--rounds", type=int, default=1000)
    ap.add_argument("--final-rounds", type=int, default=1200)
    ap.add_argument("--patience", type=int, default=50)
    ap.add_argument("--expected-rows", type=int)
    ap.add_argument("--submission", help="file or folder to validate")
    ap.add_argument("--split-day", type=int,
                    help="train/validate on days <= N, hold out days > N "
                         "(default: the reference's day 48 / day 49)")
    a = ap.parse_args()
    spark = get_session()
    fmt = "csv" if a.csv else "parquet"
    if a.mode == "train":
        if a.split_day is None:
            days = dict(train_days=(48,), holdout_days=(49,))
        else:
            n = a.split_day
            days = dict(train_days=lambda d: d <= n, holdout_days=lambda d: d > n)
        m = train_and_evaluate(spark, read_observations(spark, a.train, fmt), a.out,
                               MemberConfig(rounds=a.rounds, patience=a.patience),
                               final_rounds=a.final_rounds, **days)
    elif a.mode == "final":
        retrain_final(spark, read_observations(spark, a.train, fmt), a.out, MemberConfig(rounds=a.rounds, patience=a.patience), a.final_rounds)
        return
    elif a.mode == "validate":
        m = validate_file(spark, a.submission, a.expected_rows)
    else:
        m = run_inference(spark, read_observations(spark, a.test, fmt).drop("demand"),
                          a.models, a.out, a.expected_rows)
    m.show(truncate=False)


if __name__ == "__main__":
    _main()
