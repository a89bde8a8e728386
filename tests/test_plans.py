"""End-to-end training and inference with every sink, CSV scan with NA tokens."""

from pathlib import Path

from pyspark.sql import functions as F

from conftest import SMALL
from zonecast.ml.members import MemberConfig
from zonecast.ml.protocol import Members
from zonecast.plans.context import context
from zonecast.operators.features import categorical_frame
from zonecast.plans.training import load_category_codes, retrain_final, run_inference, train_and_evaluate, validate_file
from zonecast.schema import CATEGORICAL_FEATURES
from zonecast.session import published, scratch_dir
from zonecast.sources.readers import read_observations_csv, read_optional, read_submission


def test_train_then_infer(spark):
    ctx = context(spark, SMALL)
    out = scratch_dir(spark, "plan")
    metrics = train_and_evaluate(spark, ctx.obs.drop("is_train"), out,
                                 MemberConfig(rounds=3, patience=2),
                                 train_days=lambda d: d <= 24, holdout_days=lambda d: d > 24,
                                 final_rounds=3)
    assert metrics.count() == 10
    for sub in ["train_medians", "fold_stats/zones", "fold_stats/prefixes", "oof_predictions_csv",
                "predictions", "models/manifest-00000001", "category_maps"]:
        assert Path(out, sub).exists(), sub
    oof = read_submission(spark, f"{out}/oof_predictions_csv")
    assert oof.columns == ["Index", "demand_true", "pred_cat", "pred_lgb", "pred_xgb",
                           "pred_ensemble_blend", "pred_ensemble_trio"]
    for sub in ["fold_metrics", "dedup_report", "fold_models/bins", "fold_models/trees"]:
        assert Path(out, sub).exists(), sub
    assert spark.read.parquet(f"{out}/fold_metrics").count() == 25
    assert Members.load(spark, f"{out}/fold_models").models.keys() == {(f, m) for f in range(5) for m in range(3)}
    first = published(spark, f"{out}/models")
    test = ctx.score_raw.drop("demand")
    checks = {r["check"]: r["status"] for r in
              run_inference(spark, test, out, f"{out}/infer", test.count()).collect()}
    assert checks["rows"] == "PASS" and checks["missing"] == "PASS" and checks["columns"] == "PASS"
    sub = read_submission(spark, f"{out}/infer/submission")
    assert sub.columns == ["Index", "demand"] and sub.count() == test.count()
    again = {r["check"]: (r["value"], r["status"]) for r in validate_file(spark, f"{out}/infer/submission", test.count()).collect()}
    assert again["rows"] == (float(test.count()), "PASS") and again["missing"][1] == "PASS"
    codes = load_category_codes(spark, categorical_frame(ctx.score_clean).select("row_id", *CATEGORICAL_FEATURES), out)
    assert codes.count() == test.count()
    # only the final members, anew from the saved medians: the same rows give the same scores
    retrain_final(spark, ctx.obs.drop("is_train"), out, MemberConfig(rounds=3, patience=2), final_rounds=3)
    assert published(spark, f"{out}/models") != first and Path(out, "models", first, "encoding/zones").exists()
    run_inference(spark, test, out, f"{out}/infer2", test.count())
    both = sub.join(read_submission(spark, f"{out}/infer2/submission").withColumnRenamed("demand", "again"), "Index")
    assert both.where(F.abs(F.col("demand") - F.col("again")) > 1e-9).count() == 0


def test_csv_scan_na_tokens(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text("Index,geohash,day,timestamp,RoadType,NumberofLanes,LargeVehicles,Landmarks,"
                 "Temperature,Weather,demand\n"
                 "1,qp02z1,48,08:30,Highway,3,Allowed,No,22.5,Sunny,0.1\n"
                 "2,qp02z1,48,08:45,NA,abc,,No,NaN,null,0.2\n")
    df = read_observations_csv(spark, str(p))
    r = {x["row_id"]: x for x in df.collect()}
    assert r[1]["NumberofLanes"] == 3.0 and r[1]["Temperature"] == 22.5
    assert r[2]["RoadType"] is None and r[2]["NumberofLanes"] is None
    assert r[2]["LargeVehicles"] is None and r[2]["Temperature"] is None and r[2]["Weather"] is None


def test_optional_scan_missing_is_none(spark, tmp_path):
    assert read_optional(spark, str(tmp_path / "absent.parquet")) is None
    spark.range(3).write.parquet(str(tmp_path / "present.parquet"))
    assert read_optional(spark, str(tmp_path / "present.parquet")).count() == 3


def test_csv_columns_by_header_name(spark, tmp_path):
    p = tmp_path / "reordered.csv"
    p.write_text("demand,Index,extra,geohash,timestamp,day\n0.25,7,x,qp02z1,08:30,48\n")
    r = read_observations_csv(spark, str(p)).first()
    assert r["row_id"] == 7 and r["demand"] == 0.25 and r["day"] == 48
    assert r["geohash"] == "qp02z1" and r["Temperature"] is None
