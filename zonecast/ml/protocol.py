"""Training protocol (3.1) and scoring (3.2) as Spark jobs.

Cross-validation: rows of the training days get a fold; fold statistics come
from one exploded group-by (E5); each fold trains the three members on its
training rows (encoded with that fold's statistics), predicts its validation
rows (out-of-fold, E6) and the holdout rows (averaged over folds, E7).  All folds'
members grow in the same passes over one table of binned rows.
Final: statistics and members refit on all training rows, then batch scoring
with both blends (M8) and the submission checks (V1-V3).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.ml import boosting
from zonecast.ml.boosting import Binner, Boosted
from zonecast.ml.members import MEMBERS, SEED, MemberConfig, feature_names, model_frame
from zonecast.operators.blend import blend
from zonecast.operators.encoding import ZoneEncoding, fit_encoding
from zonecast.operators.features import finish_features, row_features
from zonecast.operators.folds import assign_folds
from zonecast.operators.metrics import regression_metrics
from zonecast.operators.oof import encode_with_folds, fold_encoders
from zonecast.schema import BLEND_PAIR, BLEND_TRIO, CATEGORICAL_FEATURES, NUMERIC_FEATURES
from zonecast.session import materialize, publish, published, scratch_dir, scratch_name, ship


def _blends(df: DataFrame) -> DataFrame:
    cols = {m: F.col(f"pred_{m}") for m in MEMBERS}
    return df.withColumns({
        "pred_ensemble_blend": blend({m: cols[m] for m in BLEND_PAIR}, BLEND_PAIR),
        "pred_ensemble_trio": blend(cols, BLEND_TRIO)})


PREDICTIONS = [f"pred_{m}" for m in MEMBERS]


@dataclass
class Members:
    """The bins and the boosted trees of one or more sets (folds) of members, by (set, member)."""
    binner: Binner
    models: dict[tuple[int, int], Boosted]

    def predict(self, frame: DataFrame, of: str | None = None, features: bool = True) -> DataFrame:
        """A model frame, with or without its features, with the members' predictions (of the set in column ``of``, else of set 0)."""
        return boosting.predict(frame, self.models, PREDICTIONS, of, self.binner, features)

    def save(self, spark: SparkSession, path: str) -> None:
        boosting.save_binner(spark, f"{path}/bins", self.binner)
        boosting.save_trees(spark, f"{path}/trees", self.models)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Members":
        models: dict[tuple[int, int], Boosted] = {}
        boosting.load_trees(spark, f"{path}/trees", models)
        return Members(boosting.load_binner(spark, f"{path}/bins"), models)


@dataclass
class FittedEnsemble:
    encoding: ZoneEncoding
    members: Members

    def score(self, cleaned: DataFrame, density_scope: str = "fitted",
              keep: list[str] | None = None, features: bool = True) -> DataFrame:
        """M6/M7: features -> three members -> both blends (batch or stream);
        ``keep`` columns of the input ride along (scenario keys, zone...), without
        ``features`` only these, the id, the label and the predictions come back."""
        ship(cleaned.sparkSession)
        feats = finish_features(self.encoding.transform(row_features(cleaned, decode=False),
                                                        density_scope))
        return _blends(self.members.predict(model_frame(feats, label="demand", extra=keep), features=features))

    def importance(self, member: str = "cat") -> list[tuple[str, float]]:
        """Each feature's share of the gain of all splits."""
        gain = dict.fromkeys(feature_names(), 0.0)
        for tree in self.members.models[0, MEMBERS.index(member)].trees:
            for f, g in zip(tree.feature.tolist(), tree.gain.tolist()):
                if f >= 0:
                    gain[self.members.binner.features[f]] += g
        total = sum(gain.values()) or 1.0
        return sorted(((f, g / total) for f, g in gain.items()), key=lambda t: -t[1])

    def save(self, path: str) -> None:
        """K4/K5: encoder tables, bins and trees, as a new version below ``path`` that one manifest, written last, names:
        readers see the version before or this one, whole, and a run that stops leaves the one before."""
        spark = self.encoding.zones.sparkSession
        version = scratch_name("version")
        self.encoding.save(f"{path}/{version}/encoding")
        self.members.save(spark, f"{path}/{version}/members")
        publish(spark, path, version)

    @staticmethod
    def load(spark, path: str) -> "FittedEnsemble":
        """The version of the artefacts that was published last; a missing one is an error."""
        at = f"{path}/{published(spark, path)}"
        return FittedEnsemble(ZoneEncoding.load(spark, f"{at}/encoding"), Members.load(spark, f"{at}/members"))


@dataclass
class CVResult:
    oof: DataFrame        # row_id, demand, fold, pred_* (validation rows)
    holdout: DataFrame    # row_id, demand, pred_* averaged over folds
    metrics: DataFrame    # split, model, r2, rmse, mae, n
    fold_metrics: DataFrame | None = None  # fold, model, r2, rmse, mae, n of each fold's validation rows


def _binned_folds(cv: DataFrame, holdout: DataFrame, k: int, encoders: tuple | None = None):
    """The binner, the binned training rows and the binned holdout rows, each once for every fold, encoded with that fold's
    statistics: 40 bytes a row and fold, so no copy of the rows' features is kept."""
    zones, prefixes, glob = encoders or fold_encoders(cv, k)
    n_z = zones.count()
    spark = cv.sparkSession
    labelled = F.col("demand").isNotNull()       # a row without a label cannot train
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def encode(df: DataFrame, extra: str) -> DataFrame:
        return model_frame(finish_features(encode_with_folds(df, zones, prefixes, glob, n_z)), extra=["fold", extra])

    rows = materialize(row_features(cv.where(labelled)), scratch_dir(spark, "cv-rows")).withColumnRenamed("fold", "__own").withColumn("fold", folds)
    keyed = holdout.where(labelled).withColumn("__key", F.monotonically_increasing_id())  # written once, so it stays
    held = materialize(row_features(keyed), scratch_dir(spark, "cv-holdout")).withColumn("fold", folds)
    frame = encode(rows, "__own")
    binner = Binner.fit(frame, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    return (binner, materialize(binner.transform(frame), scratch_dir(spark, "cv-bins")),
            materialize(binner.transform(encode(held, "__key")), scratch_dir(spark, "cv-holdout-bins")))


def _training_rows(binned: DataFrame, own: str | None) -> DataFrame:
    valid = F.col(own) == F.col("fold") if own else F.lit(False)
    return binned.select((F.col("fold") if own else F.lit(0)).cast("int").alias("set"), "x", F.col("demand").cast("double").alias("y"), valid.alias("valid"),
                         F.xxhash64("row_id", "demand").alias("u"))


def cross_validate(cv_rows: DataFrame, holdout: DataFrame, cfg: MemberConfig, k: int = 5,
                   seed: int = 42, encoders: tuple | None = None, save_to: str | None = None) -> CVResult:
    """``encoders``: fold statistics that are already fitted; ``save_to``: keeps every fold's models, and the state of
    training, from which a run that was stopped resumes."""
    spark = cv_rows.sparkSession
    ship(spark)
    cv = assign_folds(cv_rows, k, seed)
    binner, rows, held = _binned_folds(cv, holdout, k, encoders)
    models = boosting.train(_training_rows(rows, "__own"), cfg.specs(), cfg.rounds, cfg.patience, SEED, work=save_to and f"{save_to}/training")
    members = Members(binner, models)
    if save_to:
        members.save(spark, save_to)
    score = lambda df: boosting.predict(df, models, PREDICTIONS, "fold")
    oof = score(rows.where(F.col("__own") == F.col("fold"))).select("row_id", "demand", "fold", *PREDICTIONS)
    oof = materialize(_blends(oof), scratch_dir(spark, "oof"))
    # a row is averaged over the folds by its own key, so repeated ids stay apart
    holdout_mean = materialize(_blends(score(held).groupBy("__key").agg(
        F.first("row_id").alias("row_id"), F.first("demand").alias("demand"),
        *[F.avg(c).alias(c) for c in PREDICTIONS]).drop("__key")), scratch_dir(spark, "holdout"))
    by_fold = regression_metrics(_long(oof, "fold"), keys=["fold", "model"])
    return CVResult(oof, holdout_mean, _metrics(oof, holdout_mean), by_fold)


def _long(df: DataFrame, *keep: str) -> DataFrame:
    """One row per model: ``keep``, demand, model, prediction."""
    models = list(MEMBERS) + ["ensemble_blend", "ensemble_trio"]
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("prediction")) for m in models])
    return df.select(*keep, "demand", F.explode(arr).alias("p")).select(*keep, "demand", "p.model", "p.prediction")


def _metrics(oof: DataFrame, hold: DataFrame) -> DataFrame:
    both = _long(oof).withColumn("split", F.lit("oof")).unionByName(_long(hold).withColumn("split", F.lit("holdout")))
    return regression_metrics(both, keys=["split", "model"])


def fit_final(train_clean: DataFrame, cfg: MemberConfig, final_rounds: int | None = None
              ) -> FittedEnsemble:
    """M5: statistics and members refit on every training row."""
    spark = train_clean.sparkSession
    ship(spark)
    enc = fit_encoding(train_clean)
    feats = finish_features(enc.transform(row_features(train_clean, decode=False)))
    frame = model_frame(feats.where(F.col("demand").isNotNull()))
    binner = Binner.fit(frame, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    rows = materialize(binner.transform(frame), scratch_dir(spark, "final-bins"))
    return FittedEnsemble(enc, Members(binner, boosting.train(_training_rows(rows, None), cfg.specs(), final_rounds or cfg.rounds, None, SEED)))


def oof_table(cv: CVResult) -> DataFrame:
    """K3 layout."""
    return cv.oof.select(F.col("row_id").alias("Index"), F.col("demand").alias("demand_true"),
                         "pred_cat", "pred_lgb", "pred_xgb", "pred_ensemble_blend",
                         "pred_ensemble_trio")


def score_requests(cleaned_requests: DataFrame, ensemble: "FittedEnsemble | None") -> DataFrame:
    """M7: score request rows (a form, an API batch); without fitted artefacts
    every prediction is NULL rather than an error."""
    if ensemble is None:
        return cleaned_requests.select(
            "row_id", *[F.lit(None).cast("double").alias(f"pred_{m}") for m in MEMBERS],
            F.lit(None).cast("double").alias("pred_ensemble_blend"),
            F.lit(None).cast("double").alias("pred_ensemble_trio"))
    return ensemble.score(cleaned_requests).select(
        "row_id", *[f"pred_{m}" for m in MEMBERS], "pred_ensemble_blend", "pred_ensemble_trio")
