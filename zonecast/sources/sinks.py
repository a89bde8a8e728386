"""Sinks (K1-K6): submission/OOF CSVs and fitted tables as parquet.

No ``coalesce(1)``: each task writes its own part file, so the write scales
with the cluster; readers take the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_submission(pred: DataFrame, path: str, prediction_col: str = "prediction",
                     id_col: str = "row_id") -> None:
    """K1/K2: ``Index, demand`` CSV with header."""
    (pred.select(F.col(id_col).alias("Index"), F.col(prediction_col).alias("demand"))
     .write.mode("overwrite").option("header", True).csv(path))


def write_oof(oof: DataFrame, path: str) -> None:
    """K3: out-of-fold CSV in the seven-column layout."""
    cols = ["Index", "demand_true", "pred_cat", "pred_lgb", "pred_xgb",
            "pred_ensemble_blend", "pred_ensemble_trio"]
    oof.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K4/K6: fitted statistics, fold statistics, category maps, predictions."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
