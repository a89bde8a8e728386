"""Regression metrics (A23): R2, RMSE, MAE in one aggregation, any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str = "demand", prediction: str = "prediction",
                       keys: list[str] | None = None) -> DataFrame:
    """R2 = 1 - SSE / SST (NULL when SST is 0), RMSE, MAE over rows with both values.

    SST is n * var_pop(y), so the whole thing is one partial-aggregated pass."""
    keys = keys or []
    y, p = F.col(label), F.col(prediction)
    both = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    d = df.where(both)
    err = y - p
    agg = (d.groupBy(*keys) if keys else d.groupBy())
    out = agg.agg(F.sum(err * err).alias("sse"), F.var_pop(y).alias("vy"),
                  F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"))
    return out.select(*keys,
                      (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "n")
