"""Output validation (V1-V5): one aggregation pass, results as a check table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.schema import EXPECTED_SUBMISSION_COLUMNS


def validate_submission(sub: DataFrame, expected_rows: int | None,
                        expected_columns: list[str] | None = None,
                        value: str = "demand") -> DataFrame:
    """(check, value, status) rows: row count, column list, missing predictions,
    prediction min / max / mean."""
    expected_columns = expected_columns or EXPECTED_SUBMISSION_COLUMNS
    cols_ok = list(sub.columns) == list(expected_columns)
    stats = sub.agg(F.count("*").alias("rows"),
                    F.sum(F.when(F.col(value).isNull() | F.isnan(value), 1).otherwise(0))
                    .cast("long").alias("missing"),
                    F.min(value).alias("min"), F.max(value).alias("max"),
                    F.avg(value).alias("mean"))
    row_status = (F.lit("PASS") if expected_rows is None else
                  F.when(F.col("rows") == expected_rows, "PASS").otherwise("FAIL"))
    return _checks(stats, row_status, cols_ok, len(sub.columns))


def _checks(stats: DataFrame, row_status, cols_ok: bool, n_cols: int) -> DataFrame:
    s = stats.withColumn("__rs", row_status)
    return s.selectExpr(
        "stack(6, "
        "'rows', CAST(rows AS DOUBLE), __rs, "
        f"'columns', CAST({n_cols} AS DOUBLE), '{'PASS' if cols_ok else 'FAIL'}', "
        "'missing', CAST(missing AS DOUBLE), CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END, "
        "'min', min, 'INFO', "
        "'max', max, 'INFO', "
        "'mean', mean, 'INFO') AS (check, value, status)")


def require_valid(sub: DataFrame, expected_columns: list[str] | None = None,
                  value: str = "demand") -> None:
    """Raising variant used after inference (columns exact, no missing)."""
    expected_columns = expected_columns or EXPECTED_SUBMISSION_COLUMNS
    if list(sub.columns) != list(expected_columns):
        raise ValueError(f"a submission has the columns {expected_columns}, not {sub.columns}")
    if not sub.where(F.col(value).isNull() | F.isnan(value)).isEmpty():
        raise ValueError(f"column {value} has rows without a prediction")


def shape_report(df: DataFrame) -> DataFrame:
    """V5: rows and columns of a table."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
