"""Category codes (E1/E2, J7): lexicographic codes per column, unseen -> -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.joins import maybe_broadcast
from zonecast.operators.ranking import grouped_row_number

NULL_TEXT = "nan"  # a missing category is coded as its text form


def category_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, category, code): distinct values per column in code-point
    order, 0-based, numbered without a task that holds all values of a column."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, category)")
    long = long.withColumn("category", F.coalesce("category", F.lit(NULL_TEXT))).distinct()
    numbered = grouped_row_number(long, "column_name", [F.col("category").asc()], "code")
    return numbered.select("column_name", "category", (F.col("code") - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, table: DataFrame, cols: list[str], n_rows: int | None = None,
                keep_original: bool = False) -> DataFrame:
    """Append ``<col>_code`` for each column (unseen -> -1); originals dropped."""
    out = df
    for c in cols:
        t = maybe_broadcast(table.where(F.col("column_name") == c)
                            .select(F.col("category").alias("__cat"),
                                    F.col("code").alias(f"{c}_code")), n_rows)
        out = (out.withColumn("__cat", F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)))
               .join(t, "__cat", "left")
               .withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1)))
               .drop("__cat"))
        if not keep_original:
            out = out.drop(c)
    return out
