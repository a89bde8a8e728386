"""Cleaning (C1-C15): dedup, fitted medians, coercion, imputation, whitespace
standardisation, missing-value audit, day split, schema alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators.quantiles import exact_quantiles
from zonecast.schema import CATEGORY_FILL, CATEGORY_FILL_COLUMNS, STRIP_COLUMNS

_WS_EDGES = r"^\s+|\s+$"


def dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (NULL equals NULL).  Partial aggregation
    collapses copies inside each map task before the shuffle, so a row copied
    millions of times costs one row per task in the exchange."""
    return df.dropDuplicates()


def dedup_report(df: DataFrame) -> DataFrame:
    """C1's counts in one pass: ``rows``, ``kept`` and ``dropped``."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    n = row.groupBy("r").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def coerce_numeric(c) -> "F.Column":
    """C4: text -> double, unparsable -> NULL (``try_cast``; ANSI ``cast`` raises)."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.try_cast("double")
    return F.when(~F.isnan(d), d)


@dataclass(frozen=True)
class Medians:
    """Fitted train medians (C2/C3).  ``lanes`` is stored rounded half-even."""
    temperature: float | None
    lanes: int

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.temperature, self.lanes)],
                                     "Temperature double, NumberofLanes int")

    @staticmethod
    def from_df(df: DataFrame) -> "Medians":
        r = df.first()
        return Medians(r["Temperature"], int(r["NumberofLanes"]))

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Medians":
        return Medians.from_df(spark.read.parquet(path))


def fit_medians(train: DataFrame) -> Medians:
    """Both medians in one exact-quantile pass over a stacked view.
    Coercion happens before (Q3); an all-NULL lane column gives 1 lane."""
    stacked = train.selectExpr(
        "stack(2, 'Temperature', try_cast(Temperature AS DOUBLE), "
        "'NumberofLanes', try_cast(NumberofLanes AS DOUBLE)) AS (column_name, v)")
    got = {r["column_name"]: r["median"] for r in
           exact_quantiles(stacked, "v", ["column_name"], {"median": 0.5}).collect()}
    lanes = got.get("NumberofLanes")
    lanes_int = 1 if lanes is None else int(round(lanes))  # Python round: half-even
    return Medians(got.get("Temperature"), lanes_int)


def impute(df: DataFrame, medians: Medians | None = None) -> DataFrame:
    """C5-C8.  With ``medians`` (training or scoring with fitted values) fill
    Temperature/lanes from them; without, fall back to this frame's Temperature
    median and 1 lane (C7).  Lanes are then truncated to int; categorical NULLs
    become ``Unknown`` when the column exists."""
    if medians is None:
        local = exact_quantiles(df, "Temperature", [], {"t": 0.5}).first()
        medians = Medians(local["t"] if local else None, 1)
    temp_fill = F.lit(medians.temperature).cast("double")
    # coercion first (text junk and NaN -> NULL), then the fill
    out = df.withColumns({
        "Temperature": F.coalesce(coerce_numeric("Temperature"), temp_fill),
        "NumberofLanes": F.coalesce(coerce_numeric("NumberofLanes"),
                                    F.lit(float(medians.lanes))).try_cast("int"),
    })
    fills = {c: CATEGORY_FILL for c in CATEGORY_FILL_COLUMNS if c in out.columns}
    return out.fillna(fills)


def standardize(df: DataFrame) -> DataFrame:
    """Strip leading/trailing whitespace (after the fill, so blank -> '')."""
    return df.withColumns({c: F.regexp_replace(F.col(c), _WS_EDGES, "")
                           for c in STRIP_COLUMNS if c in df.columns})


def clean(df: DataFrame, medians: Medians | None) -> DataFrame:
    return standardize(impute(df, medians))


def clean_train(train: DataFrame) -> tuple[DataFrame, Medians]:
    """Training clean: dedup, fit medians on the deduplicated rows, impute, strip."""
    d = dedup(train)
    m = fit_medians(d)
    return clean(d, m), m


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column in one pass, as (column_name, n_missing)."""
    aggs = [F.sum(F.when(F.col(c).isNull() | (F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType))
                                              else F.lit(False)), 1).otherwise(0))
            .cast("long").alias(c) for c, t in [(f.name, f.dataType) for f in df.schema.fields]]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_missing)")


def total_missing(df: DataFrame) -> DataFrame:
    return missing_counts(df).agg(F.sum("n_missing").cast("long").alias("total_missing"))


def split_by_day(df: DataFrame, train_days, holdout_days, check: bool = True):
    """C11: (train, holdout) by day predicates; an empty holdout is an error."""
    train = df.where(train_days(F.col("day")) if callable(train_days)
                     else F.col("day").isin(list(train_days)))
    hold = df.where(holdout_days(F.col("day")) if callable(holdout_days)
                    else F.col("day").isin(list(holdout_days)))
    if check and hold.isEmpty():
        raise ValueError("holdout split is empty: time-aware validation is impossible")
    return train, hold


def drop_strict(df: DataFrame, cols: list[str]) -> DataFrame:
    """C14: drop that fails on a missing column (Spark's ``drop`` ignores it)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def string_columns(df: DataFrame) -> list[str]:
    """Names of string-typed columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def align_schema(df: DataFrame, columns: list[str], numeric_fill: float = 0) -> DataFrame:
    """Exactly ``columns`` in that order; absent ones are 0, numeric NULLs 0."""
    present = dict((f.name, f.dataType) for f in df.schema.fields)
    out = []
    for c in columns:
        if c not in present:
            out.append(F.lit(numeric_fill).alias(c))
        elif isinstance(present[c], T.NumericType):
            out.append(F.coalesce(F.col(c), F.lit(numeric_fill).cast(present[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
