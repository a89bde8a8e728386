"""Observation scans (S1, S2, S4, S7) with explicit schemas and NA normalisation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.schema import OBS_SCHEMA

# The texts that a CSV reader takes as missing, exactly as written (case and blanks count).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]


def na_to_null(c: Column) -> Column:
    """NULL for any missing-value token, else the value unchanged."""
    return F.when(~c.isin(NA_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    """Spark treats NaN as a value; the engine keeps one missing marker (NULL)."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def observations_from_text(raw: DataFrame) -> DataFrame:
    """Typed observations from text columns (batch or stream).  Columns are matched by *name* (order and
    extra columns do not matter; an absent column is NULL, an absent target is left out);
    missing-value tokens become NULL and numbers are coerced, integers through double (``48.0``)."""
    present = set(raw.columns)

    def text(name: str):
        return na_to_null(F.col(f"`{name}`")) if name in present else F.lit(None).cast("string")

    def num(name: str):
        return nan_to_null(text(name).try_cast("double"))

    def whole(name: str, kind: str):
        exact, d = text(name).try_cast(kind), num(name)
        return F.coalesce(exact, F.when(d == F.floor(d), d.try_cast(kind)))

    out = raw.select(
        whole("Index", "bigint").alias("row_id"),
        text("geohash").alias("geohash"),
        whole("day", "int").alias("day"),
        text("timestamp").alias("timestamp"),
        text("RoadType").alias("RoadType"),
        num("NumberofLanes").alias("NumberofLanes"),
        text("LargeVehicles").alias("LargeVehicles"),
        text("Landmarks").alias("Landmarks"),
        num("Temperature").alias("Temperature"),
        text("Weather").alias("Weather"),
        num("demand").alias("demand"),
    )
    return out if "demand" in present else out.drop("demand")


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    # blanks are kept and only the tokens above are missing, so a blank-only category stays a value
    return (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_observations_csv(spark: SparkSession, path: str, with_target: bool = True) -> DataFrame:
    """CSV with header, see ``observations_from_text``."""
    out = observations_from_text(_text_csv(spark, path))
    return out if with_target else out.drop("demand")


def stream_observations_csv(spark: SparkSession, path: str, files_per_trigger: int = 100,
                            columns: list[str] | None = None) -> DataFrame:
    """S1 as a stream.  A stream's schema is fixed at its start, so the column order comes from the header
    of the files there (or ``columns`` for a folder that is still empty); a later file with another header
    is an error, never a silent shift of columns."""
    columns = columns or _text_csv(spark, path).columns
    raw = (spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
           .option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", files_per_trigger)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return observations_from_text(raw)


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_observations_csv(spark, path)
    df = spark.read.parquet(path)
    for f in OBS_SCHEMA.fields:
        if f.name in df.columns and isinstance(f.dataType, T.DoubleType):
            df = df.withColumn(f.name, nan_to_null(F.col(f.name).cast("double")))
    return df


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A missing input is ``None`` rather than an error."""
    try:
        df = read_observations(spark, path, fmt)
        df.schema  # forces path resolution
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Submission / OOF CSV: ``Index`` long, every other column double; what does not parse is NULL."""
    raw = _text_csv(spark, path)
    return raw.select(*[na_to_null(F.col(f"`{c}`")).try_cast("bigint" if c == "Index" else "double").alias(c) for c in raw.columns])


def literal_observations(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Observations from literal rows (a form, a request list)."""
    names = [f.name for f in OBS_SCHEMA.fields]
    tuples = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(tuples, OBS_SCHEMA)
