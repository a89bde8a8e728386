"""The ``obs`` adapter: observation rows derived from the driver's ``events`` table.

The SQL text (``adapter.sql``) is shared verbatim with the DuckDB oracle so both
engines see identical input.  It is a pure projection of ``events``; Spark prunes
the scan to the five columns it reads.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def adapter_sql() -> str:
    return (Path(__file__).with_name("adapter.sql")).read_text()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All adapter rows (train and score) with the ``is_train`` flag."""
    events = read_table(spark, sf_dir, "events")
    view = f"zc_events_{abs(hash(sf_dir)) % 10**8}"
    events.createOrReplaceTempView(view)
    return spark.sql(adapter_sql().replace("FROM events", f"FROM {view}"))


def obs_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("is_train")).drop("is_train")


def obs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(~F.col("is_train")).drop("is_train")


def obs_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter rows plus exact copies of every 29th row (dedup fixture)."""
    obs = observations(spark, sf_dir)
    return obs.unionByName(obs.where(F.col("row_id") % 29 == 0))


def oracle_obs_cte() -> str:
    """``WITH obs AS (...)`` prefix for oracle SQL texts."""
    return f"WITH obs AS ({adapter_sql()})"
