"""Per-(session, data folder) fitted state shared by the registered queries.

Fitting is the only place actions run; the fitted tables are small and cut
from the lineage, so later queries plan against them without recomputation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import sources
from zonecast.operators import cleaning
from zonecast.operators.encoding import ZoneEncoding, fit_encoding
from zonecast.operators.features import engineer, row_features
from zonecast.session import spread

_CTX: dict[tuple[int, str], "Context"] = {}
#: Partitions a core of the tables that are kept: each later shuffle opens one file a kept and a shuffle partition.
KEPT_PARTITIONS = 4


def context(spark: SparkSession, sf_dir: str) -> "Context":
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _CTX:
        _CTX[key] = Context(spark, sf_dir.rstrip("/"))
    return _CTX[key]


def round_half_away(c, digits: int):
    """Round through DECIMAL(38,12): snapping to 12 places first absorbs the
    last-bit noise of floating sums (which differs between engines and between
    partitionings), then rounding half-up to ``digits`` decides exact decimal
    ties the same way everywhere (no -0.0 either)."""
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (engine-independent comparison of results)."""
    return df.select(*[round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def kept(df: DataFrame) -> DataFrame:
    """``df`` (after a shuffle) for many passes: in memory, then on disk, in a few partitions a core."""
    return df.coalesce(KEPT_PARTITIONS * df.sparkSession.sparkContext.defaultParallelism).persist()


def clear_contexts() -> None:
    """Forgets all fitted state and frees what it cached."""
    for ctx in _CTX.values():
        ctx.close()
    _CTX.clear()


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def close(self) -> None:
        for name in ("train_dedup", "train_clean", "labelled_clean"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    @property
    def obs(self) -> DataFrame:
        return sources.observations(self.spark, self.sf_dir)

    @property
    def train_raw(self) -> DataFrame:
        return sources.obs_train(self.spark, self.sf_dir)

    @property
    def score_raw(self) -> DataFrame:
        return sources.obs_score(self.spark, self.sf_dir)

    @cached_property
    def train_dedup(self) -> DataFrame:
        """Deduplicated training rows, shared by the median fit and the cleaning."""
        return cleaning.dedup(self.train_raw).persist()

    @cached_property
    def medians(self) -> cleaning.Medians:
        return cleaning.fit_medians(self.train_dedup)

    @cached_property
    def train_clean(self) -> DataFrame:
        """Reused by every fit and summary: kept (memory, then disk) once built."""
        return cleaning.clean(self.train_dedup, self.medians).persist()

    @cached_property
    def labelled_clean(self) -> DataFrame:
        """Every adapter row (all carry demand), cleaned with the train medians:
        the table the time-aware split (train days / holdout days) runs on."""
        return kept(cleaning.clean(cleaning.dedup(self.obs.drop("is_train")), self.medians))

    @property
    def score_clean(self) -> DataFrame:
        return cleaning.clean(self.score_raw, self.medians)

    @property
    def score_dealt(self) -> DataFrame:
        """``score_clean`` for the members: its rows are dealt out before they are cleaned."""
        return cleaning.clean(spread(self.score_raw), self.medians)

    @cached_property
    def encoding(self) -> ZoneEncoding:
        return fit_encoding(self.train_clean)

    @property
    def train_features(self) -> DataFrame:
        return engineer(self.train_clean, self.encoding)[0]

    @property
    def score_features(self) -> DataFrame:
        return engineer(self.score_clean, self.encoding)[0]

    @property
    def train_rows(self) -> DataFrame:
        """Cleaned training rows with the row-level features (hour, lat/lon...)."""
        return row_features(self.train_clean)
