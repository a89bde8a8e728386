"""Zone target statistics and hierarchical target encoding.

Fit: one partial-aggregated pass gives per-zone mean/std/count; prefix-5/4/3
means roll up from per-zone (sum, count) partials, so the large table is not
re-read for them; medians come from the exact quantile operator (skew-safe).
The fitted tables are small (one row per zone / prefix); they are cut from the
lineage and joined with a size-checked broadcast.

Apply: exact zone -> prefix-5 -> prefix-4 -> prefix-3 -> global mean fallback
for ``geo_mean_demand``; median falls back to the global median, std to 0,
frequency to 1; unseen zones rank last (n + 1); density = freq / max freq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.geo import geo_prefix, geohash_latlon
from zonecast.operators.joins import maybe_broadcast
from zonecast.operators.quantiles import exact_quantiles
from zonecast.operators.ranking import global_row_number
from zonecast.session import cut_lineage

PREFIX_LEVELS = (5, 4, 3)


def zone_partials(train: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-zone mean, sample std (single row -> 0), non-NULL count and the
    (sum, count) partials the prefix roll-up needs.  NULL zones are dropped."""
    keys = (keys or []) + ["geohash"]
    return (train.where(F.col("geohash").isNotNull())
            .groupBy(*keys)
            .agg(F.avg("demand").alias("geo_mean_demand"),
                 F.coalesce(F.stddev_samp("demand"), F.lit(0.0)).alias("geo_std_demand"),
                 F.count("demand").alias("geo_freq"),
                 F.sum("demand").alias("sum_demand")))


def zone_stats(train: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: geohash, mean, std, median, count (``keys`` e.g. ``['fold']`` prefix them)."""
    keys = keys or []
    parts = zone_partials(train, keys)
    med = exact_quantiles(train.where(F.col("geohash").isNotNull()), "demand",
                          keys + ["geohash"], {"geo_median_demand": 0.5})
    return (parts.join(med, keys + ["geohash"], "left")
            .select(*keys, "geohash", "geo_mean_demand", "geo_std_demand",
                    "geo_median_demand", "geo_freq", "sum_demand"))


def prefix_stats(train: DataFrame, keys: list[str] | None = None,
                 partials: DataFrame | None = None) -> DataFrame:
    """A2: (level, prefix, mean) for prefix lengths 5, 4, 3.

    Rolled up from per-zone partials: mean over rows = sum(sums) / sum(counts)."""
    keys = keys or []
    parts = partials if partials is not None else zone_partials(train, keys)
    lv = F.explode(F.array(*[F.struct(F.lit(n).alias("level"),
                                      geo_prefix(F.col("geohash"), n).alias("prefix"))
                             for n in PREFIX_LEVELS])).alias("p")
    return (parts.select(*keys, "sum_demand", "geo_freq", lv)
            .groupBy(*keys, F.col("p.level").alias("level"), F.col("p.prefix").alias("prefix"))
            .agg((F.sum("sum_demand") / F.sum("geo_freq")).alias("prefix_mean"))
            .where(F.col("prefix").isNotNull()))


def global_stats(train: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3: global mean and (exact) median of demand, optionally per ``keys``."""
    med = exact_quantiles(train, "demand", keys or [], {"global_median": 0.5})
    if keys:
        mean = train.groupBy(*keys).agg(F.avg("demand").alias("global_mean"))
        return mean.join(med, keys, "left")
    # one global row: the mean is a scalar attached to the median row (no join)
    m = train.agg(F.avg("demand")).first()[0]
    return med.select(F.lit(m).cast("double").alias("global_mean"), "global_median")


def rank_order() -> list:
    """Mean descending (NULL last), ties by geohash.  Means are compared at 12
    decimals so that mathematically equal means (which floating sums in any
    order may leave an ulp apart) always tie and break by geohash."""
    return [F.col("geo_mean_demand").cast("decimal(38,12)").desc_nulls_last(),
            F.col("geohash").asc()]


def zone_rank(stats: DataFrame) -> DataFrame:
    """1-based rank by mean descending (NULL means last), ties by geohash."""
    return global_row_number(stats, rank_order(), "geo_rank")


@dataclass
class ZoneEncoding:
    """Fitted encoder: small tables plus scalars."""
    zones: DataFrame          # geohash, mean, std, median, freq, rank
    prefixes: DataFrame       # level, prefix, prefix_mean
    global_mean: float | None
    global_median: float | None
    n_zones: int
    max_freq: float
    n_prefixes: int

    def transform(self, df: DataFrame, density_scope: str = "fitted") -> DataFrame:
        return apply_encoding(df, self, density_scope)

    def save(self, path: str) -> None:
        """K4: zone and prefix tables as parquet, scalars as a one-row table."""
        spark = self.zones.sparkSession
        self.zones.write.mode("overwrite").parquet(f"{path}/zones")
        self.prefixes.write.mode("overwrite").parquet(f"{path}/prefixes")
        spark.createDataFrame(
            [(self.global_mean, self.global_median, self.n_zones, self.max_freq, self.n_prefixes)],
            "global_mean double, global_median double, n_zones long, max_freq double, "
            "n_prefixes long").write.mode("overwrite").parquet(f"{path}/scalars")

    @staticmethod
    def load(spark, path: str) -> "ZoneEncoding":
        """The fitted encoder back from ``save``."""
        r = spark.read.parquet(f"{path}/scalars").first()
        return ZoneEncoding(spark.read.parquet(f"{path}/zones"),
                            spark.read.parquet(f"{path}/prefixes"), r["global_mean"],
                            r["global_median"], int(r["n_zones"]), float(r["max_freq"]),
                            int(r["n_prefixes"]))


def fit_encoding(train: DataFrame) -> ZoneEncoding:
    """F18b fit: statistics of ``train`` (cleaned observations).

    Jobs: zone partials (cached, one pass over ``train``), exact zone and
    global medians, the distributed rank, and one scalar read-back; prefix
    and global means are rolled up from the partials."""
    parts = zone_partials(train).persist()
    agg = parts.agg(F.count("*").alias("n"), F.max("geo_freq").alias("mx"),
                    (F.sum("sum_demand") / F.sum("geo_freq")).alias("gmean")).first()
    # the per-zone counts bound the median groups: no separate sizing job
    med = exact_quantiles(train.where(F.col("geohash").isNotNull()), "demand", ["geohash"],
                          {"geo_median_demand": 0.5}, max_group=int(agg["mx"] or 0))
    zones = parts.join(med, "geohash", "left")
    lat, lon = geohash_latlon(F.col("geohash"))
    zones = cut_lineage(zone_rank(zones).select(
        "geohash", "geo_mean_demand", "geo_std_demand", "geo_median_demand",
        "geo_freq", "geo_rank", lat.alias("latitude"), lon.alias("longitude")))
    prefixes = cut_lineage(prefix_stats(train, partials=parts))
    gmed = exact_quantiles(train, "demand", [], {"global_median": 0.5}).first()
    n = int(agg["n"])
    parts.unpersist()
    return ZoneEncoding(zones, prefixes, agg["gmean"], gmed["global_median"] if gmed else None,
                        n, float(agg["mx"] or 1.0), 3 * n)


def apply_encoding(df: DataFrame, enc: ZoneEncoding, density_scope: str = "fitted") -> DataFrame:
    """J1-J5 on any observation frame (batch or stream); adds geo_prefix_* if absent."""
    for n in PREFIX_LEVELS:
        if f"geo_prefix_{n}" not in df.columns:
            df = df.withColumn(f"geo_prefix_{n}", geo_prefix(F.col("geohash"), n))
    has_ll = "latitude" in enc.zones.columns
    ll = [F.col("latitude").alias("__zlat"), F.col("longitude").alias("__zlon")] if has_ll else []
    zones = maybe_broadcast(enc.zones.select(
        "geohash", F.col("geo_mean_demand").alias("__zmean"),
        F.col("geo_std_demand").alias("__zstd"), F.col("geo_median_demand").alias("__zmed"),
        F.col("geo_freq").alias("__zfreq"), F.col("geo_rank").alias("__zrank"), *ll), enc.n_zones)
    out = df.join(zones, "geohash", "left")
    if "latitude" not in df.columns:
        # decoded once per fitted zone; the expression runs only for unseen zones
        lat, lon = geohash_latlon(F.col("geohash"))
        zl = (F.col("__zlat"), F.col("__zlon")) if has_ll else (F.lit(None), F.lit(None))
        out = out.withColumns({"latitude": F.coalesce(zl[0], lat),
                               "longitude": F.coalesce(zl[1], lon)})
    for n in PREFIX_LEVELS:
        p = maybe_broadcast(enc.prefixes.where(F.col("level") == n)
                            .select(F.col("prefix").alias(f"geo_prefix_{n}"),
                                    F.col("prefix_mean").alias(f"__p{n}")), enc.n_prefixes)
        out = out.join(p, f"geo_prefix_{n}", "left")
    freq = F.coalesce(F.col("__zfreq").cast("double"), F.lit(1.0))
    out = out.withColumns({
        "geo_mean_demand": F.coalesce(F.col("__zmean"), F.col("__p5"), F.col("__p4"),
                                      F.col("__p3"), F.lit(enc.global_mean).cast("double")),
        "geo_std_demand": F.coalesce(F.col("__zstd"), F.lit(0.0)),
        "geo_median_demand": F.coalesce(F.col("__zmed"),
                                        F.lit(enc.global_median).cast("double")),
        "geo_freq": freq,
        "geo_rank": F.coalesce(F.col("__zrank"), F.lit(enc.n_zones + 1)).cast("int"),
    })
    if density_scope == "batch":
        mx = out.agg(F.max("geo_freq")).first()[0] or 1.0
    else:
        mx = max(enc.max_freq, 1.0) if enc.n_zones else 1.0
    out = out.withColumn("geo_density", F.col("geo_freq") / F.lit(float(mx)))
    return out.drop("__zmean", "__zstd", "__zmed", "__zfreq", "__zrank", "__zlat", "__zlon",
                    "__p5", "__p4", "__p3")


def no_stats_encoding(df: DataFrame) -> DataFrame:
    """placeholder geo columns when no statistics are available."""
    return df.withColumns({
        "geo_mean_demand": F.lit(0.0), "geo_std_demand": F.lit(0.0),
        "geo_median_demand": F.lit(0.0), "geo_freq": F.lit(1.0),
        "geo_rank": F.lit(1), "geo_density": F.lit(1.0)})


def unseen_zones(df: DataFrame, enc_zones: DataFrame) -> DataFrame:
    """Rows whose zone has no fitted mean: unknown to the encoder, or seen without any label (left anti join)."""
    known = enc_zones.where(F.col("geo_mean_demand").isNotNull()).select("geohash")
    return df.join(maybe_broadcast(known), "geohash", "left_anti")
