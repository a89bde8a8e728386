"""Out-of-fold target encoding (E5) in one pass.

Sums and deviations merge, so rows are aggregated once per own fold and only those partials
reach the k - 1 folds that train on them; medians read the exploded demand column.  Validation rows join their own fold's statistics; holdout rows are
encoded once per fold (k copies), as the per-fold models score them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.geo import geo_prefix
from zonecast.operators.encoding import PREFIX_LEVELS, prefix_stats, rank_order
from zonecast.operators.folds import explode_training_folds
from zonecast.operators.joins import maybe_broadcast
from zonecast.operators.quantiles import exact_quantiles
from zonecast.operators.ranking import grouped_row_number
from zonecast.session import cut_lineage, materialize, scratch_dir


def _combined(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Sums of demand over the other folds: the rows are aggregated once per (own fold, key); only those partials
    are sent to the k - 1 folds that train on them.  ``n``, ``s`` (sum), ``m2`` (squared deviations)."""
    d = F.col("demand")
    own = rows.groupBy("fold", *keys).agg(F.count(d).alias("n"), F.sum(d).alias("s"), (F.var_pop(d) * F.count(d)).alias("m2"))
    out = explode_training_folds(own, k).groupBy("fold", *keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m2").alias("within"), F.sum(F.when(F.col("n") > 0, F.col("s") * F.col("s") / F.col("n"))).alias("sq"))
    between = F.col("sq") - F.col("s") * F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    return out.select("fold", *keys, "n", "s", (F.col("within") + F.greatest(between, F.lit(0.0))).alias("m2"))


def fold_encoders(cv_rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones, prefixes, globals) keyed by fold."""
    spark = cv_rows.sparkSession
    slim = cv_rows.select("fold", "geohash", "demand")
    ex = explode_training_folds(slim, k)  # only the medians read it
    zoned = F.col("geohash").isNotNull()
    n = F.col("n")
    stats = _combined(slim.where(zoned), k, ["geohash"]).select(
        "fold", "geohash", (F.col("s") / F.when(n > 0, n)).alias("geo_mean_demand"),
        F.coalesce(F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))), F.lit(0.0)).alias("geo_std_demand"),
        n.alias("geo_freq"), F.col("s").alias("sum_demand"))
    median = exact_quantiles(ex.where(zoned), "demand", ["fold", "geohash"], {"geo_median_demand": 0.5})
    # written once: the ranking, its counts and every later join read the finished statistics
    zones = materialize(stats.join(median, ["fold", "geohash"], "left"), scratch_dir(spark, "fold-zones"))
    # rank within a fold, distributed (no single task holds a fold's zone table)
    zones = cut_lineage(grouped_row_number(zones, "fold", rank_order(), "geo_rank"))
    prefixes = cut_lineage(prefix_stats(slim, ["fold"], partials=zones))
    whole = _combined(slim, k, []).select("fold", (F.col("s") / F.when(n > 0, n)).alias("global_mean"))
    glob = whole.join(exact_quantiles(ex, "demand", ["fold"], {"global_median": 0.5}), "fold", "left")
    counts = zones.groupBy("fold").agg(F.count("*").alias("n_zones"),
                                       F.max("geo_freq").alias("max_freq"))
    glob = cut_lineage(glob.join(counts, "fold", "left"))
    return zones, prefixes, glob


def encode_with_folds(df: DataFrame, zones: DataFrame, prefixes: DataFrame,
                      glob: DataFrame, n_zones: int | None = None) -> DataFrame:
    """Encode rows that carry a ``fold`` column with that fold's statistics."""
    z = zones.select("fold", "geohash", F.col("geo_mean_demand").alias("__zmean"),
                     F.col("geo_std_demand").alias("__zstd"),
                     F.col("geo_median_demand").alias("__zmed"),
                     F.col("geo_freq").alias("__zfreq"), F.col("geo_rank").alias("__zrank"))
    n_z = zones.count() if n_zones is None else n_zones  # checkpointed: a cheap count
    out = df.join(maybe_broadcast(z, n_z), ["fold", "geohash"], "left")
    for n in PREFIX_LEVELS:
        p = prefixes.where(F.col("level") == n).select(
            "fold", F.col("prefix").alias("__pk"), F.col("prefix_mean").alias(f"__p{n}"))
        out = (out.withColumn("__pk", geo_prefix(F.col("geohash"), n))
               .join(maybe_broadcast(p, 3 * n_z), ["fold", "__pk"], "left").drop("__pk"))
    out = out.join(F.broadcast(glob), "fold", "left")  # one row per fold
    out = out.withColumns({
        "geo_mean_demand": F.coalesce("__zmean", "__p5", "__p4", "__p3", "global_mean"),
        "geo_std_demand": F.coalesce(F.col("__zstd"), F.lit(0.0)),
        "geo_median_demand": F.coalesce("__zmed", "global_median"),
        "geo_freq": F.coalesce(F.col("__zfreq").cast("double"), F.lit(1.0)),
        "geo_rank": F.coalesce(F.col("__zrank"), F.col("n_zones") + 1).cast("int"),
    })
    out = out.withColumn("geo_density", F.col("geo_freq") /
                         F.greatest(F.col("max_freq").cast("double"), F.lit(1.0)))
    return out.drop("__zmean", "__zstd", "__zmed", "__zfreq", "__zrank", "__p5", "__p4",
                    "__p3", "global_mean", "global_median", "n_zones", "max_freq")


def oof_encode(cv_rows: DataFrame, holdout: DataFrame, k: int = 5):
    """(validation rows with their fold's encoding, holdout rows x k folds)."""
    zones, prefixes, glob = fold_encoders(cv_rows, k)
    val = encode_with_folds(cv_rows, zones, prefixes, glob)
    hold = holdout.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return val, encode_with_folds(hold, zones, prefixes, glob)
