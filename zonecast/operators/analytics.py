"""Analytical summaries over an observation table.

All group-bys are hash aggregates with partial (map-side) aggregation, so a hot
key costs one partial row per task in the shuffle.  NULL group keys are dropped
(group-by semantics of the reference).  Pivots get their value lists up front so
no hidden distinct job runs.  Nothing is collected to the driver except one-row
scalars (min/max bounds) that parameterise a later expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.labels import peak_label
from zonecast.functions.geo import geohash_latlon
from zonecast.operators.joins import maybe_broadcast
from zonecast.operators.quantiles import exact_quantiles
from zonecast.session import cut_lineage, materialize, scratch_dir


def mean_by(df: DataFrame, key: str, value: str = "demand", name: str = "mean_demand",
            ascending: bool | None = None) -> DataFrame:
    """Mean of ``value`` per ``key`` (optionally ordered)."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    if ascending is not None:
        out = out.orderBy(F.col(name).asc() if ascending else F.col(name).desc(), F.col(key))
    return out


def summary_by(df: DataFrame, key: str, value: str = "demand", digits: int = 5) -> DataFrame:
    """Mean / sample std / count per key, rounded half-even like pandas."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.bround(F.avg(value), digits).alias("mean_demand"),
                 F.bround(F.stddev_samp(value), digits).alias("std_demand"),
                 F.count(value).alias("n")))


def peak_contrast(df: DataFrame) -> DataFrame:
    """A8 with the F19 label."""
    return (df.where(F.col("is_peak_hour").isNotNull()).groupBy("is_peak_hour")
            .agg(F.avg("demand").alias("mean_demand"))
            .withColumn("label", peak_label(F.col("is_peak_hour"))))


def means_by_each(df: DataFrame, keys: list[str], value: str = "demand") -> DataFrame:
    """A10: mean per value of each key in one pass (GROUPING SETS), long form
    (attribute, value, mean)."""
    import uuid
    sets = ", ".join(f"({k})" for k in keys)
    view = f"zc_means_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(view)
    gid = " ".join([f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys])
    val = " ".join([f"WHEN grouping({k}) = 0 THEN CAST({k} AS STRING)" for k in keys])
    non_null = " OR ".join(f"{k} IS NOT NULL" for k in keys)
    return df.sparkSession.sql(
        f"SELECT CASE {gid} END AS attribute, CASE {val} END AS value, "
        f"avg({value}) AS mean_demand FROM {view} "
        f"GROUP BY GROUPING SETS ({sets}) HAVING ({non_null})")


def zone_map(df: DataFrame) -> DataFrame:
    """Per zone mean demand, first non-NULL lane count in row order,
    decoded cell midpoint; zones that do not decode are dropped."""
    lanes = F.col("NumberofLanes")
    z = (df.where(F.col("geohash").isNotNull()).groupBy("geohash")
         .agg(F.avg("demand").alias("mean_demand"),
              F.min_by(lanes, F.when(lanes.isNotNull(), F.col("row_id"))).alias("lanes")))
    lat, lon = geohash_latlon(F.col("geohash"))
    return z.withColumns({"lat": lat, "lon": lon}).where(F.col("lat").isNotNull())


def pivot_mean(df: DataFrame, row_key: str, col_key: str, values: list, prefix: str,
               value: str = "demand") -> DataFrame:
    """Mean of ``value`` for row_key x col_key, missing cells 0."""
    p = (df.where(F.col(row_key).isNotNull()).groupBy(row_key)
         .pivot(col_key, values).agg(F.avg(value)))
    renamed = [F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{prefix}{v}") for v in values]
    return p.select(row_key, *renamed)


# Columns that a pivot may have; more distinct values are an error, not a truncated header.
MAX_PIVOT = 1000


def distinct_values(df: DataFrame, col: str, at_most: int = MAX_PIVOT) -> list:
    """Sorted distinct non-NULL values of a low-cardinality column (pivot header)."""
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(at_most + 1).collect()]
    if len(found) > at_most:
        raise ValueError(f"{col} has more than {at_most} distinct values: too many for pivot columns")
    return sorted(found)


def zone_kpis(zmap: DataFrame) -> DataFrame:
    """Largest and smallest zone mean and zone count."""
    return zmap.agg(F.max("mean_demand").alias("max_zone_mean"),
                    F.min("mean_demand").alias("min_zone_mean"),
                    F.count("*").alias("n_zones"))


def arg_best(df: DataFrame, key: str, value: str = "demand", largest: bool = True,
             digits: int = 9) -> DataFrame:
    """A15 idxmax/idxmin over group means; ties -> smallest key (first in key order)."""
    m = mean_by(df, key, value, "m")
    # compare means at ``digits`` places (via DECIMAL, so float noise cannot split a tie)
    rm = F.round(F.col("m").cast("decimal(38,12)"), digits)
    order = rm.desc() if largest else rm.asc()
    return m.orderBy(order, F.col(key).asc()).limit(1)


def best_of_each(df: DataFrame, wanted: list[tuple[str, str, bool]], value: str = "demand", digits: int = 9) -> DataFrame:
    """A15 for several keys in one pass over the table: ``wanted`` holds (name, key column, largest);
    returns ``kpi, key, value``.  Ties go to the smallest key."""
    means = means_by_each(df, list(dict.fromkeys(k for _, k, _ in wanted)), value)
    means = materialize(means, scratch_dir(df.sparkSession, "group-means"))  # one row a key value
    out = None
    for name, key, largest in wanted:
        rm = F.round(F.col("mean_demand").cast("decimal(38,12)"), digits)
        tie = F.col("value").cast(df.schema[key].dataType).asc()
        one = (means.where((F.col("attribute") == key) & F.col("value").isNotNull()).orderBy(rm.desc_nulls_last() if largest else rm.asc_nulls_last(), tie)
               .limit(1).select(F.lit(name).alias("kpi"), F.col("value").alias("key"), F.col("mean_demand").alias("value")))
        out = one if out is None else out.unionByName(one)
    return out


def describe(df: DataFrame, value: str = "demand", keys: list[str] | None = None) -> DataFrame:
    """Min, max, mean, exact median, sample std."""
    keys = keys or []
    aggs = [F.min(value).alias("min"), F.max(value).alias("max"),
            F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    med = exact_quantiles(df, value, keys, {"median": 0.5})
    if keys:
        return df.groupBy(*keys).agg(*aggs).join(med, keys, "left")
    # one global row: the scalars are attached to the median row (no join)
    b = df.agg(*aggs).first()
    return med.select(*[F.lit(b[c]).cast("double").alias(c) for c in ("min", "max", "mean", "std")],
                      "median")


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r that is NULL (not an error) for a constant column."""
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xx, yy), F.sqrt(F.var_pop(xx) * F.var_pop(yy)))


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation matrix in one aggregation pass, long form (a, b, r)."""
    # the matrix is symmetric: each pair is computed once and mirrored
    half = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
            for i, (a, b) in enumerate(half)]
    wide = df.agg(*aggs)
    cells = [(a, b, i) for i, (a, b) in enumerate(half)] + [(b, a, i) for i, (a, b) in enumerate(half) if a != b]
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for a, b, i in cells)
    return wide.selectExpr(f"stack({len(cells)}, {stack}) AS (a, b, r)")


def box_stats(df: DataFrame, key: str, value: str = "demand") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (furthest point inside the fence) and
    outlier count per key.  Quartiles are exact; the whisker pass joins the
    small per-key table back with a broadcast (one row per key)."""
    base = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    q = exact_quantiles(base, value, [key], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumns({"lo_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    v = F.col(value)
    inside = v.between(F.col("lo_fence"), F.col("hi_fence"))
    q = cut_lineage(q)  # one row per key; materialised once, then size-checked
    w = (base.join(maybe_broadcast(q), key)
         .groupBy(key)
         .agg(F.min(F.when(inside, v)).alias("lower_whisker"),
              F.max(F.when(inside, v)).alias("upper_whisker"),
              F.count(F.when(~inside, 1)).alias("n_outliers")))
    return q.join(w, key).drop("lo_fence", "hi_fence")


def value_range(df: DataFrame, value: str) -> tuple[float | None, float | None, int]:
    r = df.agg(F.min(value), F.max(value), F.count(value)).first()
    return r[0], r[1], r[2]


def histogram(df: DataFrame, value: str = "demand", bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum lands in the last bin."""
    lo, hi, _ = value_range(df, value)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    h = (df.where(F.col(value).isNotNull()).groupBy(b.alias("bin"))
         .agg(F.count("*").alias("n")))
    # every bin has a row, empty ones count 0
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(h, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"))


def kde(df: DataFrame, value: str = "demand", grid: int = 100, fine_bins: int = 4096) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on a ``grid``-point grid over [min, max].

    Rows are first counted into ``fine_bins`` equal-width bins (one partial-
    aggregated pass); each bin contributes ``n * K((x - centre) / h)`` to every
    grid point.  Work after the pass is bins x grid, independent of row count.
    Every row is counted; binning moves a point at most half a bin width."""
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                   F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).first()
    lo, hi, n, sd = stats["lo"], stats["hi"], stats["n"], stats["sd"]
    if not n or sd is None or sd == 0 or hi == lo:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    h = sd * n ** (-1.0 / 5.0)
    width = (hi - lo) / fine_bins
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(fine_bins - 1))
    counts = (df.where(F.col(value).isNotNull()).groupBy(b.cast("int").alias("b"))
              .agg(F.count("*").alias("c"))
              .withColumn("centre", F.lit(lo) + (F.col("b") + 0.5) * F.lit(width)))
    step = (hi - lo) / (grid - 1)
    pts = counts.select("c", "centre", F.posexplode(F.sequence(F.lit(0), F.lit(grid - 1)))
                        .alias("__p", "i"))
    x = F.lit(lo) + F.col("i") * F.lit(step)
    u = (x - F.col("centre")) / F.lit(h)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return (pts.groupBy("i").agg(F.sum(F.col("c") * F.exp(-0.5 * u * u)).alias("s"))
            .select(F.col("i").cast("int"), (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"),
                    (F.col("s") * F.lit(norm)).alias("density")))


def linear_trend(df: DataFrame, y: str = "demand", x: str = "Temperature") -> DataFrame:
    """Least-squares line of y on x (pairs with both present)."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_min"),
                  F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_max"))


def trend_line(trend: DataFrame, points: int = 100) -> DataFrame:
    """The fitted line at ``points`` evenly spaced x over the observed range."""
    step = (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    t = trend.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xv = F.col("x_min") + F.col("i") * step
    return t.select(F.col("i").cast("int"), xv.alias("x"),
                    (F.col("slope") * xv + F.col("intercept")).alias("y"))


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Deterministic sample of at most n rows (same rows on every run and
    partitioning): the n smallest values of a seeded permutation of the key.
    Per-partition top-n then an n-row merge (TakeOrderedAndProject)."""
    from zonecast.operators.folds import mix
    return df.orderBy(mix(F.col(key), seed), F.col(key)).limit(n)
