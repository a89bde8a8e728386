"""Exact quantiles per group without holding a large group in one task.

Semantics: linear interpolation between order statistics at position
``(n - 1) * p`` over the non-NULL values (pandas ``median``/``quantile``,
Spark ``percentile``, DuckDB ``quantile_cont``).

Plan:
* one skew-safe aggregate gives each group's size;
* groups with at most ``small`` values use Spark's exact ``percentile``
  (its per-group buffer is then bounded by ``small``);
* larger groups (a hot zone, the global median) are refined by rank on the ordered bit
  pattern of the values, four passes of 16 bits each, whatever the values are.

Both ways give the same answer on every input; the size only decides which is cheaper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators.joins import maybe_broadcast
from zonecast.session import materialize, scratch_dir

_G = "__zq_group"
# Largest group handed to Spark's exact percentile in one task.
SMALL_GROUP = 100_000
_LOW = (1 << 63) - 1


def exact_quantiles(df: DataFrame, value: str, keys: list[str], probs: dict[str, float],
                    small: int | None = None, max_group: int | None = None) -> DataFrame:
    """``keys`` + one column per entry of ``probs`` (name -> probability).

    ``max_group``: a known upper bound on the non-NULL values per group (e.g.
    from already computed counts); when it is within ``small`` the sizing job
    is skipped."""
    small = SMALL_GROUP if small is None else small
    names = list(probs)
    keys_ = list(keys) if keys else [_G]
    base = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("__v"))
    if not keys:
        base = base.withColumn(_G, F.lit(0))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    for k in keys:  # group-by drops NULL keys
        base = base.where(F.col(k).isNotNull())

    sizes = base.groupBy(*keys_).agg(
        F.count("*").alias("__n"))
    if max_group is not None and max_group <= small:
        n_groups, n_large = 0, 0
    else:
        # one decision job: are there groups too large for a single bounded task?
        head = sizes.agg(F.count("*").alias("g"),
                         F.count(F.when(F.col("__n") > small, 1)).alias("big")).first()
        n_groups, n_large = int(head["g"]), int(head["big"])

    pct = F.percentile(F.col("__v"), F.array(*[F.lit(float(probs[n])) for n in names]))
    if n_large == 0:
        small_base = base
    else:
        sizes = materialize(sizes, scratch_dir(df.sparkSession, "quantile-sizes"))
        small_keys = sizes.where(F.col("__n") <= small).select(*keys_)
        small_base = base.join(maybe_broadcast(small_keys, n_groups - n_large), keys_, "inner")
    small_res = (small_base.groupBy(*keys_).agg(pct.alias("__q"))
                 .select(*keys_, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)]))
    if n_large:
        small_res = small_res.unionByName(_large_quantiles(base, sizes, keys_, probs, names, small, n_large))
    if not keys:
        small_res = small_res.drop(_G)
    return small_res


def _ordered_key(v) -> "F.Column":
    """A long that orders as the double does: the IEEE bits, negative values turned over."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW)))


def _from_key(k) -> "F.Column":
    bits = F.when(k >= 0, k).otherwise(k.bitwiseXOR(F.lit(_LOW)))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _large_quantiles(base, sizes, keys_, probs, names, small, n_large):
    """Ranks of the groups above ``small``, found 16 bits of the ordered bit pattern at a time.

    Four passes settle any double, infinities included; each counts values per (group, prefix, next
    16 bits) with partial aggregation, so no task holds a group.  The state between passes (one row a
    group and rank) is written, so plans and size estimates do not grow from pass to pass."""
    spark = base.sparkSession
    large = maybe_broadcast(sizes.where(F.col("__n") > small).select(*keys_, "__n"), n_large)
    prob_arr = F.array(*[F.struct(F.lit(i).alias("__pi"), F.lit(float(probs[n])).alias("p"))
                         for i, n in enumerate(names)])
    pos = (F.col("__n") - 1) * F.col("__t.p")
    targets = (sizes.where(F.col("__n") > small).select(*keys_, "__n", F.explode(prob_arr).alias("__t"))
               .select(*keys_, F.col("__t.__pi").alias("__pi"), pos.alias("__pos"), F.floor(pos).cast("long").alias("__r0"),
                       F.ceil(pos).cast("long").alias("__r1")))
    targets = materialize(targets, scratch_dir(spark, "quantile-targets"))
    keyed = base.join(large.drop("__n"), keys_).select(*keys_, _ordered_key(F.col("__v")).alias("__k"))
    keyed = materialize(keyed, scratch_dir(spark, "quantile-keys"))
    state = (targets.select(*keys_, F.explode(F.array_distinct(F.array("__r0", "__r1"))).alias("__rank")).distinct()
             .select(*keys_, "__rank", F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__below")))
    for shift in (48, 32, 16, 0):
        prefix = F.lit(0).cast("long") if shift == 48 else F.shiftright("__k", shift + 16)
        rows = keyed.select(*keys_, prefix.alias("__prefix"), F.shiftright("__k", shift).alias("__b"))
        live = state.select(*keys_, "__prefix").distinct()
        hist = rows.join(maybe_broadcast(live), keys_ + ["__prefix"]).groupBy(*keys_, "__prefix", "__b").agg(F.count("*").alias("__c"))
        w = Window.partitionBy(*keys_, "__prefix").orderBy("__b")  # at most 2^16 rows
        hist = hist.withColumn("__cb", F.sum("__c").over(w) - F.col("__c"))
        start = F.col("__below") + F.col("__cb")
        state = (state.join(hist, keys_ + ["__prefix"]).where((F.col("__rank") >= start) & (F.col("__rank") < start + F.col("__c")))
                 .select(*keys_, "__rank", F.col("__b").alias("__prefix"), start.alias("__below")))
        state = materialize(state, scratch_dir(spark, "quantile-state"))
    xs = state.select(*keys_, "__rank", _from_key(F.col("__prefix")).alias("__x"))
    xs = materialize(xs, scratch_dir(spark, "quantile-values"))
    x0 = xs.withColumnRenamed("__rank", "__r0").withColumnRenamed("__x", "__x0")
    x1 = xs.withColumnRenamed("__rank", "__r1").withColumnRenamed("__x", "__x1")
    between = (F.col("__r1") - F.col("__pos")) * F.col("__x0") + (F.col("__pos") - F.col("__r0")) * F.col("__x1")
    q = (targets.join(x0, keys_ + ["__r0"]).join(x1, keys_ + ["__r1"])
         .withColumn("__q", F.when((F.col("__r0") == F.col("__r1")) | (F.col("__x0") == F.col("__x1")), F.col("__x0")).otherwise(between)))
    return q.groupBy(*keys_).agg(*[F.max(F.when(F.col("__pi") == i, F.col("__q"))).alias(n)
                                   for i, n in enumerate(names)])


def exact_median(df: DataFrame, value: str, keys: list[str] | None = None,
                 name: str = "median", **kw) -> DataFrame:
    return exact_quantiles(df, value, keys or [], {name: 0.5}, **kw)
