"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; each round writes its links to the shared folder, and the loop ends
when a round changes nothing.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import written


def _largest(links: DataFrame) -> DataFrame:
    """Every vertex's greater neighbours point to the least of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _smallest(links: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours point to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
    down = links.join(least, F.col("a") == F.col("v"))
    return down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("v", "m")).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``links (a, b)`` but the roots themselves; root: least vertex reachable."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = _mark(now)
    while True:
        now = written(_smallest(_largest(now).distinct()).distinct(), "links")
        after = _mark(now)
        if after == mark:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = after


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of a link table."""
    h = F.xxhash64("a", "b")
    r = links.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 24)), F.bit_xor(h)).first()
    return tuple(r)
