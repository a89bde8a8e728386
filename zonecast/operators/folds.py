"""K-fold assignment (E4) and out-of-fold statistics (E5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix(row_id: Column, seed: int = 42) -> Column:
    """60 bits of the MD5 of ``seed:row_id``: a shuffle of the ids that does not depend on partitions,
    is unrelated for different seeds and that any SQL engine can reproduce.  A NULL id mixes as
    ``seed:`` so that its row is assigned too."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


#: Bits of ``mix``, bits told apart by one counting pass, and rows whose values are read outright.
MIX_BITS, PASS_BITS, FEW = 60, 16, 10_000


def fold_cuts(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "row_id") -> list[int]:
    """The least ``mix`` of each fold but the first: the shuffled rows (ordered by ``mix``) are cut into k blocks whose sizes
    differ by one at most, the larger ones first.

    Found by counting: a pass counts rows by the next ``PASS_BITS`` bits inside the ranges that still hold a cut,
    until a range has few rows.  Rows are neither sorted nor moved; the driver gets at most k * 2^16 counts a pass."""
    ids = df.select(mix(F.col(id_col), seed).alias("m"))
    n, open_cuts, cuts, known = None, [], {}, 0  # open: (fold, prefix, rank inside the prefix's range)
    while n is None or open_cuts:
        left = MIX_BITS - known
        step = min(PASS_BITS, left)
        inside = ids if n is None else ids.where(F.shiftright("m", left).isin(sorted({prefix for _, prefix, _ in open_cuts})))
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy(F.shiftright("m", left - step).alias("b")).count().orderBy("b").collect():
            counts.setdefault(r["b"] >> step, []).append((r["b"], r["count"]))
        if n is None:
            n = sum(c for _, c in counts.get(0, []))
            sizes = [n // k + (f < n % k) for f in range(k)]
            open_cuts = [(f, 0, sum(sizes[:f])) for f in range(1, k) if sizes[f]]
            cuts = {f: 1 << MIX_BITS for f in range(1, k) if not sizes[f]}
        known += step
        narrowed = []
        for f, prefix, rank in open_cuts:
            for b, c in counts[prefix]:
                if rank < c:
                    narrowed.append((f, b, rank, c))
                    break
                rank -= c
        open_cuts = [(f, b, rank) for f, b, rank, c in narrowed]
        if known == MIX_BITS or all(c <= FEW for *_, c in narrowed):
            rest = MIX_BITS - known
            values: dict[int, list[int]] = {}
            if rest and open_cuts:
                wanted = sorted({b for _, b, _ in open_cuts})  # at most FEW rows in each
                for r in ids.where(F.shiftright("m", rest).isin(wanted)).orderBy("m").collect():
                    values.setdefault(r["m"] >> rest, []).append(r["m"])
            cuts |= {f: values[b][rank] if rest else b for f, b, rank in open_cuts}
            open_cuts = []
    return [cuts[f] for f in range(1, k)]


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """``df`` with a ``fold`` from 0 to k - 1 in blocks of the shuffled rows, as a shuffled k-fold split cuts them: sizes
    differ by one at most (rows of one id stay together, which can add their number)."""
    cuts = fold_cuts(df, k, seed, id_col)
    m = mix(F.col(id_col), seed)
    return df.withColumn("fold", sum([F.when(m >= F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0)).cast("int"))


def explode_training_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Each row (with its ``fold``) once per fold that trains on it (fold != own),
    so per-fold statistics are one group-by over (fold, key) instead of k jobs."""

    return df.withColumnRenamed("fold", "__own").withColumn(
        "fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                                   lambda f: f != F.col("__own")))).drop("__own")
