"""Operator 4: exact top-k inner products by block-at-a-time pruning.

Vectors of integers lie in blocks of ``BLOCK`` rows; a block keeps the greatest and the least value of each
term (dimension) and a forward index, the rows themselves.  For each query the blocks of a shard
are ordered by their bound, the sum over terms of the query's weight times the term's greatest value
(least, for a negative weight); blocks are scored in that order until their bounds fall
below the query's k-th score.  Shards give their k best, and a last ranking merges them.

* Vectors near one pivot (of a fixed number, chosen by id hash) are stored together, so
  that a block's maxima are tight.  The pivots only order the rows; every row is indexed.
* Queries and rows meet block by block: a shard of ``SHARD`` rows and ``QUERIES`` queries a task, so neither side is broadcast.

Ties go to the smaller id: a block whose bound equals the k-th score is skipped only if its smallest
id is greater than the k-th's.  Defined cases: vectors that are NULL, hold NULL or non-finite components,
or have a NULL id take no part; so do those of another length than most others' (the most frequent,
the longest on a tie); repeated ids each take a rank; a query meets every row but those of its own id; a query row that
is repeated is asked once, and two different vectors of one query id are two queries with ranks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonecast.llm.common import batches, written

K = 10
SCALE = 1024
BLOCK, SHARD, QUERIES, PIVOTS = 64, 16_384, 2_048, 64


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, v (array<long>)``: floor(SCALE * x) of the vectors that take part."""
    x = F.col("v")
    raw = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & x.isNotNull())
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return raw.where((F.size(x) > 0) & F.coalesce(finite, F.lit(False))).select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros(len(rows), np.int64)
    p = pivots.astype(float)
    return np.argmin((p * p).sum(1) - 2 * rows.astype(float) @ p.T, 1)


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """The index: ``shard, ids, rows`` with BLOCK rows a record, sorted by nearest pivot and id.  A
    shard is what one task holds of a range of (pivot, id)."""
    spark = vectors.sparkSession
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()  # a fixed number
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in picked], np.int64).reshape(-1, dims))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            near = _nearest(_matrix(b.column(1), dims), pivots.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=["id", "v", "pivot"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.binary()), ("rows", pa.binary())])

        def parts() -> Iterator[tuple]:
            for b in it:
                ids, rows = b.column(0).to_numpy(), _matrix(b.column(1), dims)
                for lo in range(0, len(ids), BLOCK):
                    yield ids[lo:lo + BLOCK].tobytes(), rows[lo:lo + BLOCK].tobytes()

        yield from batches(parts(), schema, 256)

    n = vectors.count()
    ranged = (vectors.mapInArrow(place, "id long, v array<long>, pivot long").repartitionByRange(max(1, -(-n // SHARD)), "pivot", "id")
              .sortWithinPartitions("pivot", "id").select("id", "v"))
    made = ranged.mapInArrow(cut, "ids binary, rows binary")
    return written(made.withColumn("shard", F.spark_partition_id()), "search-blocks")


def search_shard(ids: list[np.ndarray], rows: list[np.ndarray], q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(number of the query, vector id, score) of each query's k best in a shard, and how they were found is exact."""
    top = np.stack([r.max(0) for r in rows])
    low = np.stack([r.min(0) for r in rows])
    first = np.array([i.min() for i in ids])
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    for number, (own, weights, bound) in enumerate(zip(q_ids.tolist(), q, bounds)):
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in np.lexsort((first, -bound)).tolist():
            if len(best_s) == k and bound[at] <= best_s[-1]:
                if bound[at] < best_s[-1]:
                    break
                if first[at] > best_i[-1]:
                    continue
            other = ids[at] != own
            s, i = np.concatenate([best_s, (rows[at] @ weights)[other]]), np.concatenate([best_i, ids[at][other]])
            keep = np.lexsort((i, -s))[:k]
            best_s, best_i = s[keep], i[keep]
        for s, i in zip(best_s.tolist(), best_i.tolist()):
            yield number, i, s


def top_k(table: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each distinct row of ``queries`` (same columns) against all of ``table``."""
    vectors = written(integer_vectors(table, id_col, vec_col), "search-vectors")
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    dims = sizes[0]["d"] if sizes else 1
    vectors = vectors.where(F.size("v") == dims)
    index = blocks(vectors, dims)
    asked = integer_vectors(queries, id_col, vec_col).where(F.size("v") == dims).distinct()
    packs = max(1, -(-asked.count() // QUERIES))
    last = index.agg(F.max("shard")).first()[0] or 0  # shards are numbered from 0, one a SHARD of rows
    number = F.pmod(F.xxhash64("id", "v"), F.lit(packs)).cast("int")
    # tells several vectors of one id apart
    key = F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary")))
    ask = asked.select("id", "v", key.alias("key"), number.alias("pack")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    side = ask.select("shard", "pack", F.struct("id", "v", "key").alias("q"), F.lit(None).cast("struct<ids:binary,rows:binary>").alias("b"))
    held = index.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).select(
        "shard", "pack", F.lit(None).cast("struct<id:bigint,v:array<bigint>,key:binary>").alias("q"), F.struct("ids", "rows").alias("b"))
    tasks = side.union(held).groupBy("shard", "pack").agg(F.collect_list("q").alias("q"), F.collect_list("b").alias("b"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for qs, bs in zip(b.column(0), b.column(1)):
                qs, bs = qs.as_py(), bs.as_py()
                if qs and bs:
                    ids = [np.frombuffer(x["ids"], np.int64) for x in bs]
                    rows = [np.frombuffer(x["rows"], np.int64).reshape(-1, dims) for x in bs]
                    q_ids, q = np.array([x["id"] for x in qs], np.int64), np.array([x["v"] for x in qs], np.int64)
                    keys = [x["key"] for x in qs]
                    yield from batches(((int(q_ids[j]), keys[j], i, s) for j, i, s in search_shard(ids, rows, q_ids, q, k)), found)

    found = pa.schema([("query_id", pa.int64()), ("key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])
    local = tasks.select("q", "b").mapInArrow(run, "query_id long, key binary, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(table: str = "embeddings", every: int = 100, k: int = K) -> str:
    """The same ranking by brute force in DuckDB SQL."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % {every} = 0) q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
