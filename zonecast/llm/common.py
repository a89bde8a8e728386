"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.session import scratch_dir, ship

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return:
#: exactly what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark's setting that a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lineage cut that survives lost
    executors.  zstd because the tables are read at most a few times.  The write's shuffle files go with its end; else
    those of all steps lie on the disks until the driver happens to collect garbage."""
    spark = df.sparkSession
    ship(spark)
    path, before = scratch_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no later step reads, to free the shared folder."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; NULL becomes empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def text_buffer(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array and the n + 1 offsets into it; NULL becomes empty."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], "<i8")[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]] if len(col) else data[:0], offsets - offsets[0]


def portions(it: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts have about ``limit`` bytes (a longer text comes alone), so
    that work arrays of several times a run's size stay small."""
    for b in it:
        col = b.column(b.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")), at + 1)
            yield b.slice(at, upto - at)
            at = upto
        del b, col
        pa.default_memory_pool().release_unused()  # workers live on: give a finished batch's memory back


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Integer sums of ``values`` over the segments that ``offsets`` bounds (exact, so a document's
    sum does not depend on the batch it lies in)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def batches(rows: Iterator, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """The id and text (and ``extra``) columns of a documents table, ids as long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(f"`{c}`") for c in extra])
