"""A table as a stream: one file, a folder of parts, a partitioned folder; stop and resume."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from zonecast.plans import catalog
from zonecast.sources import observations
from zonecast.streaming.scoring import observation_stream, require_all_rows, table_stream


def run(stream, folder):
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def laid_out(spark, layout, folder):
    at = folder / "events.parquet"
    if layout == "file":
        shutil.copy(f"{SMALL}/events.parquet", at)
        (folder / "events_old.parquet").mkdir()  # neither a like-named table nor another is read
        spark.range(5).write.parquet(str(folder / "other.parquet"))
        return
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    if layout == "parts":
        events.repartition(7).write.parquet(str(at))
    else:
        events.withColumn("bucket", F.pmod(F.xxhash64(*events.columns), F.lit(3))).write.partitionBy("bucket").parquet(str(at))


@pytest.mark.parametrize("layout", ["file", "parts", "partitioned"])
def test_stream_reads_the_table_in_any_layout(spark, tmp_path, layout):
    laid_out(spark, layout, tmp_path)
    want = sorted(map(repr, observations(spark, SMALL).collect()))
    out = tmp_path / "out"
    stream = observation_stream(spark, str(tmp_path))
    run(stream, out)
    assert sorted(map(repr, spark.read.schema(stream.schema).parquet(f"{out}/data").collect())) == want
    if layout == "parts":
        rows = sorted(map(repr, catalog.q_stream_encode(spark, str(tmp_path)).collect()))
        assert rows == sorted(map(repr, catalog.q_stream_encode(spark, SMALL).collect()))


def test_stopped_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    laid_out(spark, "parts", tmp_path)
    table, out = tmp_path / "events.parquet", tmp_path / "out"
    stream = lambda: table_stream(spark, str(table))
    query = (stream().writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
             .trigger(processingTime="1 hour").start())
    while not query.recentProgress:  # one batch of one file, then it is stopped
        time.sleep(0.2)
    query.stop()
    first = spark.read.parquet(f"{out}/data").count()
    want = spark.read.parquet(str(table))
    assert 0 < first < want.count()
    with pytest.raises(RuntimeError, match="the stream wrote"):
        require_all_rows(want, spark.read.parquet(f"{out}/data"))
    run(stream(), out)
    want.limit(10).write.mode("append").parquet(str(table))  # a file that arrives later
    run(stream(), out)
    run(stream(), out)  # nothing new
    got = require_all_rows(spark.read.parquet(str(table)), spark.read.parquet(f"{out}/data"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.read.parquet(str(table)).collect()))
