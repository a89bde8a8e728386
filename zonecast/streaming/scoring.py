"""Stateless stream scoring.

``readStream`` over the event files -> the ``obs`` adapter projection ->
score-time cleaning with the fitted medians (literals) -> stream-static joins
with the fitted zone / prefix tables (size-checked broadcast) -> the three
member pipelines -> blends -> parquet sink with a checkpoint in the shared
folder.  ``geo_density`` uses the fitted maximum (a stream has no whole-frame
max).  No state is kept, so no watermark is needed; restarts resume from the
checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import cleaning
from zonecast.session import scratch_dir, spread
from zonecast.sources.adapter import adapter_sql, observations


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The rows of a parquet table as a stream, whether ``path`` is one file, a folder of part files or a partitioned
    folder.  The schema is the table's; files that arrive later are read as well, and the query's checkpoint
    keeps which files it has read."""
    path = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if folder:
        return reader.parquet(path)
    parent, name = path.rsplit("/", 1)  # a file source takes folders: the one file of its name there
    return reader.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(parent)


def observation_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Adapter rows as a stream over the events table of ``sf_dir``."""
    import uuid
    view = f"zc_events_stream_{uuid.uuid4().hex[:8]}"
    table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", files_per_trigger).createOrReplaceTempView(view)
    return spark.sql(adapter_sql().replace("FROM events", f"FROM {view}"))


def require_all_rows(batch: DataFrame, sink: DataFrame) -> DataFrame:
    """``sink`` if it holds as many rows as the batch read of what was streamed; anything else is an error."""
    want, got = batch.count(), sink.count()
    if want != got:
        raise RuntimeError(f"the stream wrote {got} rows, the table has {want}")
    return sink


def observation_file_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                            files_per_trigger: int = 100) -> DataFrame:
    """A live feed of observation files (parquet, or CSV with header) landing in
    ``path``; the schema is fixed up front (no inference on a stream; CSV columns go by header name)."""
    from zonecast.schema import OBS_SCHEMA
    if fmt == "csv":
        from zonecast.sources.readers import stream_observations_csv
        return stream_observations_csv(spark, path, files_per_trigger)
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(OBS_SCHEMA).parquet(path)


def score_observations(stream: DataFrame, ensemble, medians: cleaning.Medians) -> DataFrame:
    """Any streaming (or batch) observation frame -> member and blend scores."""
    scored = ensemble.score(cleaning.clean(stream, medians), density_scope="fitted")
    return scored.select("row_id", "day", "pred_cat", "pred_lgb", "pred_xgb",
                         "pred_ensemble_blend", "pred_ensemble_trio")


def start_scoring(stream: DataFrame, ensemble, medians: cleaning.Medians, sink_dir: str,
                  checkpoint_dir: str, every: str = "1 minute"):
    """Long-running scoring query (micro-batch every ``every``); returns the
    StreamingQuery.  Parquet sink + checkpoint give exactly-once files."""
    return (score_observations(stream, ensemble, medians).writeStream
            .format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir)
            .outputMode("append").trigger(processingTime=every).start())


def scored_stream(spark: SparkSession, sf_dir: str, ensemble, medians: cleaning.Medians
                  ) -> DataFrame:
    obs = observation_stream(spark, sf_dir)
    fresh = obs.where(~F.col("is_train")).drop("is_train")
    scored = ensemble.score(cleaning.clean(spread(fresh), medians), density_scope="fitted")
    return scored.select("row_id", "day", "pred_cat", "pred_lgb", "pred_xgb", "pred_ensemble_blend",
                         "pred_ensemble_trio")


def score_stream_once(spark: SparkSession, sf_dir: str, ensemble, medians: cleaning.Medians,
                      out_dir: str | None = None) -> DataFrame:
    """Process everything available now, then return the sink as a table."""
    out = out_dir or scratch_dir(spark, "stream-scores")
    query = (scored_stream(spark, sf_dir, ensemble, medians).writeStream
             .format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    fresh = observations(spark, sf_dir).where(~F.col("is_train")).select("is_train")
    return require_all_rows(fresh, spark.read.parquet(f"{out}/data"))
