"""SparkSession construction and the shared scratch location.

On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
lineage cuts, fitted tables and stream checkpoints live below it.  Only when
that setting is absent (local tests) a private temporary folder is created.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "zonecast") -> SparkSession:
    """Return the active session or build one with the engine defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    driver_mem = os.environ.get("ZONECAST_DRIVER_MEMORY")
    if driver_mem:
        builder = builder.config("spark.driver.memory", driver_mem)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Where it is unset a local master gets a private temporary folder; any
    other master is refused, since each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="zonecast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for one artefact."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session whose cluster does not have it installed."""
    import shutil
    from pathlib import Path
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        at = Path(__file__).resolve().parent
        if at.is_dir():
            folder = tempfile.mkdtemp()
            spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{at.name}", "zip", at.parent, at.name))


def scratch_name(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Names ``version`` as the one to read below ``path``: a small table of its own, greater in number than those before."""
    n = max(_manifests(spark, path, whole=False), default=0) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{path}/manifest-{n:08d}")


def published(spark: SparkSession, path: str) -> str:
    """The version that was published last below ``path``; none is an error."""
    found = _manifests(spark, path)
    if not found:
        raise FileNotFoundError(f"no published version in {path}")
    return spark.read.schema("version string").parquet(f"{path}/manifest-{max(found):08d}").first()["version"]


def _manifests(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Numbers of the manifests below ``path``: with ``whole``, those that were written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = lambda f: not whole or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return [int(f.getPath().getName().split("-")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("manifest-") and done(f)]


#: Partitions a core of rows that are dealt anew.
SPREAD_PARTITIONS = 4


def spread(df):
    """``df`` dealt evenly over the cluster, for work that costs far more a row than reading it: a table of few files or
    row groups, or an aggregate that was coalesced, would leave that work to a few tasks."""
    return df.repartition(SPREAD_PARTITIONS * df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df, path: str):
    """Write ``df`` as a parquet table in the shared folder and read it back:
    a lineage cut that survives executor loss and keeps column pruning for
    every later pass (unlike an in-memory cache of all columns)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
