"""Session creation and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "peerscope",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench.

    On a cluster the session is created by the launcher and reused here;
    only local runs get the settings below.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is also the only executor
            builder = builder.config("spark.driver.memory",
                                     os.environ.get("PEERSCOPE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    event_log = os.environ.get("PEERSCOPE_EVENT_LOG")
    if event_log:
        # stage and task times without the web UI: read the JSON event log
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting). Only when neither is set and the
    master is local, as in a bare test session, a private folder is
    created; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="peerscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used for small, reused intermediate tables (the vocabulary) so that a
    lost executor does not force the whole corpus scan to be replayed.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    for made in _SCOPES:
        made.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the scratch tables that are made inside when the block ends."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            drop_path(spark, path)


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    For tables that grow with the corpus and are read several times: columnar,
    compressed, and a lost executor only repeats the readers' tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder on any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
