"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from threading import local
from urllib.parse import urlparse

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Page parsing turns few bytes into much work: keep small partitions apart.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Let AQE split a hot join key even when that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# For the named queries only, not the corpus operators.
QUERY_SETTINGS = {
    # Join by hash where each partition of the smaller side is small: spares the sorts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Shuffle files go when their job has ended; a later re-run writes them again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "windlass", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go away with the last reference to their table.
    clean = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**SETTINGS, **clean, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession, query: bool = False) -> None:
    """Set the SQL settings the queries rely on in a session made elsewhere; those of
    QUERY_SETTINGS for a named `query`, else they are taken back."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in QUERY_SETTINGS.items():
        if query:
            spark.conf.set(key, value)
        else:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster. Where it is unset, as in tests, a folder
    of this program in the session's warehouse. On a cluster that is refused when
    the warehouse is a folder of the driver's machine, which executors cannot see."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not context.getCheckpointDir():
            context.setCheckpointDir(current)
        return context.getCheckpointDir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not context.master.startswith("local") and urlparse(warehouse).scheme in ("", "file"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{warehouse}/scratch-{uuid.uuid4().hex}"
    _delete_at_exit(spark, own)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: survives executor loss, ends the
    plan's history. Compressed and read by column, where a checkpoint holds whole
    rows as they are in memory."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MADE = local()


def cut_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """`cut_lineage(make())`, after which the tables that `make` stored on the way are
    deleted. What it returns must be all that is read of them later."""
    outer, _MADE.paths = getattr(_MADE, "paths", None), []
    try:
        rows = make()
        inner, _MADE.paths = _MADE.paths, []
        kept = cut_lineage(rows)
        for path in inner:
            drop_scratch(spark, path)
        return kept
    finally:
        if outer is not None:
            outer += _MADE.paths
        _MADE.paths = outer


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    if getattr(_MADE, "paths", None) is not None:
        _MADE.paths.append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the program ends, also after the session was stopped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def delete() -> None:
        try:
            target.getFileSystem(conf).delete(target, True)
        except Py4JError:
            pass  # the JVM has ended before this program

    atexit.register(delete)
