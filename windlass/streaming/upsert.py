"""Results that arrive in files over time: keep-last upsert per season.

Unofficial results are fetched again and replace their earlier version. A
micro-batch rewrites only the seasons it touches, and merging a batch twice
gives the same table, so a restarted stream needs nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from windlass.operators.dedup import keep_last
from windlass.session import cut_lineage


def result_stream(spark: SparkSession, path: str, schema: T.StructType,
                  files_per_batch: int = 100) -> DataFrame:
    """JSON result files as they appear, oldest first, with their arrival time."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
        .withColumn("fetched", F.col("_metadata.file_modification_time"))
    )


def merge_batch(batch: DataFrame, store: str, keys: Sequence[str], order: Sequence[str],
                partition: str) -> None:
    """Merge one batch into the parquet table at `store`."""
    spark = batch.sparkSession
    latest = cut_lineage(keep_last(batch, keys, [F.col(c) for c in order]))
    # Seasons follow the calendar, so this list is short.
    touched = [r[0] for r in latest.select(partition).distinct().collect()]
    if not touched:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    merged = latest
    if fs.exists(path):
        stored = spark.read.schema(latest.schema).parquet(store).filter(
            F.col(partition).isin(touched)
        )
        # A late file must not replace a newer result; on a tie the batch wins.
        both = keep_last(
            stored.withColumn("_new", F.lit(False)).unionByName(
                latest.withColumn("_new", F.lit(True))),
            keys, [*[F.col(c) for c in order], F.col("_new")],
        ).drop("_new")
        # The table is both read and written: settle the result first.
        merged = cut_lineage(both)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).parquet(store)


def start_upsert(stream: DataFrame, store: str, checkpoint: str, keys: Sequence[str],
                 order: Sequence[str], partition: str = "season",
                 until_done: bool = False) -> StreamingQuery:
    """Start the stream; `until_done` processes what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: merge_batch(batch, store, keys, order, partition)
    )
    return (writer.trigger(availableNow=True) if until_done else writer).start()
