"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.session import apply_settings, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Whole texts travel to Python in batches; a batch is bounded in rows and bytes.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> None:
    apply_settings(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this package, with its DuckDB form if there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, row_check: int | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage,
    survives lost executors, and lets joins on it be split when skewed. Rows of
    megabytes need a `row_check`: their size is looked at after so many."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20)
    if row_check:
        writer = writer.option("parquet.page.size.row.check.min", row_check)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As `materialise`, bucketed by a key: later joins on it leave it in place."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    label = path.rsplit("/", 1)[-1].replace("-", "_")
    (df.repartition(buckets, key).write.format("parquet").option("compression", "zstd")
     .option("parquet.block.size", 16 << 20).option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(label))
    atexit.register(_forget, spark, label)
    return spark.table(label)


def _forget(spark: SparkSession, label: str) -> None:
    """Drop a scratch table's catalog entry; its files go with the scratch folder."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {label}")
    except (Py4JError, PySparkException):
        pass  # the session has ended before this program


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_HELD: dict = {}
HELD_OBJECTS = 3


def held(key: object, build: Callable[[], object] | None = None):
    """What this Python process keeps between batches, built on first use. A
    process serves several operators: what was used longest ago goes, and all of
    it before an operator that needs memory but keeps nothing (no `build`)."""
    if key in _HELD:
        _HELD[key] = _HELD.pop(key)
    else:
        while len(_HELD) >= (HELD_OBJECTS if build else 1):
            del _HELD[next(iter(_HELD))]
        _HELD[key] = build() if build else None
    return _HELD[key]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
