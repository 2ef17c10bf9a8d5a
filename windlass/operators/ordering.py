"""Processing order of races, and scans along it.

Order: regattas by their first race, races within a regatta by their first
row, both by (date, race number, division), NULL last. The order is carried
as a dense number `seq`; nothing relies on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.session import cut_lineage

# Races per chunk of a scan: bounds the rows one (key, chunk) group can hold.
CHUNK_RACES = 1_000_000


def _sort_key(*cols: str) -> Column:
    """Struct that compares like (a nulls last, b nulls last, ...)."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c)]
    return F.struct(*parts)


def race_table(
    log: DataFrame, date: str = "date", number: str = "race_no", division: str = "div",
) -> DataFrame:
    """One row per (regatta, race) with its order keys. Rows without a key are
    left out, as a grouping drops them."""
    firsts = (
        log.filter(F.col("regatta").isNotNull() & F.col("race").isNotNull()
                   & F.col(date).isNotNull())
        .groupBy("regatta", "race")
        .agg(F.min(_sort_key(date, number, division)).alias("race_key"),
             F.count("*").alias("entries"))
    )
    # Stored: read by the join below and by each pass of the numbering.
    firsts = cut_lineage(firsts)
    regattas = cut_lineage(
        firsts.groupBy("regatta").agg(F.min("race_key").alias("regatta_key")))
    return firsts.join(regattas, "regatta")


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """0,1,2,... along `order` without a single-task sort.

    Rows are range-partitioned and written once (a later re-run must see the
    same cut points); each partition is numbered and shifted by the sizes of
    the partitions before it.
    """
    sorted_rows = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: a single-task window over it is bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_mono") - F.shiftleft(F.col("_part"), 33)
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset"))
        .drop("_part", "_mono", "_offset")
    )


def race_order(log: DataFrame, **cols: str) -> DataFrame:
    """(regatta, race, seq, regatta_seq): regatta_seq is its first race's seq."""
    races = dense_index(
        race_table(log, **cols), ["regatta_key", "regatta", "race_key", "race"]
    ).select("regatta", "race", "seq", "entries")
    starts = races.groupBy("regatta").agg(F.min("seq").alias("regatta_seq"))
    return races.join(starts, "regatta")


def latest_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    chunk: Column | None = None,
    inclusive: bool = True,
    suffix: str = "",
    spread: bool = True,
) -> DataFrame:
    """Last non-null of each value column along `order` within `keys`.

    A two-level scan: rows are scanned inside (key, chunk) groups of bounded
    size, the chunk results are scanned per key, and the carry is joined in.
    `chunk` must not decrease along `order`; default is seq / CHUNK_RACES. Where no
    key has very many rows (not `spread`), one scan within keys does.
    """
    keys = list(keys)
    bound = Window.currentRow if inclusive else -1
    kept = [c for c in df.columns if c not in values or suffix]
    if not spread:
        running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, bound)
        return df.select(*kept, *[
            F.last(v, ignorenulls=True).over(running).alias(f"{v}{suffix}") for v in values])
    chunk = F.floor(F.col("seq") / CHUNK_RACES) if chunk is None else chunk
    rows = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    running = inner.rowsBetween(Window.unboundedPreceding, bound)
    scanned = rows
    for v in values:
        scanned = scanned.withColumn(f"_in_{v}", F.last(v, ignorenulls=True).over(running))
    stamp = F.struct(*order)
    ends = rows.groupBy(*keys, "_chunk").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), stamp)).alias(v) for v in values]
    )
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = ends.select(
        *keys, "_chunk",
        *[F.last(v, ignorenulls=True).over(outer).alias(f"_carry_{v}") for v in values],
    )
    joined = scanned.join(carry, [*keys, "_chunk"], "left")
    out = [
        F.coalesce(f"_in_{v}", f"_carry_{v}").alias(f"{v}{suffix}") for v in values
    ]
    return joined.select(*kept, *out)
