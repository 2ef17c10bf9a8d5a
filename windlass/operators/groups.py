"""Group-wide values and ranks that hold up when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.operators.ordering import dense_index
from windlass.session import cut_lineage

# Groups above this many rows are numbered over many tasks instead of one window.
HOT_GROUP_ROWS = 5_000_000
# Hash slots, least and most, in which rows are counted before keys are.
COUNT_SLOTS = (1 << 12, 1 << 20)


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregate per key (map-side combined) and join the result back.

    The join leaves AQE free to broadcast a small result or to split a hot
    key, which a whole-group window cannot do.
    """
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))


def hot_groups(
    source: DataFrame, keys: Sequence[str], limit: int = HOT_GROUP_ROWS
) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. A table of no more rows, which
    its files tell, has no such key. Else rows are counted by the key's hash slot
    first: only a slot above the limit can hold such a key, and keys are shuffled
    and counted in these slots alone."""
    rows = source.count()
    if rows <= limit:
        return None
    least, most = COUNT_SLOTS
    slots = min(most, max(least, 8 * rows // max(1, limit)))
    placed = source.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(slots)))
    full = cut_lineage(placed.groupBy("_slot").agg(F.count("*").alias("_n"))
                       .filter(F.col("_n") > limit).select("_slot"))
    if full.isEmpty():
        return None
    hot = placed.join(full, "_slot", "left_semi").groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return None if hot.isEmpty() else hot


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    tiebreak: Sequence[str] = (),
    descending: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Competition rank by `value`, then `tiebreak` ascending, within `keys`.

    With a unique tiebreak this is row_number; NULLs stand where a window puts
    them. `hot` (from hot_groups) names the keys whose rows are too many for
    one window: these are range-partitioned by key, value and tiebreak and
    numbered throughout, and a row's rank is the least number of its equals
    less that of its group. Any type sorts, and nothing is capped.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    order += [F.col(c).asc() for c in tiebreak]
    keys = list(keys)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))

    if hot is None:
        return plain(df)

    cold_rows = df.join(hot, keys, "left_anti")
    hot_rows = df.join(hot.select(*keys), keys, "left_semi")
    points = [*keys, value, *tiebreak]
    placed = dense_index(hot_rows, [*keys, *order], "_at")
    ranked = placed
    for name_, cols in (("_tie", points), ("_first", keys)):
        least = placed.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)]).agg(
            F.min("_at").alias(name_))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cols)]
        ranked = ranked.join(least, same).drop(*[f"_k{i}" for i in range(len(cols))])
    rank = (F.col("_tie") - F.col("_first") + 1).cast("int").alias(name)
    return plain(cold_rows).unionByName(ranked.select(*df.columns, rank))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """Best k rows per group. Catalyst limits each group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
