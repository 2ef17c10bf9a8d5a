"""Keep-first / keep-last / duplicate flags as mergeable aggregates.

Aggregates combine on the map side, so a key with very many copies never
gathers in one task as it would under a row_number window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], best) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(
        *keys, F.struct(*order).alias("_order"), F.struct(*rest).alias("_row")
    )
    chosen = packed.groupBy(*keys).agg(best("_row", "_order").alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the greatest `order`."""
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `batch` replace rows of `base` with the same key."""
    kept = base.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def duplicated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once (all copies kept)."""
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1).drop("count")
    return df.join(repeated, list(keys), "left_semi")
