"""Sums over all rivals of each racer, for a race too large for one task.

The field is cut into chunks; every task meets one chunk with another and
returns one partial sum per racer, which are then added up. Pairs exist only
inside numpy blocks and are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (racers of one chunk, rivals of another) -> partial sums, one row per racer.
Partial = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def rival_sums(
    field: DataFrame, race_keys: Sequence[str], racer: str, inputs: Sequence[str],
    partial: Partial, sums: Sequence[str], chunk_rows: int,
) -> DataFrame:
    """race_keys, racer and the summed columns of `partial` over the field."""
    keys = list(race_keys)
    sizes = field.groupBy(*keys).agg(
        F.ceil(F.count("*") / chunk_rows).cast("int").alias("_chunks")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    rows = field.select(*keys, racer, *[c for c in inputs if c != racer]).join(sizes, keys)
    mine = F.pmod(F.xxhash64(F.col(racer).cast("string")), F.col("_chunks")).cast("int")
    groups = [*keys, "_i", "_j"]
    own = rows.withColumn("_i", mine).withColumn("_j", every).groupBy(*groups)
    other = rows.withColumn("_j", mine).withColumn("_i", every)
    # Fresh names, so the two sides of the cogroup are told apart.
    rivals = other.select(*[F.col(c).alias(f"_r{c}") for c in other.columns]).groupBy(
        *[f"_r{g}" for g in groups]
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, racer, *sums])
        right = right.rename(columns=lambda c: c[2:])
        return pd.concat([left[[*keys, racer]].reset_index(drop=True), partial(left, right)], axis=1)

    types = dict(field.dtypes)
    schema = ", ".join(
        [f"{c} {types[c]}" for c in [*keys, racer]] + [f"{c} double" for c in sums]
    )
    met = own.cogroup(rivals).applyInPandas(meet, schema)
    return met.groupBy(*keys, racer).agg(*[F.sum(c).alias(c) for c in sums])
