"""Table comparison: column-wise differences, anti joins, normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(col: Column) -> Column:
    return F.lower(F.trim(col))


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def row_differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fold_text: bool = False
) -> DataFrame:
    """Rows present on both sides that differ, one diff_<column> flag each."""
    cols = [c for c in shared_columns(left, right) if c not in keys]
    joined = left.alias("l").join(right.alias("r"), list(keys))

    def side(s: str, c: str) -> Column:
        column = F.col(f"{s}.{c}")
        return normalised(column.cast("string")) if fold_text else column

    flags = {c: ~side("l", c).eqNullSafe(side("r", c)) for c in cols}
    return joined.filter(reduce(lambda a, b: a | b, flags.values())).select(
        *keys, *[flag.alias(f"diff_{c}") for c, flag in flags.items()]
    )


def rows_not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` absent from `right`, NULLs equal, copies kept."""
    other = right.select(*left.columns).distinct().alias("r")
    matches = reduce(
        lambda a, b: a & b,
        [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in left.columns],
    )
    return left.alias("l").join(other, matches, "left_anti")


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (one aggregate job)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])
