"""Histograms with the normal curve of the same mean and spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.rating_math import normal_pdf


def normal_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """keys.., bin (0..bins-1), start, width, n, expected.

    Bins are equal parts of a group's range, the last one closed; empty ones have
    a row. `expected` is the group's size times the width and the density in the
    bin's middle, NULL where all values are equal. NULL values are left out.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    fit = known.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"),
        F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    place = F.floor((F.col(value) - F.col("_low")) / span * bins)
    counted = known.join(fit, keys).groupBy(
        *keys, F.when(F.col("_high") == F.col("_low"), 0)
        .otherwise(F.least(place.cast("int"), F.lit(bins - 1))).alias("bin")
    ).agg(F.count("*").alias("n"))
    width = (F.col("_high") - F.col("_low")) / bins
    grid = fit.withColumn("width", width).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    middle = F.col("_low") + (F.col("bin") + 0.5) * F.col("width")
    density = normal_pdf(middle, F.col("_mean"), F.nullif(F.col("_sd"), F.lit(0.0)))
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_low") + F.col("bin") * F.col("width")).alias("start"), "width",
        F.coalesce("n", F.lit(0)).alias("n"), (F.col("_n") * F.col("width") * density).alias("expected"))
