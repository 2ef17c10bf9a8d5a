"""Cross-region exposure of race entries, from counts instead of a self join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_REGION = "?"


def merge_regions(df: DataFrame, alias: dict[str, str], col: str = "region") -> DataFrame:
    """Treat some regions as one (a small fixed map)."""
    return df.replace(alias, subset=[col]) if alias else df


def exposure(entries: DataFrame, race_keys: list[str], spread: bool = True) -> DataFrame:
    """Adds `is_cross` (0/1), `out_links` and `field` (entries of the race).

    is_cross: the race has more than one region, a missing one counted as a
    region of its own. out_links: rivals from another known region, which is
    (entries with a region) - (entries with mine), and 0 when mine is missing.
    With `spread` counts are joined back, which holds for races of any size;
    else they are windows over the race, one shuffle in place of three.
    """
    tagged = entries.withColumn("_region", F.coalesce("region", F.lit(NO_REGION)))
    cross = F.when(F.col("_regions") > 1, 1).otherwise(0)
    links = F.when(
        (F.col("_regions") > 1) & (F.col("_region") != NO_REGION), F.col("_known") - F.col("_same")
    ).otherwise(F.lit(0))
    if not spread:
        race, mine = Window.partitionBy(*race_keys), Window.partitionBy(*race_keys, "_region")
        apart = F.min("_region").over(race) != F.max("_region").over(race)
        joined = tagged.filter(" and ".join(f"{k} is not null" for k in race_keys)).withColumns({
            "field": F.count("*").over(race), "_regions": F.when(apart, 2).otherwise(1),
            "_known": F.count_if(F.col("_region") != NO_REGION).over(race),
            "_same": F.count("*").over(mine),
        })
        return joined.withColumn("is_cross", cross).withColumn(
            "out_links", links.cast("long")
        ).drop("_region", "_regions", "_known", "_same")
    # Counts by region travel as one small map per race: one join, not two.
    per_race = (
        tagged.groupBy(*race_keys, "_region").agg(F.count("*").alias("_same"))
        .groupBy(*race_keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_region", "_same"))).alias("_by_region"),
            F.count("*").alias("_regions"), F.sum("_same").alias("field"),
            F.coalesce(F.sum(F.when(F.col("_region") != NO_REGION, F.col("_same"))), F.lit(0))
            .alias("_known"),
        )
    )
    joined = tagged.join(per_race, race_keys).withColumn(
        "_same", F.element_at("_by_region", F.col("_region"))).drop("_by_region")
    return joined.withColumn("is_cross", cross).withColumn(
        "out_links", links.cast("long")
    ).drop("_region", "_regions", "_known", "_same")
