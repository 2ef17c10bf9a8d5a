"""Per-race history: changes, rating snapshots, regatta averages, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.rating_math import DEFAULT, RatingParams, ordinal
from windlass.operators.exposure import exposure, merge_regions
from windlass.operators.groups import attach, hot_groups
from windlass.operators.ordering import latest_before
from windlass.plans.unify import POOLS


def finish_ratio(entries: DataFrame, race_keys: list[str]) -> DataFrame:
    """1 for the winner, 0 for last; below 0 when a score exceeds the field."""
    known = "field" in entries.columns
    sized = entries if known else attach(entries, race_keys, F.count("*").alias("field"))
    return sized.withColumn(
        "ratio", 1 - F.try_divide(F.col("score") - 1, F.col("field") - 1)
    )


def changes(rated: DataFrame, params: RatingParams = DEFAULT) -> DataFrame:
    """Displayed rating after each race and its change."""
    after = ordinal(F.col("mu1"), F.col("sigma1"), params)
    before = ordinal(F.col("mu0"), F.col("sigma0"), params)
    return rated.withColumns({"rating": after, "change": after - before})


def snapshots(
    events: DataFrame, value: str = "rating", initial: float = DEFAULT.target,
    chunk=None, spread: bool = True,
) -> DataFrame:
    """All eight ratings of a sailor as of each event.

    events: key, pool, seq, step, value. step orders rows inside a race
    (skippers are rated before crews). `spread` as for `latest_before`.
    """
    # Dealt out before a value becomes eight columns.
    dealt = events if spread else events.repartition("key")
    own = dealt.withColumns(
        {p: F.when(F.col("pool") == p, F.col(value)) for p in POOLS}
    )
    filled = latest_before(own, ["key"], ["seq", "step"], POOLS, chunk=chunk, spread=spread)
    return filled.withColumns({p: F.coalesce(p, F.lit(initial)) for p in POOLS})


def regatta_average(
    people: DataFrame, events: DataFrame, value: str = "rating",
    initial: float = DEFAULT.target, chunk=None, spread: bool = True,
) -> DataFrame:
    """Mean rating of a regatta's people as of its first race.

    people: regatta, regatta_seq, pool, key (repeats count). events: pool,
    key, seq, value. An empty regatta has no row rather than a division by 0.
    """
    asked = people.groupBy("regatta", "regatta_seq", "pool", "key").agg(
        F.count("*").alias("copies")
    ).select(
        "pool", "key", F.col("regatta_seq").alias("seq"), F.lit(-1).alias("step"),
        F.lit(None).cast("double").alias(value), "regatta", "copies",
    )
    known = events.select(
        "pool", "key", "seq", F.lit(0).alias("step"), F.col(value).cast("double").alias(value)
    )
    both = known.unionByName(asked, allowMissingColumns=True)
    filled = latest_before(
        both, ["pool", "key"], ["seq", "step"], [value], chunk=chunk, spread=spread)
    return filled.filter("step = -1").groupBy("regatta").agg(
        (F.sum(F.coalesce(value, F.lit(initial)) * F.col("copies")) / F.sum("copies"))
        .alias("regatta_avg")
    )


def fleet_history(
    fleet: DataFrame, rated: DataFrame, region_alias: dict[str, str],
    params: RatingParams = DEFAULT,
) -> DataFrame:
    """One row per rated fleet entry with every non-snapshot history column."""
    keys = ["race", "pos"]
    scored = fleet.filter("score is not null")
    shaped = finish_ratio(exposure(merge_regions(scored, region_alias), keys), keys)
    moved = changes(rated.filter(~F.col("pool").contains("t")), params).select(
        "race", F.when(F.col("pool").endswith("sr"), "Skipper").otherwise("Crew").alias("pos"),
        "key", "pool", "seq", "predicted", "rating", "change",
        F.col("pool").startswith("w").alias("womens"),
    )
    return shaped.join(moved, ["race", "pos", "key"]).withColumn("type", F.lit("fleet"))


def match_history(
    members: DataFrame, rated: DataFrame, params: RatingParams = DEFAULT
) -> DataFrame:
    """One row per rated team race entry; predicted is 'win' or 'lose'."""
    moved = changes(rated.filter(F.col("pool").contains("t")), params).select(
        "race", F.when(F.col("pool").endswith("sr"), "Skipper").otherwise("Crew").alias("pos"),
        "key", "pool", "seq", "rating", "change",
        F.when(F.col("predicted") == 1, "win").otherwise("lose").alias("predicted"),
        F.col("pool").startswith("w").alias("womens"),
    )
    return members.join(moved, ["race", "pos", "key"]).withColumn("type", F.lit("team"))


def rating_events(
    rated: DataFrame, order: DataFrame | None = None, params: RatingParams = DEFAULT
) -> DataFrame:
    """race, key, pool, seq, step, rating of every rated entry; with `order` also regatta
    and regatta_seq."""
    events = changes(rated, params).select(
        "race", "key", "pool", "seq", F.when(F.col("pool").endswith("cr"), 1).otherwise(0).alias("step"),
        "rating", "change",
    )
    if order is None:
        return events
    # A seq is one race of one regatta.
    return events.join(order.select("regatta", "seq", "regatta_seq"), "seq")


def many_events(rated: DataFrame) -> bool:
    """Whether some sailor has more rated entries than one task should scan."""
    return hot_groups(rated.select("key"), ["key"]) is not None


def with_ratings_as_of(
    history: DataFrame, rated: DataFrame, order: DataFrame, digits: int
) -> DataFrame:
    """Adds the sailor's eight ratings as of the race, rounded, and the regatta's
    average from before it. `rated` and `order` are read more than once."""
    spread = many_events(rated)
    # Rounded once: a rating is then carried along as it is.
    rounded = rating_events(rated).withColumn("rating", F.round("rating", digits))
    as_of = snapshots(rounded, spread=spread).select("key", "pool", "seq", *POOLS)
    events = rating_events(rated, order)
    people = events.select("regatta", "regatta_seq", "pool", "key").distinct()
    averages = regatta_average(people, events, spread=spread)
    return history.join(as_of, ["key", "pool", "seq"]).join(averages, "regatta", "left")


def with_partner(entries: DataFrame, boat_keys: list[str]) -> DataFrame:
    """Adds the key of whoever holds the other position of the same boat."""
    mates = entries.select(
        *boat_keys, F.col("key").alias("partner"),
        F.when(F.col("pos") == "Skipper", "Crew").otherwise("Skipper").alias("pos"))
    return entries.join(mates, [*boat_keys, "pos"], "left")


def prediction_errors(history: DataFrame) -> DataFrame:
    """Mean error, mean squared error, mean absolute error and exact hits."""
    gap = (F.col("score") - F.col("predicted")).cast("double")
    return history.groupBy("pool").agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean_error"),
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"),
        (F.count_if(gap == 0) / F.count("*")).alias("exact"),
    )
