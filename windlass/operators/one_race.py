"""Plackett-Luce update of many independent races as plain windows.

The sums of the update run along the finishing order, so a race is a prefix
and a suffix sum with tied ranks sharing a frame: no UDF is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.functions.rating_math import DEFAULT, RatingParams

# Distinct ranks per bucket when one race is spread over several groups.
RANK_BUCKET = 100_000


def _spread_sums(teams: DataFrame, keys: list[str]) -> DataFrame:
    """a, sum_x, sum_y per (race, rank), scanned in rank buckets."""
    ranks = teams.groupBy(*keys, "rank").agg(
        F.sum("e").alias("e"), F.count("*").alias("a")
    ).withColumn("_bucket", F.floor(F.col("rank") / RANK_BUCKET))

    def scan(df: DataFrame, values: dict[str, Column], forward: bool) -> DataFrame:
        def direction(c: str) -> Column:
            return F.col(c).asc() if forward else F.col(c).desc()

        inside = Window.partitionBy(*keys, "_bucket").orderBy(direction("rank")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        outside = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(
            Window.unboundedPreceding, -1
        )
        totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(n) for n, v in values.items()])
        carry = totals.select(
            *keys, "_bucket", *[F.sum(n).over(outside).alias(f"_c_{n}") for n in values]
        )
        joined = df.withColumns({n: F.sum(v).over(inside) for n, v in values.items()}).join(
            carry, [*keys, "_bucket"]
        )
        return joined.withColumns(
            {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0.0)) for n in values}
        ).drop(*[f"_c_{n}" for n in values])

    behind = scan(ranks, {"s": F.col("e")}, forward=False)
    # Each of the a tied teams adds 1/(a s): together 1/s.
    sums = scan(
        behind, {"sum_x": 1.0 / F.col("s"), "sum_y": 1.0 / (F.col("s") * F.col("s"))}, forward=True
    )
    return sums.select(*keys, "rank", "a", "sum_x", "sum_y")


def rate_races(
    players: DataFrame, race_keys: Sequence[str], params: RatingParams = DEFAULT,
    weight: str | None = None, spread: bool = False, single: bool = False,
) -> DataFrame:
    """players: race_keys.., team, rank, mu, sigma -> adds mu1, sigma1.

    Races with fewer than two teams are left out. `single`: every team is one
    player, which saves a grouping. `spread`: sum over rank buckets, for races
    too large for one window.
    """
    keys = list(race_keys)
    var = F.col("sigma") * F.col("sigma") + F.lit(params.tau**2)
    rows = players.withColumn("_var", var)
    beta2 = F.lit(params.beta**2)
    if single:
        teams = rows.withColumns({"tm": F.col("mu"), "tv": F.col("_var")})
    else:
        teams = rows.groupBy(*keys, "team").agg(
            F.min("rank").alias("rank"), F.sum("mu").alias("tm"), F.sum("_var").alias("tv")
        )
    if spread:
        totals = teams.groupBy(*keys).agg(
            F.sqrt(F.sum(F.col("tv") + beta2)).alias("c"), F.max("tm").alias("top"),
            F.count("*").alias("n"),
        ).filter("n > 1").drop("n")
        teams = teams.join(totals, keys).withColumn(
            "e", F.exp((F.col("tm") - F.col("top")) / F.col("c"))
        )
        teams = teams.join(_spread_sums(teams, keys), [*keys, "rank"])
    else:
        race = Window.partitionBy(*keys)
        ranked = race.orderBy("rank")
        ahead = ranked.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        after = ranked.rangeBetween(Window.currentRow, Window.unboundedFollowing)
        same = ranked.rangeBetween(Window.currentRow, Window.currentRow)
        teams = (
            teams.withColumns({
                "c": F.sqrt(F.sum(F.col("tv") + beta2).over(race)),
                "top": F.max("tm").over(race), "a": F.count("*").over(same),
                "n": F.count("*").over(race),
            })
            .filter("n > 1")
            .withColumn("e", F.exp((F.col("tm") - F.col("top")) / F.col("c")))
            .withColumn("s", F.sum("e").over(after))
            .withColumns({
                "sum_x": F.sum(1.0 / (F.col("a") * F.col("s"))).over(ahead),
                "sum_y": F.sum(1.0 / (F.col("a") * F.col("s") * F.col("s"))).over(ahead),
            })
        )
    e, c, tv = F.col("e"), F.col("c"), F.col("tv")
    updated = teams.withColumns({
        "omega": tv / c * (1.0 / F.col("a") - e * F.col("sum_x")),
        "delta": F.sqrt(tv) / c * tv / (c * c) * (e * F.col("sum_x") - e * e * F.col("sum_y")),
    })
    if not single:
        updated = rows.join(
            updated.select(*keys, "team", "tv", "omega", "delta"), [*keys, "team"]
        )
    share = F.col("_var") / F.col("tv")
    gain: Column = F.lit(1.0)
    if weight:
        gain = F.when(F.col("omega") >= 0, F.col(weight)).otherwise(1.0 / F.col(weight))
    floor = F.greatest(1.0 - share * F.col("delta") * gain, F.lit(params.kappa))
    return updated.withColumns({
        "mu1": F.col("mu") + share * F.col("omega") * gain,
        "sigma1": F.sqrt(F.col("_var")) * F.sqrt(floor),
    }).select(*players.columns, "mu1", "sigma1")
