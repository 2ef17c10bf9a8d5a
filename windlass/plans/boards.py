"""Eligibility, ranks, leaderboards and small report shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.ids import grad_year
from windlass.operators.groups import HOT_GROUP_ROWS, hot_groups, rank_in_group

BOARD_SIZE = 100
MIN_CROSS = 20
MIN_OUT_LINKS = 70


def rank_pairs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Places (from 0) of the keys both rankings hold."""
    first = rank_all(a, value, "first_place", key).select(key, "first_place")
    second = rank_all(b, value, "second_place", key).select(key, "second_place")
    return first.join(second, key)


def rank_all(df: DataFrame, value: str, name: str, tiebreak: str, start: int = 0) -> DataFrame:
    """Place of every row over the whole table, split into ranges when large."""
    one = df.withColumn("_all", F.lit(1))
    hot = hot_groups(one, ["_all"], HOT_GROUP_ROWS)
    ranked = rank_in_group(one, ["_all"], value, name, [tiebreak], hot=hot).drop("_all")
    return ranked.withColumn(name, F.col(name) - 1 + start)


def min_max(df: DataFrame, value: str, name: str, top: float) -> DataFrame:
    """Scale to 0..top by the column's extremes (one-row scalar subqueries)."""
    low = df.agg(F.min(value)).scalar()
    high = df.agg(F.max(value)).scalar()
    return df.withColumn(name, (F.col(value) - low) / (high - low) * top)


def position_seasons(pool: Column) -> Column:
    return F.when(pool.endswith("sr"), F.col("skipper_seasons")).otherwise(F.col("crew_seasons"))


def in_seasons(seasons: Column, wanted: list[str]) -> Column:
    return F.coalesce(
        F.arrays_overlap(seasons, F.array(*[F.lit(s) for s in wanted])), F.lit(False)
    )


def _active(seasons: list[str], match_seasons: list[str]) -> Column:
    pool = F.col("pool")
    return F.when(
        pool.contains("t"), in_seasons(position_seasons(pool), match_seasons)
    ).otherwise(in_seasons(position_seasons(pool), seasons))


def valid_person(position_seasons_col: Column, seasons: list[str]) -> Column:
    """Enough races and rivals across regions, and active."""
    return (
        (F.col("cross_races") > MIN_CROSS) & (F.col("out_links") > MIN_OUT_LINKS)
        & in_seasons(position_seasons_col, seasons)
    )


def pool_ranks(
    state: DataFrame, people: DataFrame, seasons: list[str], match_seasons: list[str],
    grad_cutoff: int,
) -> DataFrame:
    """state: pool, key, mu, sigma (a row means the sailor has competed in the
    pool). people: key, year, seasons, out_links. rank 0 means not eligible;
    equal ratings are ordered by key."""
    value = F.col("mu") - 3.0 * F.col("sigma")
    fleet_ok = F.col("pool").contains("t") | (F.col("out_links") > MIN_OUT_LINKS)
    ok = _active(seasons, match_seasons) & fleet_ok & (grad_year(F.col("year")) > grad_cutoff)
    rows = state.join(people, "key").withColumns(
        {"_value": value, "_ok": F.coalesce(ok, F.lit(False))}
    )
    eligible = rows.filter("_ok")
    hot = hot_groups(state, ["pool"], HOT_GROUP_ROWS)
    ranked = rank_in_group(eligible, ["pool"], "_value", "rank", ["key"], hot=hot)
    rest = rows.filter(~F.col("_ok")).withColumn("rank", F.lit(0))
    return ranked.unionByName(rest).drop("_value", "_ok")


def leaderboards(
    ranks: DataFrame, seasons: list[str], match_seasons: list[str], size: int = BOARD_SIZE
) -> DataFrame:
    """Top `size` of each pool, active in the target seasons."""
    return ranks.filter(F.col("rank").between(1, size) & _active(seasons, match_seasons))
