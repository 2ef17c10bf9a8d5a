"""Team rollups, season ranks and published documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.ids import slug
from windlass.functions.rating_math import DEFAULT, RatingParams, ordinal
from windlass.operators.groups import top_k
from windlass.plans.boards import in_seasons, valid_person
from windlass.sources.sinks import bounded_lists

# Category: (skipper pool, crew pool, sailors counted per position).
CATEGORIES = {
    "open": ("sr", "cr", 3), "women": ("wsr", "wcr", 2),
    "open_team": ("tsr", "tcr", 3), "women_team": ("wtsr", "wtcr", 2),
}


def people_table(fleet: DataFrame, exposed: DataFrame, sailors: DataFrame) -> DataFrame:
    """One row per sailor: seasons per position, exposure, mean finish ratios.

    fleet: key, pos, season. exposed: key, pos, is_cross, out_links, ratio.
    """
    seasons = fleet.select("key", "pos", "season").distinct().groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") == "Skipper", F.col("season"))))
        .alias("skipper_seasons"),
        F.array_sort(F.collect_list(F.when(F.col("pos") == "Crew", F.col("season"))))
        .alias("crew_seasons"),
    )
    totals = exposed.groupBy("key").agg(
        F.count("*").alias("races"), F.sum("is_cross").alias("cross_races"),
        F.sum("out_links").alias("out_links"),
        F.avg(F.when(F.col("pos") == "Skipper", F.col("ratio"))).alias("skipper_ratio"),
        F.avg(F.when(F.col("pos") == "Crew", F.col("ratio"))).alias("crew_ratio"),
    )
    joined = sailors.join(seasons, "key", "left").join(totals, "key", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "skipper_seasons": F.coalesce("skipper_seasons", none),
        "crew_seasons": F.coalesce("crew_seasons", none),
        **{c: F.coalesce(c, F.lit(0)) for c in ("races", "cross_races", "out_links")},
    })


def ratings_wide(state: DataFrame, params: RatingParams = DEFAULT) -> DataFrame:
    """One row per sailor with the eight displayed ratings, new players at 1000."""
    from windlass.plans.unify import POOLS

    value = ordinal(F.col("mu"), F.col("sigma"), params)
    aggs = []
    for p in POOLS:
        hit = F.col("pool") == p
        aggs += [
            F.coalesce(F.max(F.when(hit, value)), F.lit(params.target)).alias(p),
            F.coalesce(F.max(F.when(hit, F.col("mu"))), F.lit(params.mu)).alias(f"{p}_mu"),
            F.coalesce(F.max(F.when(hit, F.col("sigma"))), F.lit(params.sigma)).alias(f"{p}_sigma"),
        ]
    return state.groupBy("key").agg(*aggs)


def team_averages(people: DataFrame, ratings: DataFrame, teams: DataFrame,
                  seasons: list[str]) -> DataFrame:
    """Members active this season, their mean ratings and finish ratios.

    people has `teams` (array). Teams without members get 0 everywhere; a mean
    over no value stays NULL.
    """
    active = in_seasons(F.col("skipper_seasons"), seasons) | in_seasons(
        F.col("crew_seasons"), seasons
    )
    rows = people.filter(active).join(ratings, "key", "left").select(
        F.explode("teams").alias("team"), "skipper_ratio", "crew_ratio",
        F.coalesce("sr", F.lit(DEFAULT.target)).alias("sr"),
        F.coalesce("cr", F.lit(DEFAULT.target)).alias("cr"),
    )
    stats = rows.groupBy("team").agg(
        F.count("*").alias("members"), F.avg("sr").alias("avg_skipper"),
        F.avg("cr").alias("avg_crew"), F.avg("skipper_ratio").alias("avg_skipper_ratio"),
        F.avg("crew_ratio").alias("avg_crew_ratio"),
    ).withColumns({
        "avg": (F.col("avg_skipper") + F.col("avg_crew")) / 2,
        "avg_ratio": (F.col("avg_skipper_ratio") + F.col("avg_crew_ratio")) / 2,
    })
    joined = teams.join(stats, "team", "left")
    absent = F.col("members").isNull()
    return joined.withColumns({
        c: F.when(absent, F.lit(0)).otherwise(F.col(c)) for c in stats.columns if c != "team"
    })


def _candidates(people: DataFrame, state: DataFrame, seasons: list[str],
                match_seasons: list[str]) -> DataFrame:
    """Sailors that count for a team, per team, category and position."""
    pool = F.col("pool")
    place = F.when(pool.endswith("sr"), F.col("skipper_seasons")).otherwise(F.col("crew_seasons"))
    fleet_ok = valid_person(place, seasons)
    team_ok = in_seasons(place, match_seasons) & (
        ~pool.startswith("w") | (F.col("gender") == "F")
    )
    ok = F.when(pool.contains("t"), team_ok).otherwise(fleet_ok)
    return state.join(people, "key").filter(ok).select(
        F.explode("teams").alias("team"), "pool", "key", "name", "mu", "sigma",
        ordinal(F.col("mu"), F.col("sigma")).alias("rating"),
    )


def team_tops(people: DataFrame, state: DataFrame, teams: DataFrame, seasons: list[str],
              match_seasons: list[str]) -> DataFrame:
    """Top rating of each team in four categories.

    The sum of the best N skippers and N crews over 2N, also when a team has
    fewer; a team with nobody has 0.
    """
    best = team_top_sailors(people, state, seasons, match_seasons)
    sums = [
        (F.coalesce(F.sum(F.when(F.col("pool").isin(s, c), F.col("rating"))), F.lit(0.0)) / (2 * n))
        .alias(f"top_{name}")
        for name, (s, c, n) in CATEGORIES.items()
    ]
    per_team = best.groupBy("team").agg(*sums)
    return teams.join(per_team, "team", "left").withColumns(
        {f"top_{n}": F.coalesce(f"top_{n}", F.lit(0.0)) for n in CATEGORIES}
    )


def team_top_sailors(people: DataFrame, state: DataFrame, seasons: list[str],
                     match_seasons: list[str]) -> DataFrame:
    """The counted sailors themselves (place 1..N per team and pool)."""
    limit = F.when(F.col("pool").isin("wsr", "wcr", "wtsr", "wtcr"), 2).otherwise(3)
    rows = _candidates(people, state, seasons, match_seasons)
    best = top_k(rows, ["team", "pool"], [F.desc("rating"), F.col("key")], 3, "place")
    return best.filter(F.col("place") <= limit)


def team_ranks(tops: DataFrame) -> DataFrame:
    """Rank of every team per category, best first, ties by team name."""
    from windlass.plans.boards import rank_all

    out = tops.select("team")
    for name in CATEGORIES:
        ranked = rank_all(tops.select("team", f"top_{name}"), f"top_{name}", name, "team", start=1)
        out = out.join(ranked.select("team", name), "team")
    return out


def rank_history(dated: DataFrame) -> DataFrame:
    """dated: date, team, rank -> per team the ranks by date, NULL where absent.

    One list item per snapshot date, so its length follows the calendar.
    """
    dates = dated.select("date").distinct()
    teams = dated.select("team").distinct()
    # Every team on every date it could appear on: teams carry the date list.
    listed = dates.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    grid = teams.withColumn("date", F.explode(listed.scalar()))
    full = grid.join(dated, ["team", "date"], "left")
    items = F.array_sort(F.collect_list(F.struct("date", "rank")))
    return full.groupBy("team").agg(items.alias("history"))


def weighted_team_rating(people: DataFrame, counts: DataFrame, ratings: DataFrame,
                         seasons: list[str]) -> DataFrame:
    """Sum of rating x races / 5 over (sailor, season, position) with more than
    five races, divided by the number of active members."""
    active = in_seasons(F.col("skipper_seasons"), seasons) | in_seasons(
        F.col("crew_seasons"), seasons
    )
    members = people.select("key", F.explode("teams").alias("team"), active.alias("active"))
    used = counts.filter(F.col("season").isin(seasons) & (F.col("n") > 5)).join(
        ratings.select("key", "sr", "cr"), "key"
    )
    rating = F.when(F.col("pos") == "Skipper", F.col("sr")).otherwise(F.col("cr"))
    parts = used.groupBy("key").agg(F.sum(F.floor(rating) * F.col("n") / 5).alias("part"))
    return members.join(parts, "key", "left").groupBy("team").agg(
        F.try_divide(F.sum(F.coalesce("part", F.lit(0.0))), F.count_if("active")).alias("rating")
    )


def team_documents(teams: DataFrame, url: str) -> DataFrame:
    """Document id and link of each team."""
    link = F.coalesce("team_link", F.lit(""))
    return teams.withColumns({"id": slug(F.col("team")), "link": F.concat(F.lit(url), link)})


def member_lists(members: DataFrame, item: Column, part_items: int) -> DataFrame:
    """Members per team, sorted by key, in parts of about `part_items`."""
    return bounded_lists(members, ["team"], F.col("key"), item, "members", part_items)
