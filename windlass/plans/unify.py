"""From raw fleet and team tables to one race log with keys and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions import ids
from windlass.operators.groups import hot_groups, rank_in_group
from windlass.session import cut_lineage

WOMEN_MINIMUM = 4


def unify_fleet(entries: DataFrame) -> DataFrame:
    """Derived columns of the fleet table (schema FLEET_ENTRY)."""
    race_id = F.col("raceID")
    return entries.withColumns({
        "race_no": ids.race_number(race_id),
        "div": ids.race_division(race_id),
        "race": ids.adjusted_race_id(race_id, F.col("Scoring")),
        "key": ids.surrogate_key(F.col("Link"), F.col("Sailor"), F.col("Team")),
        "partner_key": ids.surrogate_key(F.col("PartnerLink"), F.col("Partner"), F.col("Team")),
        "date": ids.parse_date(F.col("Date")),
        "season": ids.season_of(race_id),
    }).withColumnsRenamed({
        "Regatta": "regatta", "Score": "score", "Position": "pos", "raceID": "race_id",
        "Scoring": "scoring", "Venue": "venue", "Sailor": "name", "Team": "team",
    })


def unify_matches(matches: DataFrame) -> DataFrame:
    """Derived columns of the team race table (schema TEAM_MATCH)."""
    return matches.withColumns({
        "race": F.col("raceID"), "scoring": F.lit("team"), "race_no": F.col("raceNum"),
        "div": F.lit(None).cast("string"), "season": ids.season_of(F.col("raceID")),
        "date": ids.parse_date(F.col("date")), "venue": F.col("Venue"),
    })


def number_boats(entries: DataFrame, keys: tuple[str, ...] = ("race", "div", "pos")) -> DataFrame:
    """Boat number per race, division and position, by the number in the name."""
    keys = list(keys)
    rows = entries.withColumn("_no", F.split_part("name", F.lit("#"), F.lit(2)).try_cast("bigint"))
    return rank_in_group(
        rows, keys, "_no", "boat", ["key"], descending=False, hot=hot_groups(entries, keys)
    ).drop("_no")


def match_boats(matches: DataFrame) -> DataFrame:
    """One row per (match, side, boat, position); unknown keys are dropped
    together with their row, so partners never shift to another boat."""

    def side(letter: str, other: str) -> DataFrame:
        t, o = f"team{letter}", f"team{other}"
        boats = matches.select(
            "race", "regatta", "race_no", "round", "date", "season", "venue",
            F.lit(letter).alias("side"), F.col(f"{t}Name").alias("team"),
            F.col(f"{o}Name").alias("opponent"), F.col(f"{o}Nick").alias("opponent_nick"),
            F.col(f"{t}Score").alias("score"), F.col(f"{t}Outcome").alias("outcome"),
            F.posexplode(f"{t}Boats").alias("boat", "b"),
        )
        people = F.array(
            F.struct(
                F.lit("Skipper").alias("pos"), F.col("b.skipperKey").alias("key"),
                F.col("b.skipperName").alias("name"), F.col("b.crewKey").alias("partner_key"),
                F.col("b.crewName").alias("partner"),
            ),
            F.struct(
                F.lit("Crew").alias("pos"), F.col("b.crewKey").alias("key"),
                F.col("b.crewName").alias("name"), F.col("b.skipperKey").alias("partner_key"),
                F.col("b.skipperName").alias("partner"),
            ),
        )
        return boats.withColumn("p", F.explode(people)).select(
            *[c for c in boats.columns if c != "b"], "p.*"
        )

    both = side("A", "B").unionByName(side("B", "A"))
    return both.filter(F.col("key").isNotNull() & ~F.col("key").contains(ids.UNKNOWN))


def resolve_merges(merges: DataFrame) -> DataFrame:
    """(old_key, new_key) with every chain followed to its end: A->B and B->C
    give A->C and B->C. Of several targets of a key the least counts; a key
    merged into itself is none; a cycle is an error. Each round doubles the
    steps followed, so a chain of n merges takes about log2(n) joins.
    """
    own = (
        merges.filter("old_key is not null and new_key is not null and old_key <> new_key")
        .groupBy("old_key").agg(F.min("new_key").alias("new_key")))
    own = cut_lineage(own)
    for _ in range(max(1, own.count()).bit_length() + 1):
        then = own.select(F.col("old_key").alias("new_key"), F.col("new_key").alias("_then"))
        own = cut_lineage(own.join(then, "new_key", "left").select(
            "old_key", F.coalesce("_then", "new_key").alias("new_key"),
            F.col("_then").isNotNull().alias("_moved")))
        if own.filter("_moved").isEmpty():
            return own.select("old_key", "new_key")
        own = own.drop("_moved")
    raise ValueError("identity merges form a cycle")


def merge_identities(df: DataFrame, merges: DataFrame, col: str = "key") -> DataFrame:
    """Replace old keys by their canonical one; unlisted keys stay."""
    renamed = resolve_merges(merges).select(
        F.col("old_key").alias(col), F.col("new_key").alias("_new"))
    return df.join(renamed, col, "left").withColumn(
        col, F.coalesce("_new", col)
    ).select(*df.columns)


def merge_people(people: DataFrame, merges: DataFrame) -> DataFrame:
    """One row per canonical person: links and teams of all identities joined.

    The canonical row's values come first, as do its name, gender and year.
    """
    own = people.withColumn("_old", F.col("key"))
    merged = merge_identities(own, merges)
    rank = F.when(F.col("key") == F.col("_old"), 0).otherwise(1)
    order = F.struct(rank, F.col("_old"))
    return merged.groupBy("key").agg(
        *[F.min_by(c, order).alias(c) for c in ("name", "gender", "year")],
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "link", "team"))).alias("_ids"),
    ).select(
        "key", "name", "gender", "year", F.array_distinct("_ids.link").alias("links"),
        F.array_distinct("_ids.team").alias("teams"),
    )


def _women(women: Column, men: Column) -> list[Column]:
    return [
        women.alias("women"),
        ((women >= WOMEN_MINIMUM) & (men == 0)).alias("womens"),
    ]


def fleet_women(entries: DataFrame) -> DataFrame:
    """Women's regattas: at least four women and no man, people counted once
    per position."""
    people = entries.select("regatta", "pos", "key", "gender").distinct()
    return people.groupBy("regatta").agg(
        *_women(F.count_if(F.col("gender") == "F"), F.count_if(F.col("gender") == "M"))
    )


def womens_regattas(entries: DataFrame) -> DataFrame:
    """(regatta, womens) by the test of `fleet_women`, as a stored table: a man rules a
    regatta out, so people are told apart only in regattas without one."""
    men = cut_lineage(entries.groupBy("regatta").agg(
        F.count_if(F.col("gender") == "M").alias("men")))
    women = (
        entries.filter(F.col("gender") == "F")
        .join(men.filter("men = 0"), "regatta", "left_semi")
        .select("regatta", "pos", "key").distinct()
        .groupBy("regatta").agg(F.count("*").alias("women")))
    return cut_lineage(men.join(women, "regatta", "left").select(
        "regatta", (F.coalesce("women", F.lit(0)) >= WOMEN_MINIMUM).alias("womens")))


def match_women(members: DataFrame) -> DataFrame:
    """The same test for team racing, where repeats of a sailor count."""
    return members.groupBy("regatta").agg(
        *_women(F.count_if(F.col("gender") == "F"), F.count_if(F.col("gender") == "M"))
    )


def pool_name(womens: Column, team: bool, pos: Column) -> Column:
    """sr cr wsr wcr (fleet) and tsr tcr wtsr wtcr (team racing)."""
    stem = "t" if team else ""
    return F.concat(
        F.when(womens, "w").otherwise(""), F.lit(stem),
        F.when(pos == "Skipper", "sr").otherwise("cr"),
    )


POOLS = ["sr", "cr", "wsr", "wcr", "tsr", "tcr", "wtsr", "wtcr"]
