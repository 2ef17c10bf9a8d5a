"""Eligibility, ranks, boards and team rollups on a fixed rating per sailor."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import rating_math as rm
from windlass.plans import domain, rollups
from windlass.plans.boards import in_seasons, leaderboards, pool_ranks, valid_person
from windlass.plans.catalog import fold_sql
from windlass.plans.domain import ALL_SQL
from windlass.plans.registry import query
from windlass.session import cut_alone, cut_lineage
from windlass.sources.sinks import bounded_lists

SEASONS, MATCH_SEASONS = domain.TARGET_SEASONS, domain.TARGET_MATCH_SEASONS
RATING_SQL = "(24.0 * (mu - 3 * sigma) + 1000)"


def _inputs(spark, sf, *more):
    """Entries with the columns that state and people read and `more`, state, people."""
    fleet = cut_lineage(domain.entries(spark, sf).select(*domain.STATE_COLUMNS, *more))
    members = cut_lineage(
        domain.match_members(spark, sf).select(*domain.STATE_MEMBER_COLUMNS))
    state = domain.static_state(spark, sf, fleet, members)
    return fleet, state, domain.people(spark, sf, fleet)


def _ranks(spark, sf):
    _, state, people = _inputs(spark, sf)
    return pool_ranks(state, people, SEASONS, MATCH_SEASONS, domain.GRAD_CUTOFF)


@query(
    "sailor_totals", "E10 E11 E12 F09 F10 F11 Q5 Q6 Q15",
    ALL_SQL + """SELECT key, races, CAST(cross_races AS BIGINT) AS cross_races,
      CAST(out_links AS BIGINT) AS out_links, round(skipper_ratio, 8) AS skipper_ratio,
      round(crew_ratio, 8) AS crew_ratio, array_to_string(skipper_seasons, ',') AS skipper_seasons,
      array_to_string(crew_seasons, ',') AS crew_seasons FROM people""",
)
def sailor_totals(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf))
    return domain.people(spark, sf, fleet).select(
        "key", "races", "cross_races", "out_links", F.round("skipper_ratio", 8).alias("skipper_ratio"),
        F.round("crew_ratio", 8).alias("crew_ratio"),
        F.array_join("skipper_seasons", ",").alias("skipper_seasons"),
        F.array_join("crew_seasons", ",").alias("crew_seasons"),
    )


@query(
    "valid_people", "C19 C20",
    ALL_SQL + """SELECT key, list_has_any(skipper_seasons, ['f00', 's01']) AND cross_races > 20
      AND out_links > 70 AS skipper_ok, list_has_any(crew_seasons, ['f00', 's01']) AND cross_races > 20
      AND out_links > 70 AS crew_ok FROM people""",
)
def valid_people(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf))
    return domain.people(spark, sf, fleet).select(
        "key", valid_person(F.col("skipper_seasons"), SEASONS).alias("skipper_ok"),
        valid_person(F.col("crew_seasons"), SEASONS).alias("crew_ok"),
    )


@query(
    "pool_ranks", "F03 C19 C20 C21 C22 Q26",
    ALL_SQL + "SELECT pool, key, rank FROM ranks",
)
def pool_rank_rows(spark, sf):
    return _ranks(spark, sf).select("pool", "key", "rank")


@query(
    "leaderboards", "G03 B07 Q19",
    ALL_SQL + f"""SELECT pool, rank, key, name, year, gender, array_to_string(teams, ',') AS teams,
      round({RATING_SQL}, 6) AS rating, array_to_string(place, ',') AS seasons
    FROM ranks WHERE rank BETWEEN 1 AND 100 AND CASE WHEN pool LIKE '%t%' THEN list_has_any(place, ['s01'])
      ELSE list_has_any(place, ['f00', 's01']) END""",
)
def leaderboard_rows(spark, sf):
    from windlass.plans.boards import position_seasons

    board = leaderboards(_ranks(spark, sf), SEASONS, MATCH_SEASONS)
    return board.select(
        "pool", "rank", "key", "name", "year", "gender", F.array_join("teams", ",").alias("teams"),
        F.round(rm.ordinal(F.col("mu"), F.col("sigma")), 6).alias("rating"),
        F.array_join(position_seasons(F.col("pool")), ",").alias("seasons"),
    )


@query(
    "leaderboard_documents", "B07 G03",
    ALL_SQL + """SELECT pool, count(*) AS sailors, string_agg(key, ',' ORDER BY rank) AS keys
    FROM ranks WHERE rank BETWEEN 1 AND 100 AND CASE WHEN pool LIKE '%t%' THEN list_has_any(place, ['s01'])
      ELSE list_has_any(place, ['f00', 's01']) END GROUP BY pool""",
)
def leaderboard_documents(spark, sf):
    """One document per pool: at most 100 sailors, so one list is bounded."""
    board = leaderboards(_ranks(spark, sf), SEASONS, MATCH_SEASONS)
    doc = board.groupBy("pool").agg(
        F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("sailors")
    )
    return doc.select(
        "pool", F.size("sailors").cast("bigint").alias("sailors"),
        F.array_join("sailors.key", ",").alias("keys"),
    )


@query(
    "team_averages", "E03 E04 D17 C23 Q15",
    ALL_SQL + f"""SELECT r.team, coalesce(members, 0) AS members,
      CASE WHEN members IS NULL THEN 0 ELSE round(av, 6) END AS avg,
      CASE WHEN members IS NULL THEN 0 ELSE round(ar, 8) END AS avg_ratio
    FROM team_regions r LEFT JOIN (
      SELECT team, count(*) AS members, (avg(coalesce(sr, 1000)) + avg(coalesce(cr, 1000))) / 2 AS av,
        (avg(skipper_ratio) + avg(crew_ratio)) / 2 AS ar
      FROM (SELECT unnest(teams) AS team, key, skipper_ratio, crew_ratio FROM people
        WHERE list_has_any(skipper_seasons, ['f00', 's01']) OR list_has_any(crew_seasons, ['f00', 's01'])) p
      LEFT JOIN (SELECT key, {RATING_SQL} AS sr FROM state WHERE pool = 'sr') USING (key)
      LEFT JOIN (SELECT key, {RATING_SQL} AS cr FROM state WHERE pool = 'cr') USING (key)
      GROUP BY team) t ON r.team = t.team""",
)
def team_average_rows(spark, sf):
    _, state, people = _inputs(spark, sf)
    teams = domain.team_regions(spark, sf).select("team")
    t = rollups.team_averages(people, rollups.ratings_wide(state), teams, SEASONS)
    return t.select(
        "team", "members", F.round("avg", 6).alias("avg"), F.round("avg_ratio", 8).alias("avg_ratio")
    )


_TOPS_SQL = ALL_SQL + f""", cand AS (SELECT unnest(teams) AS team, pool, key, name, {RATING_SQL} AS rating FROM ps
      WHERE CASE WHEN pool LIKE '%t%' THEN list_has_any(place, ['s01']) AND (pool NOT LIKE 'w%' OR gender = 'F')
        ELSE cross_races > 20 AND out_links > 70 AND list_has_any(place, ['f00', 's01']) END),
    best AS (SELECT *, row_number() OVER (PARTITION BY team, pool ORDER BY rating DESC, key) AS place FROM cand),
    counted AS (SELECT * FROM best WHERE place <= CASE WHEN pool LIKE 'w%' THEN 2 ELSE 3 END),
    tops AS (SELECT r.team, coalesce(sum(rating) FILTER (pool IN ('sr', 'cr')), 0) / 6 AS top_open,
      coalesce(sum(rating) FILTER (pool IN ('wsr', 'wcr')), 0) / 4 AS top_women,
      coalesce(sum(rating) FILTER (pool IN ('tsr', 'tcr')), 0) / 6 AS top_open_team,
      coalesce(sum(rating) FILTER (pool IN ('wtsr', 'wtcr')), 0) / 4 AS top_women_team
      FROM team_regions r LEFT JOIN counted k ON r.team = k.team GROUP BY r.team)"""


def _tops(spark, sf):
    _, state, people = _inputs(spark, sf)
    teams = domain.team_regions(spark, sf).select("team")
    return rollups.team_tops(people, state, teams, SEASONS, MATCH_SEASONS)


@query(
    "team_top_ratings", "E17 G06 Q16 Q17 Q18",
    _TOPS_SQL + """ SELECT team, round(top_open, 6) AS top_open, round(top_women, 6) AS top_women,
      round(top_open_team, 6) AS top_open_team, round(top_women_team, 6) AS top_women_team FROM tops""",
)
def team_top_ratings(spark, sf):
    t = _tops(spark, sf)
    cols = [f"top_{c}" for c in rollups.CATEGORIES]
    return t.select("team", *[F.round(c, 6).alias(c) for c in cols]).orderBy(F.desc("top_open"), "team")


@query(
    "team_top_sailors", "E17 G04",
    _TOPS_SQL + " SELECT team, pool, place, key, name, round(rating, 6) AS rating FROM counted",
)
def team_top_sailors(spark, sf):
    _, state, people = _inputs(spark, sf)
    return rollups.team_top_sailors(people, state, SEASONS, MATCH_SEASONS).select(
        "team", "pool", "place", "key", "name", F.round("rating", 6).alias("rating")
    )


@query(
    "team_ranks", "F05 G06 D18",
    _TOPS_SQL + """ SELECT team, row_number() OVER (ORDER BY round(top_open, 6) DESC, team) AS open,
      row_number() OVER (ORDER BY round(top_women, 6) DESC, team) AS women,
      row_number() OVER (ORDER BY round(top_open_team, 6) DESC, team) AS open_team,
      row_number() OVER (ORDER BY round(top_women_team, 6) DESC, team) AS women_team FROM tops""",
)
def team_rank_rows(spark, sf):
    t = cut_lineage(_tops(spark, sf).select(
        "team", *[F.round(f"top_{c}", 6).alias(f"top_{c}") for c in rollups.CATEGORIES]
    ))
    return rollups.team_ranks(t)


@query(
    "weighted_team_rating", "E18 E12",
    ALL_SQL + f""", cnt AS (SELECT key, season, pos, count(*) AS n FROM entries
        WHERE season IN ('f00', 's01') GROUP BY 1, 2, 3 HAVING count(*) > 5),
    sr AS (SELECT key, {RATING_SQL} AS v FROM state WHERE pool = 'sr'),
    cr AS (SELECT key, {RATING_SQL} AS v FROM state WHERE pool = 'cr'),
    parts AS (SELECT c.key, sum(floor(coalesce(CASE WHEN pos = 'Skipper' THEN sr.v ELSE cr.v END, 1000)) * n / 5) AS part
      FROM cnt c LEFT JOIN sr ON c.key = sr.key LEFT JOIN cr ON c.key = cr.key GROUP BY 1),
    m AS (SELECT key, unnest(teams) AS team, list_has_any(skipper_seasons, ['f00', 's01'])
      OR list_has_any(crew_seasons, ['f00', 's01']) AS active FROM people)
    SELECT team, round(sum(coalesce(part, 0)) / nullif(count(*) FILTER (active), 0), 4) AS rating
    FROM m LEFT JOIN parts USING (key) GROUP BY team""",
)
def weighted_team_rating(spark, sf):
    fleet, state, people = _inputs(spark, sf)
    counts = fleet.groupBy("key", "season", "pos").agg(F.count("*").alias("n"))
    return rollups.weighted_team_rating(
        people, counts, rollups.ratings_wide(state), SEASONS
    ).select("team", F.round("rating", 4).alias("rating"))


@query(
    "team_documents", "B06 E24 F14 D10 I03",
    ALL_SQL + """, links AS (SELECT team, arg_min('/schools/' || lower(team), (date, race_no, key)) AS team_link
      FROM entries WHERE link IS NOT NULL GROUP BY team)
    SELECT r.team, region, lower(replace(replace(r.team, ' ', '-'), '/', '-')) AS id,
      'https://scores.example.org' || coalesce(team_link, '') AS link
    FROM team_regions r LEFT JOIN links l ON r.team = l.team""",
)
def team_document_rows(spark, sf):
    return _team_rows(spark, sf, domain.entries(spark, sf))


def _team_rows(spark, sf, fleet):
    links = fleet.filter("link is not null").groupBy("team").agg(
        F.min_by(
            F.concat(F.lit("/schools/"), F.lower("team")), F.struct("date", "race_no", "key")
        ).alias("team_link")
    )
    teams = domain.team_regions(spark, sf).join(links, "team", "left")
    return rollups.team_documents(teams, "https://scores.example.org").select(
        "team", "region", "id", "link"
    )


@query(
    "full_team_documents", "B06 E03 E17 F05 D17",
    _TOPS_SQL + f""", links AS (SELECT team, arg_min('/schools/' || lower(team), (date, race_no, key)) AS team_link
      FROM entries WHERE link IS NOT NULL GROUP BY team),
    av AS (SELECT team, count(*) AS members, (avg(coalesce(sr, 1000)) + avg(coalesce(cr, 1000))) / 2 AS av,
        (avg(skipper_ratio) + avg(crew_ratio)) / 2 AS ar
      FROM (SELECT unnest(teams) AS team, key, skipper_ratio, crew_ratio FROM people
        WHERE list_has_any(skipper_seasons, ['f00', 's01']) OR list_has_any(crew_seasons, ['f00', 's01'])) p
      LEFT JOIN (SELECT key, {RATING_SQL} AS sr FROM state WHERE pool = 'sr') USING (key)
      LEFT JOIN (SELECT key, {RATING_SQL} AS cr FROM state WHERE pool = 'cr') USING (key) GROUP BY team),
    named AS (SELECT team, string_agg(pool || place || '=' || key, ',' ORDER BY pool, place) AS top_sailors
      FROM counted GROUP BY team)
    SELECT r.team, region, lower(replace(replace(r.team, ' ', '-'), '/', '-')) AS id,
      'https://scores.example.org' || coalesce(team_link, '') AS link, coalesce(members, 0) AS members,
      CASE WHEN members IS NULL THEN 0 ELSE round(av, 6) END AS avg,
      CASE WHEN members IS NULL THEN 0 ELSE round(ar, 8) END AS avg_ratio,
      round(top_open, 6) AS top_open, round(top_women, 6) AS top_women,
      round(top_open_team, 6) AS top_open_team, round(top_women_team, 6) AS top_women_team,
      row_number() OVER (ORDER BY round(top_open, 6) DESC, r.team) AS open,
      row_number() OVER (ORDER BY round(top_women, 6) DESC, r.team) AS women,
      row_number() OVER (ORDER BY round(top_open_team, 6) DESC, r.team) AS open_team,
      row_number() OVER (ORDER BY round(top_women_team, 6) DESC, r.team) AS women_team,
      coalesce(top_sailors, '') AS top_sailors
    FROM team_regions r JOIN tops t ON t.team = r.team LEFT JOIN links l ON l.team = r.team
    LEFT JOIN av a ON a.team = r.team LEFT JOIN named n ON n.team = r.team""",
)
def full_team_documents(spark, sf):
    """A team's whole document: link, averages, top ratings, ranks, top sailors."""
    fleet, state, people = _inputs(spark, sf, "team", "link", "date", "race_no")
    people = cut_lineage(people)
    teams = domain.team_regions(spark, sf).select("team")
    averages = rollups.team_averages(people, rollups.ratings_wide(state), teams, SEASONS).select(
        "team", "members", F.round("avg", 6).alias("avg"), F.round("avg_ratio", 8).alias("avg_ratio"))
    tops = cut_lineage(rollups.team_tops(people, state, teams, SEASONS, MATCH_SEASONS).select(
        "team", *[F.round(f"top_{c}", 6).alias(f"top_{c}") for c in rollups.CATEGORIES]))
    best = rollups.team_top_sailors(people, state, SEASONS, MATCH_SEASONS)
    # At most three sailors of each of eight pools.
    named = best.groupBy("team").agg(F.array_sort(F.collect_list(
        F.struct("pool", "place", "key"))).alias("x")).select("team", F.array_join(F.transform(
            "x", lambda b: F.concat(b["pool"], b["place"].cast("string"), F.lit("="), b["key"])), ",")
            .alias("top_sailors"))
    return (
        _team_rows(spark, sf, fleet).join(averages, "team").join(tops, "team")
        .join(rollups.team_ranks(tops), "team").join(named, "team", "left")
        .withColumn("top_sailors", F.coalesce("top_sailors", F.lit("")))
    )


@query(
    "team_member_lists", "E25 B07 I16",
    ALL_SQL + """, m AS (SELECT unnest(teams) AS team, key, name, races FROM people),
    s AS (SELECT team, CAST(ceil(count(*) / 20.0) AS BIGINT) AS parts FROM m GROUP BY team),
    p AS (SELECT m.*, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % parts AS part FROM m JOIN s USING (team))
    SELECT team, part, count(*) AS n, string_agg(key || ':' || races, ',' ORDER BY key) AS members
    FROM p GROUP BY team, part""",
)
def team_member_lists(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf))
    members = domain.people(spark, sf, fleet).select(F.explode("teams").alias("team"), "key", "name", "races")
    lists = rollups.member_lists(members, F.struct("key", "name", "races"), part_items=20)
    text = F.transform("members", lambda m: F.concat_ws(":", m["key"], m["races"].cast("string")))
    return lists.select(
        "team", "part", F.size("members").cast("bigint").alias("n"),
        F.array_join(text, ",").alias("members"),
    )


@query(
    "search_index", "B08 C26 F16 I19",
    ALL_SQL + """SELECT key, '{"team":"' || teams[-1] || '","year":"' || year || '","name":"' || name || '"}' AS entry
    FROM people WHERE list_has_any(skipper_seasons, ['f00', 's01']) OR list_has_any(crew_seasons, ['f00', 's01'])""",
)
def search_index(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf))
    active = in_seasons(F.col("skipper_seasons"), SEASONS) | in_seasons(F.col("crew_seasons"), SEASONS)
    entry = F.to_json(F.struct(F.element_at("teams", -1).alias("team"), "year", "name"))
    return domain.people(spark, sf, fleet).filter(active).select("key", entry.alias("entry"))


@query(
    "search_index_documents", "B08 I17",
    ALL_SQL + """, a AS (SELECT key, '{"name":"' || name || '","team":"' || teams[-1] || '","year":"' || year || '"}' AS entry FROM people
      WHERE list_has_any(skipper_seasons, ['f00', 's01']) OR list_has_any(crew_seasons, ['f00', 's01'])),
    p AS (SELECT *, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT)
      % (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM a) AS part FROM a)
    SELECT part, '{' || string_agg('"' || key || '":' || entry, ',' ORDER BY key) || '}' AS doc FROM p GROUP BY part""",
)
def search_index_documents(spark, sf):
    """The index as JSON objects of about 25 sailors each."""
    fleet = cut_lineage(domain.entries(spark, sf))
    active = in_seasons(F.col("skipper_seasons"), SEASONS) | in_seasons(F.col("crew_seasons"), SEASONS)
    rows = domain.people(spark, sf, fleet).filter(active).withColumn("doc", F.lit("allSailors"))
    item = F.struct("key", F.struct(
        "name", F.element_at("teams", -1).alias("team"), "year").alias("value"))
    lists = bounded_lists(rows, ["doc"], F.col("key"), item, "items", part_items=25)
    return lists.select("part", F.to_json(F.map_from_entries("items")).alias("doc"))


@query(
    "published_sailors", "B05 C26 F16 I14 I16",
    ALL_SQL + f""", w AS (SELECT key, {", ".join(
        f"max(CASE WHEN pool = '{p}' THEN {RATING_SQL} END) AS {p}" for p in domain.POOL_INDEX)}
      FROM state GROUP BY key),
    k AS (SELECT key, {", ".join(
        f"max(CASE WHEN pool = '{p}' THEN rank END) AS {p}_rank" for p in domain.POOL_INDEX)}
      FROM ranks GROUP BY key)
    SELECT replace(key, '/', '-') AS id, name, gender, year, {", ".join(
        f"CAST(trunc(coalesce({p}, 1000)) AS INTEGER) AS {p}, "
        f"CAST(coalesce({p}_rank, 0) AS INTEGER) AS {p}_rank" for p in domain.POOL_INDEX)},
      teams[-1] AS team, array_to_string(teams, ',') AS teams, array_to_string(skipper_seasons, ',') AS skipper_seasons,
      array_to_string(crew_seasons, ',') AS crew_seasons, races, CAST(cross_races AS BIGINT) AS cross_races,
      CAST(out_links AS BIGINT) AS out_links
    FROM people LEFT JOIN w USING (key) LEFT JOIN k USING (key)
    WHERE (list_contains(skipper_seasons, 's01') OR list_contains(crew_seasons, 's01')) AND races > 0""",
)
def published_sailors(spark, sf):
    """A sailor's document: ratings and ranks of all pools, teams, seasons per
    position, races and exposure."""
    _, state, people = _inputs(spark, sf)
    people = cut_lineage(people)
    pools = list(domain.POOL_INDEX)
    ranks = pool_ranks(state, people, SEASONS, MATCH_SEASONS, domain.GRAD_CUTOFF).groupBy("key").agg(*[
        F.max(F.when(F.col("pool") == p, F.col("rank"))).alias(f"{p}_rank") for p in pools])
    last = SEASONS[-1]
    active = F.array_contains("skipper_seasons", last) | F.array_contains("crew_seasons", last)
    wide = rollups.ratings_wide(state).select("key", *pools)
    base = F.lit(rm.DEFAULT.target)
    return (
        people.filter(active & (F.col("races") > 0)).join(wide, "key", "left")
        .join(ranks, "key", "left")
        .select(
            F.replace("key", F.lit("/"), F.lit("-")).alias("id"), "name", "gender", "year",
            *[F.coalesce(p, base).cast("int").alias(p) for p in pools],
            *[F.coalesce(f"{p}_rank", F.lit(0)).cast("int").alias(f"{p}_rank") for p in pools],
            F.element_at("teams", -1).alias("team"), F.array_join("teams", ",").alias("teams"),
            F.array_join("skipper_seasons", ",").alias("skipper_seasons"),
            F.array_join("crew_seasons", ",").alias("crew_seasons"),
            "races", "cross_races", "out_links",
        )
    )


@query(
    "regatta_documents", "B12 E02",
    ALL_SQL + """, s AS (SELECT regatta, CAST(ceil(count(*) / 40.0) AS BIGINT) AS parts FROM entries GROUP BY 1),
    p AS (SELECT e.regatta, key, race_id, score,
        CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % parts AS part
      FROM entries e JOIN s ON e.regatta = s.regatta),
    k AS (SELECT regatta, part, key, string_agg(race_id || '=' || coalesce(score, 0), ';' ORDER BY race_id) AS races
      FROM p GROUP BY 1, 2, 3)
    SELECT regatta, part, count(*) AS sailors, string_agg(key || '[' || races || ']', ',' ORDER BY key) AS doc
    FROM k GROUP BY 1, 2""",
)
def regatta_documents(spark, sf, part_items=40):
    """Regatta -> sailors -> races, in parts cut by sailor, so a sailor's races
    are in one document."""
    from windlass.sources.sinks import part_of

    fleet = domain.entries(spark, sf).select("regatta", "key", "race_id", "score")
    sizes = fleet.groupBy("regatta").agg(F.ceil(F.count("*") / part_items).alias("parts"))
    parted = fleet.join(sizes, "regatta").withColumn(
        "part", part_of(F.col("key"), F.col("parts"))
    )
    races = parted.groupBy("regatta", "part", "key").agg(
        F.array_sort(F.collect_list(F.struct("race_id", "score"))).alias("races")
    )
    docs = races.groupBy("regatta", "part").agg(
        F.array_sort(F.collect_list(F.struct("key", "races"))).alias("sailors")
    )

    def race_text(r):
        return F.concat(r["race_id"], F.lit("="), F.coalesce(r["score"], F.lit(0)).cast("string"))

    text = F.transform("sailors", lambda s: F.concat(
        s["key"], F.lit("["), F.array_join(F.transform(s["races"], race_text), ";"), F.lit("]")
    ))
    return docs.select(
        "regatta", "part", F.size("sailors").cast("bigint").alias("sailors"),
        F.array_join(text, ",").alias("doc"),
    )


@query("ratings_output", "B01 F03 E10 E11 Q14", fold_sql.RATINGS_OUTPUT)
def ratings_output(spark, sf):
    """The full rating table: one row per sailor from the ordered fold."""
    from windlass.operators.rating_fold import final_state
    from windlass.plans.rating_run import FLEET_COLUMNS, MEMBER_COLUMNS, rate_log

    # Besides what the run reads, `people` reads season and region.
    fleet, members = domain.logs(spark, sf, [*FLEET_COLUMNS, "season", "region"], MEMBER_COLUMNS)
    state = cut_alone(spark, lambda: final_state(rate_log(fleet, members)))
    people = cut_lineage(domain.people(spark, sf, fleet))
    ranks = pool_ranks(state, people, SEASONS, MATCH_SEASONS, domain.GRAD_CUTOFF)
    pools = list(domain.POOL_INDEX)
    rank_cols = ranks.groupBy("key").agg(*[
        F.coalesce(F.max(F.when(F.col("pool") == p, F.col("rank"))), F.lit(0)).alias(f"{p}_rank")
        for p in pools
    ])
    wide = rollups.ratings_wide(state)
    rounded = [F.round(c, 4).alias(c) for c in wide.columns if c != "key"]
    return people.join(wide.select("key", *rounded), "key").join(rank_cols, "key").select(
        "key", "name", "gender", "year", "races", "cross_races", "out_links",
        *[c for c in wide.columns if c != "key"], *[f"{p}_rank" for p in pools],
    )
