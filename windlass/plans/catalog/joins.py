"""Joins, set operations, comparisons and plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import ids
from windlass.operators import compare, dedup
from windlass.operators.exposure import exposure, merge_regions
from windlass.operators.graph import connected_components, page_rank
from windlass.operators.groups import attach
from windlass.operators.histogram import normal_histogram
from windlass.plans import domain
from windlass.plans.domain import ALL_SQL, ENTRIES_SQL, MATCHES_SQL, SAILORS_SQL, table
from windlass.plans.registry import query
from windlass.plans.unify import merge_identities, number_boats
from windlass.session import cut_lineage

SAILORS_WITH = "WITH " + SAILORS_SQL.strip()


@query(
    "sailor_links_left_join", "D01 D11",
    ENTRIES_SQL + """SELECT e.race_id, e.key, d.link, d.gender, d.year FROM entries e
      LEFT JOIN (SELECT * FROM sailors WHERE link IS NOT NULL) d ON e.key = d.key""",
)
def sailor_links_left_join(spark, sf):
    people = domain.sailors(spark, sf).filter("link is not null").select(
        "key", "link", "gender", "year"
    )
    return domain.entries(spark, sf).select("race_id", "key").join(people, "key", "left")


_DIFF_SQL = """WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
    b AS (SELECT o_orderkey, CASE WHEN o_custkey % 17 = 3 THEN NULL ELSE o_custkey END AS o_custkey,
      CASE WHEN o_totalprice > 400000 THEN lower(o_orderstatus) || '?' ELSE lower(o_orderstatus) END
        AS o_orderstatus, ' ' || o_orderpriority AS o_orderpriority FROM orders
      WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


def _two_versions(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    low = F.lower("o_orderstatus")
    b = orders.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 17 != 3, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_totalprice") > 400000, F.concat(low, F.lit("?"))).otherwise(low)
        .alias("o_orderstatus"),
        F.concat(F.lit(" "), "o_orderpriority").alias("o_orderpriority"),
    )
    return a, b


@query(
    "row_differences", "D02 C24 H06",
    _DIFF_SQL + """ SELECT a.o_orderkey, a.o_custkey IS DISTINCT FROM b.o_custkey AS diff_o_custkey,
      a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS diff_o_orderstatus,
      a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS diff_o_orderpriority
    FROM a JOIN b USING (o_orderkey)""",
)
def row_differences(spark, sf):
    return compare.row_differences(*_two_versions(spark, sf), ["o_orderkey"])


@query(
    "row_differences_normalised", "C24 C25",
    _DIFF_SQL + """ SELECT * FROM (SELECT a.o_orderkey,
      a.o_custkey IS DISTINCT FROM b.o_custkey AS diff_o_custkey,
      lower(a.o_orderstatus) IS DISTINCT FROM lower(b.o_orderstatus) AS diff_o_orderstatus,
      lower(trim(a.o_orderpriority)) IS DISTINCT FROM lower(trim(b.o_orderpriority)) AS diff_o_orderpriority
    FROM a JOIN b USING (o_orderkey)) WHERE diff_o_custkey OR diff_o_orderstatus OR diff_o_orderpriority""",
)
def row_differences_normalised(spark, sf):
    return compare.row_differences(*_two_versions(spark, sf), ["o_orderkey"], fold_text=True)


@query(
    "rows_not_in", "D03 H05",
    _DIFF_SQL + """ SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey, o_custkey,
      lower(o_orderstatus) AS s, ' ' || o_orderpriority AS p FROM a) x
      WHERE x.o_orderkey = b.o_orderkey AND x.o_custkey IS NOT DISTINCT FROM b.o_custkey
        AND x.s = b.o_orderstatus AND x.p = b.o_orderpriority)""",
)
def rows_not_in(spark, sf):
    a, b = _two_versions(spark, sf)
    same = a.withColumns({
        "o_orderstatus": F.lower("o_orderstatus"),
        "o_orderpriority": F.concat(F.lit(" "), "o_orderpriority"),
    })
    return compare.rows_not_in(b, same)


@query(
    "multiset_difference", "H05",
    """SELECT l_suppkey AS s, l_returnflag AS f FROM lineitem EXCEPT ALL
    SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'""",
)
def multiset_difference(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), "l_linestatus"
    )
    return li.drop("l_linestatus").exceptAll(
        li.filter("l_linestatus = 'O'").drop("l_linestatus")
    )


@query(
    "common_customers", "H04 D18",
    """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT
    SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""",
)
def common_customers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("k").intersect(
        o.filter("o_orderstatus = 'O'").select("k")
    )


@query(
    "distinct_links", "H03 E09",
    SAILORS_WITH + """, x AS (SELECT coalesce(link, 'Unknown') AS link FROM sailors UNION ALL
      SELECT 'sup-' || l_suppkey FROM lineitem UNION ALL SELECT 'cus-' || o_custkey FROM orders)
    SELECT DISTINCT link FROM x WHERE link <> 'Unknown'""",
)
def distinct_links(spark, sf):
    a = domain.sailors(spark, sf).select(F.coalesce("link", F.lit(ids.UNKNOWN)).alias("link"))
    b = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sup-"), F.col("l_suppkey").cast("string")).alias("link")
    )
    c = table(spark, sf, "orders").select(
        F.concat(F.lit("cus-"), F.col("o_custkey").cast("string")).alias("link")
    )
    return a.union(b).union(c).filter(F.col("link") != ids.UNKNOWN).distinct()


@query(
    "match_team_lookup", "D04 D06",
    MATCHES_SQL + """, names AS (SELECT race, side, min(team) AS team FROM members GROUP BY 1, 2)
    SELECT m.race, m.key, m.side, a.team AS own_team, b.team AS opponent_team FROM members m
    JOIN names a ON m.race = a.race AND m.side = a.side
    JOIN names b ON m.race = b.race AND m.side <> b.side""",
)
def match_team_lookup(spark, sf):
    m = domain.match_members(spark, sf)
    names = m.groupBy("race").agg(
        F.min(F.when(F.col("side") == "A", F.col("team"))).alias("a"),
        F.min(F.when(F.col("side") == "B", F.col("team"))).alias("b"),
    )
    mine = F.when(F.col("side") == "A", F.col("a")).otherwise(F.col("b"))
    other = F.when(F.col("side") == "A", F.col("b")).otherwise(F.col("a"))
    return m.join(names, "race").select(
        "race", "key", "side", mine.alias("own_team"), other.alias("opponent_team")
    )


@query(
    "boat_pairing", "D07 D08 C06",
    ENTRIES_SQL + """, boats AS (SELECT *, row_number() OVER (PARTITION BY race, div, pos
        ORDER BY CAST(split_part(name, '#', 2) AS BIGINT), key) AS boat
      FROM entries)
    SELECT s.race_id, s.key, s.pos, coalesce(min(c.name), 'Unknown') AS partner,
      coalesce(min(c.key), 'Unknown') AS partner_key
    FROM boats s LEFT JOIN boats c ON s.race = c.race AND s.div = c.div AND s.boat = c.boat AND s.pos <> c.pos
    GROUP BY s.race_id, s.key, s.pos""",
)
def boat_pairing(spark, sf):
    """Skipper and crew share (race, division, boat number)."""
    boats = number_boats(domain.entries(spark, sf)).select(
        "race", "div", "boat", "race_id", "key", "pos", "name"
    )
    other = boats.select(
        "race", "div", "boat", F.when(F.col("pos") == "Crew", "Skipper").otherwise("Crew").alias("pos"),
        F.col("name").alias("partner"), F.col("key").alias("partner_key"),
    )
    return boats.join(other, ["race", "div", "boat", "pos"], "left").select(
        "race_id", "key", "pos", F.coalesce("partner", F.lit(ids.UNKNOWN)).alias("partner"),
        F.coalesce("partner_key", F.lit(ids.UNKNOWN)).alias("partner_key"),
    )


@query(
    "identity_merge", "D12 J08 D09",
    ENTRIES_SQL + """, merges AS (SELECT key AS old_key, 'sup-' || (s_suppkey - 9) AS new_key FROM sailors
      WHERE s_suppkey % 10 = 0 AND s_suppkey > 0),
    m AS (SELECT coalesce(new_key, e.key) AS key, race_id, score, e.key AS old FROM entries e
      LEFT JOIN merges ON e.key = old_key)
    SELECT key, count(*) AS entries, count(DISTINCT old) AS identities, CAST(sum(score) AS BIGINT) AS total
    FROM m GROUP BY key""",
)
def identity_merge(spark, sf):
    merges = domain.sailors(spark, sf).filter("s_suppkey % 10 = 0 and s_suppkey > 0").select(
        F.col("key").alias("old_key"),
        F.concat(F.lit("sup-"), (F.col("s_suppkey") - 9).cast("string")).alias("new_key"),
    )
    e = domain.entries(spark, sf).withColumn("old", F.col("key"))
    return merge_identities(e, merges).groupBy("key").agg(
        F.count("*").alias("entries"), F.count_distinct("old").alias("identities"),
        F.sum("score").alias("total"),
    )


@query(
    "identity_chains", "D12 J08",
    ENTRIES_SQL + """, m AS (SELECT 'sup-' || (CAST(regexp_extract(key, 'sup-(\\d+)', 1) AS INTEGER) // 5 * 5) AS key,
      key AS old, score FROM entries WHERE key LIKE 'sup-%')
    SELECT key, count(*) AS entries, count(DISTINCT old) AS identities, CAST(sum(score) AS BIGINT) AS total
    FROM m GROUP BY key""",
)
def identity_chains(spark, sf):
    """Merges that follow each other: every key ends at the fifth below it."""
    e = domain.entries(spark, sf).filter("key like 'sup-%'").withColumn("old", F.col("key"))
    number = F.regexp_extract("s_key", r"sup-(\d+)", 1).cast("int")
    merges = e.select(F.col("key").alias("s_key")).distinct().withColumn("n", number).filter("n % 5 <> 0")
    # Each step of a chain is there, also over keys without entries.
    steps = merges.select(F.explode(F.sequence(F.floor(F.col("n") / 5) * 5 + 1, F.col("n"))).alias("n"))
    chains = steps.distinct().select(
        F.concat(F.lit("sup-"), F.col("n").cast("string")).alias("old_key"),
        F.concat(F.lit("sup-"), (F.col("n") - 1).cast("string")).alias("new_key"))
    return merge_identities(e, chains).groupBy("key").agg(
        F.count("*").alias("entries"), F.count_distinct("old").alias("identities"),
        F.sum("score").alias("total"),
    )


@query(
    "region_exposure", "D13 D15 F09 F10 E10",
    ENTRIES_SQL + """, r AS (SELECT race, pos, key, CASE WHEN region = 'ASIA' THEN 'AMERICA' ELSE region END
      AS region FROM entries WHERE score IS NOT NULL),
    k AS (SELECT race, pos, count(DISTINCT coalesce(region, '?')) > 1 AS crossed FROM r GROUP BY 1, 2),
    x AS (SELECT a.race, a.pos, a.key, CAST(k.crossed AS INTEGER) AS is_cross,
      CASE WHEN k.crossed THEN count(*) FILTER (b.region <> a.region) ELSE 0 END AS out_links
      FROM r a JOIN k ON a.race = k.race AND a.pos = k.pos
      JOIN r b ON a.race = b.race AND a.pos = b.pos GROUP BY a.race, a.pos, a.key, k.crossed)
    SELECT key, CAST(sum(is_cross) AS BIGINT) AS cross_races, CAST(sum(out_links) AS BIGINT) AS out_links,
      count(*) AS n FROM x GROUP BY key""",
)
def region_exposure(spark, sf):
    e = domain.entries(spark, sf).filter("score is not null").select("race", "pos", "key", "region")
    seen = exposure(merge_regions(e, domain.REGION_ALIAS), ["race", "pos"])
    return seen.groupBy("key").agg(
        F.sum("is_cross").alias("cross_races"), F.sum("out_links").alias("out_links"),
        F.count("*").alias("n"),
    )


@query(
    "outer_join_on_sailor", "D16",
    ENTRIES_SQL + """, a AS (SELECT key, count(*) AS skipper_races FROM entries WHERE pos = 'Skipper' GROUP BY 1),
    b AS (SELECT key, count(*) AS crew_races FROM entries WHERE pos = 'Crew' GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, skipper_races, crew_races FROM a FULL JOIN b ON a.key = b.key""",
)
def outer_join_on_sailor(spark, sf):
    e = domain.entries(spark, sf)
    a = e.filter("pos = 'Skipper'").groupBy("key").agg(
        F.count("*").alias("skipper_races")
    )
    b = e.filter("pos = 'Crew'").groupBy("key").agg(F.count("*").alias("crew_races"))
    return a.join(b, "key", "full")


@query(
    "teams_reindexed", "D17 E03 E04",
    ENTRIES_SQL + """, t AS (SELECT team, count(*) AS n, avg(score) AS a FROM entries WHERE season = 's01' GROUP BY team)
    SELECT r.team, coalesce(n, 0) AS n, coalesce(round(a, 6), 0) AS avg_score, region
    FROM team_regions r LEFT JOIN t ON t.team = r.team""",
)
def teams_reindexed(spark, sf):
    t = domain.entries(spark, sf).filter("season = 's01'").groupBy("team").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("a"), F.lit(True).alias("hit")
    )
    # Absent teams get 0; a present team with a NULL mean keeps it here as 0 too.
    return domain.team_regions(spark, sf).join(t, "team", "left").select(
        "team", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("a", F.lit(0.0)).alias("avg_score"), "region",
    )


@query(
    "ranking_intersection", "D18 H04 I18",
    """WITH a AS (SELECT n_name AS team, row_number() OVER (ORDER BY sum(s_acctbal) DESC, n_name) - 1 AS p
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    b AS (SELECT n_name AS team, row_number() OVER (ORDER BY sum(c_acctbal) DESC, n_name) - 1 AS p
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT a.team, a.p AS first_place, b.p AS second_place FROM a JOIN b ON a.team = b.team""",
)
def ranking_intersection(spark, sf):
    from windlass.plans.boards import rank_pairs

    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    a = table(spark, sf, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).groupBy("team").agg(F.sum("s_acctbal").alias("value"))
    b = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).groupBy("team").agg(F.sum("c_acctbal").alias("value"))
    return rank_pairs(a, b, "team", "value")


@query(
    "last_duplicate_kept", "F13 H02 J17",
    """SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice FROM (SELECT *,
      row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def last_duplicate_kept(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )
    return dedup.keep_last(
        li, ["l_orderkey", "l_suppkey"], [F.col("l_linenumber"), F.col("l_extendedprice")]
    )


@query(
    "first_duplicate_kept", "F14 A13 A16 E24",
    """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders
    GROUP BY o_custkey""",
)
def first_duplicate_kept(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return dedup.keep_first(
        o, ["o_custkey"], [F.col("o_orderdate"), F.col("first_order")]
    ).drop("o_orderdate")


@query(
    "all_duplicates", "F15",
    """SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, count(*) OVER
      (PARTITION BY l_orderkey, l_suppkey) AS n FROM lineitem) WHERE n > 1""",
)
def all_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return dedup.duplicated_rows(li, ["l_orderkey", "l_suppkey"])


@query(
    "upsert_by_key", "H02 F13 B05",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'batch' ELSE 'base' END AS origin
    FROM orders""",
)
def upsert_by_key(spark, sf):
    o = table(spark, sf, "orders")
    base = o.select("o_orderkey", F.lit("base").alias("origin"))
    batch = o.filter("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("batch").alias("origin"))
    return dedup.upsert(base, batch, ["o_orderkey"])


@query(
    "conflicting_positions", "J17 F15",
    """WITH p AS (SELECT l_orderkey, l_suppkey, count(*) FILTER (l_returnflag <> 'N') AS skipper,
      count(*) FILTER (l_returnflag = 'N') AS crew FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_suppkey, skipper, crew, skipper > 0 AND crew > 0 AS both_positions
    FROM p WHERE skipper + crew > 1""",
)
def conflicting_positions(spark, sf):
    """Same person twice in one race: skipper and crew, or two boats."""
    crew = F.col("l_returnflag") == "N"
    p = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.count_if(~crew).alias("skipper"), F.count_if(crew).alias("crew")
    )
    return p.filter("skipper + crew > 1").withColumn(
        "both_positions", (F.col("skipper") > 0) & (F.col("crew") > 0)
    )


@query(
    "group_validity", "C18 F08",
    ENTRIES_SQL + """SELECT race, pos, count(*) AS racers, count(score) AS scored FROM entries
      GROUP BY 1, 2 HAVING count(score) >= 2""",
)
def group_validity(spark, sf):
    return domain.entries(spark, sf).groupBy("race", "pos").agg(
        F.count("*").alias("racers"), F.count("score").alias("scored")
    ).filter("scored >= 2")


@query(
    "women_regattas", "E06 J07 C22",
    ENTRIES_SQL + """, p AS (SELECT DISTINCT regatta, pos, key, gender FROM entries)
    SELECT regatta, count(*) FILTER (gender = 'F') AS women,
      count(*) FILTER (gender = 'F') >= 4 AND count(*) FILTER (gender = 'M') = 0 AS womens
    FROM p GROUP BY regatta""",
)
def women_regattas(spark, sf):
    from windlass.plans.unify import fleet_women

    return fleet_women(domain.entries(spark, sf))


@query(
    "team_race_women", "E06 J07",
    MATCHES_SQL + """SELECT regatta, count(*) FILTER (gender = 'F') AS women,
      count(*) FILTER (gender = 'F') >= 4 AND count(*) FILTER (gender = 'M') = 0 AS womens
    FROM members GROUP BY regatta""",
)
def team_race_women(spark, sf):
    from windlass.plans.unify import match_women

    return match_women(domain.match_members(spark, sf))


@query(
    "season_position_counts", "E12 E02",
    ENTRIES_SQL + """SELECT key, season, count(*) FILTER (pos = 'Skipper') AS skipper,
      count(*) FILTER (pos = 'Crew') AS crew FROM entries GROUP BY 1, 2""",
)
def season_position_counts(spark, sf):
    e = domain.entries(spark, sf)
    return e.groupBy("key", "season").agg(
        F.count_if(F.col("pos") == "Skipper").alias("skipper"),
        F.count_if(F.col("pos") == "Crew").alias("crew"),
    )


@query(
    "position_pivot", "E12 E26",
    ENTRIES_SQL + """SELECT key, season, avg(score) FILTER (pos = 'Skipper') AS "Skipper",
      avg(score) FILTER (pos = 'Crew') AS "Crew" FROM entries GROUP BY 1, 2""",
)
def position_pivot(spark, sf):
    return domain.entries(spark, sf).groupBy("key", "season").pivot(
        "pos", ["Skipper", "Crew"]
    ).agg(F.avg("score"))


@query(
    "wide_to_long", "E27 E26",
    ENTRIES_SQL + """SELECT key, season, count(score) AS n FROM entries
      GROUP BY 1, 2 HAVING count(score) > 0""",
)
def wide_to_long(spark, sf):
    """One column per season, then back to rows without the empty cells."""
    # The seasons of a calendar: two a year, so the list is short.
    years = table(spark, sf, "orders").agg(
        F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    seasons = [f"{h}{y % 100:02d}" for y in range(years[0], years[1] + 1) for h in "fs"]
    wide = domain.entries(spark, sf).filter("score is not null").groupBy("key").pivot(
        "season", seasons
    ).agg(F.count("score"))
    return wide.unpivot("key", seasons, "season", "n").filter("n is not null")


@query(
    "ordered_unique_lists", "E08 F11 I16",
    ENTRIES_SQL + """, f AS (SELECT key, pos, season, min((date, race_no)) AS first FROM entries GROUP BY 1, 2, 3)
    SELECT key, pos, string_agg(season, ',' ORDER BY first) AS seasons FROM f GROUP BY 1, 2""",
)
def ordered_unique_lists(spark, sf):
    """Seasons per sailor and position in order of first appearance.

    Distinct first, so a list holds one item per season however many races.
    """
    first = domain.entries(spark, sf).groupBy("key", "pos", "season").agg(
        F.min(F.struct("date", "race_no")).alias("first")
    )
    lists = first.groupBy("key", "pos").agg(
        F.array_sort(F.collect_list(F.struct("first", "season"))).alias("s")
    )
    return lists.select("key", "pos", F.array_join(F.col("s.season"), ",").alias("seasons"))


@query(
    "distinct_race_count", "E07 E09",
    ENTRIES_SQL + "SELECT regatta, count(DISTINCT race) AS races, count(DISTINCT key) AS sailors FROM entries GROUP BY 1",
)
def distinct_race_count(spark, sf):
    return domain.entries(spark, sf).groupBy("regatta").agg(
        F.count_distinct("race").alias("races"), F.count_distinct("key").alias("sailors")
    )


@query(
    "first_names", "E19 I07 G02",
    """SELECT split_part(p_name, ' ', 1) AS name, count(*) AS n FROM part GROUP BY 1
    ORDER BY n DESC, name LIMIT 50""",
)
def first_names(spark, sf):
    return table(spark, sf, "part").groupBy(
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")
    ).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(50)


@query(
    "min_max_scaled", "E20",
    """SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier))
      / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)) * 10000, 4) AS scaled
    FROM supplier""",
)
def min_max_scaled(spark, sf):
    from windlass.plans.boards import min_max

    return min_max(
        table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "scaled", 10_000.0
    ).select("s_suppkey", F.round("scaled", 4).alias("scaled"))


@query(
    "rating_histogram", "E21",
    """SELECT CAST(floor(o_totalprice / 30000) AS BIGINT) * 30000 AS bin, count(*) AS n,
      round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""",
)
def rating_histogram(spark, sf, width=30_000):
    return table(spark, sf, "orders").groupBy(
        (F.floor(F.col("o_totalprice") / width) * width).alias("bin")
    ).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "rating_histogram_fit", "E21 I12 I15",
    ALL_SQL + """, v AS (SELECT pool, mu - 3 * sigma AS x FROM state),
    m AS (SELECT pool, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS low, max(x) AS high FROM v GROUP BY pool),
    b AS (SELECT pool, n, mean, sd, low, (high - low) / 30 AS width, unnest(range(30)) AS bin FROM m)
    SELECT b.pool, CAST(b.bin AS INTEGER) AS bin, round(b.low + b.bin * width, 6) AS start, coalesce(c.n, 0) AS n,
      round(b.n * width * exp(-0.5 * ((b.low + (b.bin + 0.5) * width - mean) / nullif(sd, 0)) ** 2)
        / (nullif(sd, 0) * sqrt(2 * pi())), 5) AS expected
    FROM b LEFT JOIN (SELECT v.pool, CASE WHEN high = low THEN 0 ELSE least(CAST(floor((x - low) / (high - low) * 30) AS INTEGER), 29) END AS bin, count(*) AS n
      FROM v JOIN m USING (pool) GROUP BY 1, 2) c ON c.pool = b.pool AND c.bin = b.bin""",
)
def rating_histogram_fit(spark, sf):
    """Ratings of each pool in 30 equal bins, and the counts a normal
    distribution of the same mean and spread would give."""
    fleet = cut_lineage(domain.entries(spark, sf))
    members = cut_lineage(domain.match_members(spark, sf))
    state = domain.static_state(spark, sf, fleet, members)
    rated = state.select("pool", (F.col("mu") - 3 * F.col("sigma")).alias("x"))
    return normal_histogram(rated, ["pool"], "x", 30).select(
        "pool", "bin", F.round("start", 6).alias("start"), "n", F.round("expected", 5).alias("expected"))


@query(
    "team_mean_over_members", "E23 E25 I16",
    SAILORS_WITH + """, x AS (SELECT unnest([team, region]) AS grp, s_acctbal FROM sailors)
    SELECT grp, count(*) AS n, round(avg(s_acctbal), 6) AS mean FROM x WHERE grp IS NOT NULL GROUP BY 1""",
)
def team_mean_over_members(spark, sf):
    return domain.sailors(spark, sf).select(
        F.explode(F.array("team", "region")).alias("grp"), "s_acctbal"
    ).filter("grp is not null").groupBy("grp").agg(
        F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean")
    )


@query(
    "position_share", "E11 E14 E16",
    ENTRIES_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY race, pos) AS field FROM entries WHERE score IS NOT NULL)
    SELECT key, round(avg(CASE WHEN pos = 'Skipper' THEN 1 - (score - 1) / (field - 1.0) END), 6) AS skipper_ratio,
      round(avg(CASE WHEN pos = 'Crew' THEN 1 - (score - 1) / (field - 1.0) END), 6) AS crew_ratio
    FROM n WHERE field > 1 GROUP BY key""",
)
def position_share(spark, sf):
    from windlass.plans.history import finish_ratio

    e = finish_ratio(domain.entries(spark, sf).filter("score is not null"), ["race", "pos"])
    return e.filter("field > 1").groupBy("key").agg(
        F.round(F.avg(F.when(F.col("pos") == "Skipper", F.col("ratio"))), 6).alias("skipper_ratio"),
        F.round(F.avg(F.when(F.col("pos") == "Crew", F.col("ratio"))), 6).alias("crew_ratio"),
    )


@query(
    "field_attach", "F07 F08 I22",
    ENTRIES_SQL + """SELECT race_id, pos, key, count(*) OVER (PARTITION BY race, pos) AS field,
      round(1 - (score - 1) / nullif(count(*) OVER (PARTITION BY race, pos) - 1.0, 0), 6) AS ratio,
      round(1 - score / CAST(count(*) OVER (PARTITION BY race, pos) AS DOUBLE), 6) AS old_ratio
    FROM entries WHERE score IS NOT NULL""",
)
def field_attach(spark, sf):
    e = domain.entries(spark, sf).filter("score is not null").select("race", "race_id", "pos", "key", "score")
    sized = attach(e, ["race", "pos"], F.count("*").alias("field"))
    return sized.select(
        "race_id", "pos", "key", "field",
        F.round(1 - F.try_divide(F.col("score") - 1, F.col("field") - 1), 6).alias("ratio"),
        F.round(1 - F.col("score") / F.col("field"), 6).alias("old_ratio"),
    )


@query(
    "loss_graph_page_rank", "J18",
    ENTRIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (
      SELECT race, pos, arg_min(key, (score, key)) AS dst FROM entries WHERE score IS NOT NULL GROUP BY 1, 2),
    edges AS (SELECT key AS src, dst, count(*) AS weight FROM entries e JOIN w ON e.race = w.race AND e.pos = w.pos
      WHERE score IS NOT NULL AND key <> dst GROUP BY 1, 2),
    links AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
    nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    ranks AS (SELECT 0 AS i, node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes
      UNION ALL
      SELECT i + 1, n.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(n.inflow, 0)
        + n.loose / (SELECT count(*) FROM nodes))
      FROM (SELECT max(r.i) AS i, nodes.node, sum(r.rank * l.share) AS inflow,
          max(r.loose) AS loose
        FROM nodes CROSS JOIN (SELECT *, coalesce(sum(CASE WHEN node NOT IN (SELECT src FROM edges)
            THEN rank END) OVER (), 0) AS loose FROM ranks) r
        LEFT JOIN links l ON l.src = r.node AND l.dst = nodes.node
        GROUP BY nodes.node) n WHERE i < 60)
    SELECT node, round(rank, 9) AS rank FROM ranks WHERE i = 60""",
)
def loss_graph_page_rank(spark, sf):
    """Each loser points to the winner of the race, weighted by how often."""
    e = domain.entries(spark, sf).filter("score is not null").select("race", "pos", "key", "score")
    winners = e.groupBy("race", "pos").agg(F.min_by("key", F.struct("score", "key")).alias("dst"))
    edges = e.join(winners, ["race", "pos"]).filter(F.col("key") != F.col("dst")).groupBy(
        F.col("key").alias("src"), "dst"
    ).agg(F.count("*").cast("double").alias("weight"))
    return page_rank(edges, tolerance=1e-13).select("node", F.round("rank", 9).alias("rank"))


@query(
    "linked_sailors", "J02",
    ENTRIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, hub AS (SELECT regatta, min(key) AS b FROM entries GROUP BY 1),
    near AS (SELECT DISTINCT key AS a, b FROM entries JOIN hub USING (regatta)),
    both_ways AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
    found(node, component) USING KEY (node) AS (SELECT a, a FROM both_ways
      UNION SELECT e.b, min(f.component) FROM found f JOIN both_ways e ON f.node = e.a
        JOIN recurring.found r ON r.node = e.b WHERE f.component < r.component GROUP BY e.b)
    SELECT node AS sailor, component FROM found""",
)
def linked_sailors(spark, sf):
    """Sailors joined by common regattas, with the least of each group."""
    e = domain.entries(spark, sf)
    hub = e.groupBy("regatta").agg(F.min("key").alias("b"))
    edges = e.join(hub, "regatta").select(F.col("key").alias("a"), "b").distinct()
    return connected_components(edges).select(F.col("node").alias("sailor"), "component")
