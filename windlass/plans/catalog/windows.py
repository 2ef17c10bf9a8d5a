"""Window and analytic queries along the processing order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windlass.operators.groups import hot_groups, rank_in_group, top_k
from windlass.operators.head_to_head import (
    fleet_everyone, fleet_head_to_head, match_everyone, match_head_to_head, win_ratios,
)
from windlass.operators.ordering import latest_before
from windlass.plans import domain
from windlass.plans.boards import leaderboards, pool_ranks
from windlass.plans.catalog import fold_sql
from windlass.plans.domain import ALL_SQL, ENTRIES_SQL, SAILORS_SQL, table
from windlass.plans.history import many_events, rating_events, regatta_average, snapshots
from windlass.plans.rating_run import FLEET_COLUMNS, MEMBER_COLUMNS, ordered_log, rate_log
from windlass.plans.registry import query
from windlass.plans.unify import POOLS
from windlass.session import cut_alone, cut_lineage

SAILORS_WITH = "WITH " + SAILORS_SQL.strip()

def _rated(spark, sf):
    """The ordered fold, stored, and the order."""
    fleet, members = domain.logs(spark, sf, FLEET_COLUMNS, MEMBER_COLUMNS)
    order = cut_alone(spark, lambda: ordered_log(fleet, members))
    return rate_log(fleet, members, order, stored=True), order


@query("as_of_snapshots", "F02 J06", fold_sql.AS_OF)
def as_of_snapshots(spark, sf):
    rated, _ = _rated(spark, sf)
    # Rounded once: a rating is then carried along as it is.
    events = rating_events(rated).drop("change").withColumn("rating", F.round("rating", 4))
    return snapshots(events, spread=many_events(rated)).select("race", "key", "pool", *POOLS)


@query("rating_changes", "F01", fold_sql.CHANGES)
def rating_changes(spark, sf):
    rated, _ = _rated(spark, sf)
    e = rating_events(rated).drop("change").withColumn("previous", F.col("rating"))
    before = latest_before(
        e, ["key", "pool"], ["seq", "step"], ["previous"], inclusive=False,
        spread=many_events(rated))
    change = F.col("rating") - F.coalesce("previous", F.lit(1000.0))
    return before.select("race", "key", "pool", F.round(change, 4).alias("change"))


@query("regatta_averages", "E05 J06 Q1 Q2", fold_sql.AVERAGES)
def regatta_averages(spark, sf):
    rated, order = _rated(spark, sf)
    e = rating_events(rated, order)
    people = e.select("regatta", "regatta_seq", "pool", "key").distinct()
    return regatta_average(people, rating_events(rated), spread=many_events(rated)).select(
        "regatta", F.round("regatta_avg", 4).alias("regatta_avg"))


@query(
    "weeks_since_last_race", "F12 J15",
    ENTRIES_SQL + """SELECT race_id, pos, key, CAST(floor(date_diff('day', lag(date) OVER
      (PARTITION BY key ORDER BY date, race_no), date) / 7.0) AS BIGINT) AS weeks FROM entries""",
)
def weeks_since_last_race(spark, sf):
    """Gap to the sailor's previous race; scanned in half-year chunks."""
    e = domain.entries(spark, sf).withColumn("last", F.col("date"))
    seen = latest_before(
        e, ["key"], ["date", "race_no"], ["last"], inclusive=False, suffix="_seen",
        chunk=F.year("date") * 2 + F.floor((F.month("date") - 1) / 6),
    )
    return seen.select(
        "race_id", "pos", "key", F.floor(F.datediff("date", "last_seen") / 7).alias("weeks")
    )


@query(
    "carried_down_cells", "F17 A12",
    """WITH x AS (SELECT l_orderkey, l_extendedprice, CASE WHEN l_linenumber % 3 = 1 THEN l_linestatus END AS cell
      FROM lineitem)
    SELECT l_orderkey, l_extendedprice, last_value(cell IGNORE NULLS) OVER (PARTITION BY l_orderkey
      ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS division FROM x""",
)
def carried_down_cells(spark, sf):
    x = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_extendedprice",
        F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linestatus")).alias("division"),
    )
    return latest_before(
        x, ["l_orderkey"], ["l_extendedprice"], ["division"],
        chunk=F.floor(F.col("l_extendedprice") / 10_000),
    )


@query(
    "last_wins_by_sailor", "F18 F13",
    ENTRIES_SQL + """SELECT key, arg_max(race_id, (date, race_no)) AS last_race,
      arg_max(team, (date, race_no)) AS team, CAST(max(date) AS DATE) AS last_date FROM entries GROUP BY key""",
)
def last_wins_by_sailor(spark, sf):
    stamp = F.struct("date", "race_no")
    return domain.entries(spark, sf).groupBy("key").agg(
        F.max_by("race_id", stamp).alias("last_race"), F.max_by("team", stamp).alias("team"),
        F.max("date").alias("last_date"),
    )


@query(
    "dense_rank_by_position", "F04 G02",
    ENTRIES_SQL + """, t AS (SELECT key, pos, count(*) AS n FROM entries GROUP BY 1, 2)
    SELECT key, pos, n, dense_rank() OVER (PARTITION BY pos ORDER BY n DESC) AS rank FROM t""",
)
def dense_rank_by_position(spark, sf):
    """Dense rank = rank among the distinct values, joined back."""
    t = domain.entries(spark, sf).groupBy("key", "pos").agg(F.count("*").alias("n"))
    values = t.select("pos", "n").distinct()
    ranks = rank_in_group(values, ["pos"], "n", "rank", hot=hot_groups(values, ["pos"]))
    return t.join(ranks, ["pos", "n"]).select("key", "pos", "n", "rank")


@query(
    "race_sort", "G01 G07",
    ENTRIES_SQL + """SELECT date, race_no, div, pos, key, score FROM entries
      ORDER BY date NULLS LAST, race_no NULLS LAST, div NULLS LAST, pos, key""",
)
def race_sort(spark, sf):
    return domain.entries(spark, sf).select(
        "date", "race_no", "div", "pos", "key", "score"
    ).orderBy(
        F.asc_nulls_last("date"), F.asc_nulls_last("race_no"), F.asc_nulls_last("div"), "pos", "key"
    )


@query(
    "most_raced", "G02 G05",
    ENTRIES_SQL + "SELECT key, count(*) AS num_races FROM entries GROUP BY key ORDER BY num_races DESC, key",
)
def most_raced(spark, sf):
    return domain.entries(spark, sf).groupBy("key").agg(F.count("*").alias("num_races")).orderBy(
        F.desc("num_races"), "key"
    )


@query(
    "top_three_per_team", "G04",
    SAILORS_WITH + """ SELECT team, key, place FROM (SELECT team, key, row_number() OVER (PARTITION BY team
      ORDER BY s_acctbal DESC, key) AS place FROM sailors) WHERE place <= 3""",
)
def top_three_per_team(spark, sf):
    return top_k(
        domain.sailors(spark, sf), ["team"], [F.desc("s_acctbal"), F.col("key")], 3, "place"
    ).select("team", "key", "place")


@query(
    "fixed_size_batches", "G08",
    """SELECT o_custkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)
      / 5) AS BIGINT) AS batch, count(*) AS n FROM orders GROUP BY o_custkey, o_orderkey, o_orderdate""",
)
def fixed_size_batches(spark, sf, size=5):
    """Batch number of each order of a customer, `size` per batch."""
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day")
    )
    ranked = rank_in_group(
        o, ["o_custkey"], "day", "place", ["o_orderkey"], descending=False,
        hot=hot_groups(o, ["o_custkey"]),
    )
    return ranked.select(
        "o_custkey", F.floor((F.col("place") - 1) / size).alias("batch"),
        F.lit(1).cast("bigint").alias("n"),
    )


@query(
    "user_sessions", "F12 I09",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END
        AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, CAST(sum(gap) + 1 AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
)
def user_sessions(spark, sf):
    """Gaps of more than 12 hours, scanned in day chunks."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("last", F.col("ts"))
    seen = latest_before(
        e, ["user_id"], ["ts", "event_id"], ["last"], inclusive=False, suffix="_seen",
        chunk=F.unix_date(F.to_date("ts")),
    )
    gap = F.unix_micros("ts") - F.unix_micros("last_seen") > 12 * 3600 * 1_000_000
    return seen.groupBy("user_id").agg(
        (F.count_if(gap) + 1).alias("sessions"), F.count("*").alias("events")
    )


def _board_keys(spark, sf, fleet):
    members = cut_lineage(
        domain.match_members(spark, sf).select(*domain.STATE_MEMBER_COLUMNS))
    state = domain.static_state(spark, sf, fleet, members)
    ranks = pool_ranks(
        state, domain.people(spark, sf, fleet), domain.TARGET_SEASONS,
        domain.TARGET_MATCH_SEASONS, domain.GRAD_CUTOFF,
    )
    board = leaderboards(ranks, domain.TARGET_SEASONS, domain.TARGET_MATCH_SEASONS)
    return members, cut_lineage(board.select("key").distinct())


_FOCUS_SQL = ALL_SQL + """, focus AS (SELECT DISTINCT key FROM ranks WHERE rank BETWEEN 1 AND 100
    AND CASE WHEN pool LIKE '%t%' THEN list_has_any(place, ['s01']) ELSE list_has_any(place, ['f00', 's01']) END)"""


@query(
    "fleet_head_to_head", "D13 E13 E14 I17 Q33",
    _FOCUS_SQL + """, e AS (SELECT race, pos, season, key, score FROM entries WHERE score IS NOT NULL),
    t AS (SELECT a.key, a.pos, b.key AS rival, count(*) AS races, count(*) FILTER (b.score > a.score) AS wins
      FROM e a JOIN focus f ON a.key = f.key JOIN e b ON a.race = b.race AND a.pos = b.pos AND a.key <> b.key
      GROUP BY 1, 2, 3)
    SELECT key, pos, rival, races, wins, round(wins / races, 8) AS win_ratio FROM t""",
)
def fleet_rivals(spark, sf):
    """Leaderboard sailors against everyone they met."""
    fleet = cut_lineage(domain.entries(spark, sf).select(*domain.STATE_COLUMNS))
    _, focus = _board_keys(spark, sf, fleet)
    totals = fleet_head_to_head(fleet.filter("score is not null"), focus, ["race", "pos"])
    return win_ratios(totals).select(
        "key", "pos", "rival", "races", "wins", F.round("win_ratio", 8).alias("win_ratio")
    )


@query(
    "match_head_to_head", "D14 E13",
    _FOCUS_SQL + """ SELECT a.key, a.pos, b.key AS rival, a.season, count(*) AS races,
      count(*) FILTER (a.outcome = 'win') AS wins
    FROM members a JOIN focus f ON a.key = f.key JOIN members b ON a.race = b.race AND a.pos = b.pos
      AND a.side <> b.side GROUP BY 1, 2, 3, 4""",
)
def match_rivals(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf).select(*domain.STATE_COLUMNS))
    members, focus = _board_keys(spark, sf, fleet)
    return match_head_to_head(members, focus, ["race", "pos"])


@query(
    "fleet_head_to_head_seasons", "D13 E13 Q33",
    ENTRIES_SQL + """, e AS (SELECT race, pos, season, key, score FROM entries WHERE score IS NOT NULL)
    SELECT a.key, a.pos, b.key AS rival, a.season, count(*) AS races, count(*) FILTER (b.score > a.score) AS wins
    FROM e a JOIN e b ON a.race = b.race AND a.pos = b.pos AND a.key <> b.key GROUP BY 1, 2, 3, 4""",
)
def fleet_rivals_of_everyone(spark, sf):
    fleet = cut_lineage(domain.entries(spark, sf).select(
        "regatta", "race", "pos", "season", "key", "score"))
    return fleet_everyone(fleet, ["race", "pos"])


@query(
    "match_head_to_head_seasons", "D14 E13",
    ALL_SQL + """ SELECT a.key, a.pos, b.key AS rival, a.season, count(*) AS races,
      count(*) FILTER (a.outcome = 'win') AS wins
    FROM members a JOIN members b ON a.race = b.race AND a.pos = b.pos AND a.side <> b.side
      AND a.key <> b.key GROUP BY 1, 2, 3, 4""",
)
def match_rivals_of_everyone(spark, sf):
    members = cut_lineage(domain.match_members(spark, sf).select(
        "regatta", "race", "pos", "season", "key", "side", "outcome"))
    return match_everyone(members, ["race", "pos"])


@query(
    "rank_matrix", "F06 E26 D17",
    """WITH m AS (SELECT n_name AS team, strftime(o_orderdate, '%Y') AS date, sum(o_totalprice) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY 1, 2),
    r AS (SELECT team, date, row_number() OVER (PARTITION BY date ORDER BY round(v, 2) DESC, team) AS rank FROM m),
    grid AS (SELECT t.team, d.date FROM (SELECT DISTINCT team FROM r) t, (SELECT DISTINCT date FROM r) d)
    SELECT team, string_agg(coalesce(CAST(rank AS VARCHAR), '-'), ',' ORDER BY date) AS ranks
    FROM grid LEFT JOIN r USING (team, date) GROUP BY team""",
)
def rank_matrix(spark, sf):
    from windlass.plans.rollups import rank_history

    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    m = (
        table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("team", F.date_format("o_orderdate", "yyyy").alias("date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    )
    ranked = rank_in_group(m, ["date"], "v", "rank", ["team"])
    history = rank_history(ranked.select("date", "team", "rank"))
    marks = F.transform("history", lambda h: F.coalesce(h["rank"].cast("string"), F.lit("-")))
    return history.select("team", F.array_join(marks, ",").alias("ranks"))


@query(
    "rating_lines", "E27 F02 J12",
    ENTRIES_SQL + """SELECT key, pos, season, round(avg(score), 6) AS mean_score,
      round(avg(avg(score)) OVER (PARTITION BY key, pos ORDER BY right(season, 2), season DESC
        ROWS UNBOUNDED PRECEDING), 6) AS running FROM entries WHERE score IS NOT NULL GROUP BY 1, 2, 3""",
)
def rating_lines(spark, sf):
    """Series over time per sailor: one point per season, with a running mean."""
    t = domain.entries(spark, sf).filter("score is not null").groupBy("key", "pos", "season").agg(
        F.avg("score").alias("mean_score")
    )
    # At most one row per season in a group.
    w = Window.partitionBy("key", "pos").orderBy(
        F.substring("season", 2, 2), F.desc("season")
    ).rowsBetween(Window.unboundedPreceding, 0)
    return t.select(
        "key", "pos", "season", F.round("mean_score", 6).alias("mean_score"),
        F.round(F.avg("mean_score").over(w), 6).alias("running"),
    )
