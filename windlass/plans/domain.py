"""Race tables derived from the star-schema tables, in Spark and in SQL.

An order is a race, a supplier a sailor, its nation the team, a line item an
entry. Orders of the two most urgent priorities are sailed as two events, one
for women and one open, so the women's rating pools are used too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlass.functions import ids
from windlass.operators.dedup import keep_last
from windlass.operators.groups import HOT_GROUP_ROWS, attach, hot_groups, rank_in_group
from windlass.session import cut_lineage

URGENT = ["1-URGENT", "2-HIGH"]
REGION_ALIAS = {"ASIA": "AMERICA"}
TARGET_SEASONS = ["f00", "s01"]
TARGET_MATCH_SEASONS = ["s01"]
GRAD_CUTOFF = 2022
# What `static_state`, `people` and the head-to-head counts read of an entry, and of
# a team race member.
STATE_COLUMNS = ["regatta", "race", "pos", "key", "gender", "region", "season", "score"]
STATE_MEMBER_COLUMNS = ["regatta", "race", "pos", "key", "gender", "season", "side", "outcome"]
# Line items that one task joins, sorts and groups by race.
TASK_LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def team_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("team"), F.nullif("r_name", F.lit("AFRICA")).alias("region")
    )


def _join_sailors(df: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Adds the supplier's sailor columns. The three tables are joined one by
    one: the planner then knows each size and broadcasts what is small."""
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal"
    )
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    n = F.col("s_suppkey")
    link = F.when(n % 10 != 0, F.concat(F.lit("sup-"), n.cast("string")))
    gender = F.when(n % 2 == 1, "F").when(n % 10 != 0, "M")
    full = (F.lit(2020) + n % 10).cast("string")
    year = F.when(n % 4 == 0, F.concat(F.substring(full, 3, 2), F.lit(" Jr"))).otherwise(full)
    joined = supplier if key == "s_suppkey" else df.join(supplier, F.col(key) == n)
    return (
        joined.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns({
            "key": ids.surrogate_key(link, F.col("s_name"), F.col("n_name")),
            "name": F.col("s_name"), "link": link, "team": F.col("n_name"),
            "region": F.nullif("r_name", F.lit("AFRICA")), "gender": gender, "year": year,
        })
    )


SAILOR_COLUMNS = ["s_suppkey", "key", "name", "link", "team", "region", "gender", "year", "s_acctbal"]


def sailors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sailor dimension: every tenth sailor has no page link and no gender."""
    return _join_sailors(None, spark, sf_dir, "s_suppkey").select(*SAILOR_COLUMNS)


def _hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_no"))
    return hot_groups(lines, ["race_no"], HOT_GROUP_ROWS)


def _by_order(lines: DataFrame) -> DataFrame:
    """Lines dealt out by order. Beyond a task's worth for each core the number of
    tasks follows the number of rows, so no task grows with the table."""
    tasks = -(-lines.count() // TASK_LINES)
    if tasks <= lines.sparkSession.sparkContext.defaultParallelism:
        return lines.repartition("l_orderkey")
    return lines.repartition(tasks, "l_orderkey")


def _deduped_lines(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    # One shuffle by order serves the join, the dedup and the race windows. When
    # some order is very large (`spread`) the dedup combines before its own
    # shuffle by (order, supplier) instead.
    lines = lines if spread else _by_order(lines)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    return keep_last(
        joined, ["l_orderkey", "l_suppkey"], [F.col("l_linenumber"), F.col("l_extendedprice")]
    )


def _events(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    lines = _join_sailors(_deduped_lines(spark, sf_dir, spread), spark, sf_dir, "l_suppkey")
    women = F.col("o_orderpriority").isin(URGENT) & (F.col("gender") == "F")
    return lines.select(
        F.col("l_orderkey").alias("race_no"), *SAILOR_COLUMNS, "l_extendedprice", "l_tax",
        F.when(F.col("l_returnflag") == "N", "Crew").otherwise("Skipper").alias("pos"),
        F.to_date("o_orderdate").alias("date"), ids.season_code(F.col("o_orderdate")).alias("season"),
        F.concat((F.col("o_custkey") % 50).cast("string"), F.when(women, "-w").otherwise("")).alias("club"),
        F.concat(F.lit("V"), (F.col("o_custkey") % 7).cast("string")).alias("venue"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("div"),
    )


def _named(rows: DataFrame, letter: str) -> DataFrame:
    """Adds the names of regatta and race: fleet (c) or team racing (t)."""
    return rows.withColumn(
        "regatta", F.concat("season", F.lit(f"/{letter}"), "club")
    ).withColumn("race", F.concat_ws("/", "regatta", F.col("race_no").cast("string")))


def _with_score(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("_price", F.floor(F.col("l_extendedprice") / 1000))
    if hot is not None:
        hot = rows.join(hot, "race_no").select("race_no", "race", "pos", "_n").distinct()
    ranked = rank_in_group(rows, ["race_no", "race", "pos"], "_price", "_place", hot=hot)
    return ranked.withColumn("score", F.when(F.col("l_tax") != 0.08, F.col("_place")))


def _with_outcome(rows: DataFrame, spread: bool) -> DataFrame:
    """Adds win or lose; NULL where a side has nobody."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    first = F.col("div") == "A"
    sums = {"_a": F.sum(F.when(first, cents)), "_b": F.sum(F.when(F.col("div") == "B", cents))}
    keys = ["race_no", "race"]
    if spread:
        rows = attach(rows, keys, *[v.alias(c) for c, v in sums.items()])
    else:
        race = Window.partitionBy(*keys)
        rows = rows.withColumns({c: v.over(race) for c, v in sums.items()})
    mine = F.when(first, F.col("_a")).otherwise(F.col("_b"))
    theirs = F.when(first, F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("outcome", F.when(
        F.col("_a").isNotNull() & F.col("_b").isNotNull(),
        F.when(mine > theirs, "win").otherwise("lose")))


ENTRY_COLUMNS = [
    "race_no", "race", "race_id", "div", "key", "name", "link", "team", "region", "gender", "year",
    "pos", "score", "date", "season", "regatta", "venue", "scoring",
]
MATCH_COLUMNS = [
    "race_no", "race", "side", "key", "name", "team", "region", "gender", "pos", "date", "season",
    "regatta", "venue", "outcome",
]


def _entries(scored: DataFrame, columns: Sequence[str] = ENTRY_COLUMNS) -> DataFrame:
    return scored.withColumns({
        "race_id": F.concat("race", "div"), "scoring": F.lit("Combined"),
    }).select(*columns)


def _members(decided: DataFrame, columns: Sequence[str] = MATCH_COLUMNS) -> DataFrame:
    return decided.filter("outcome is not null").withColumn("side", F.col("div")).select(*columns)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet race entries; a NULL score is a race the boat did not finish."""
    hot = _hot_orders(spark, sf_dir)
    return _entries(_with_score(_named(_events(spark, sf_dir, hot is not None), "c"), hot))


def match_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team race members: side A or B, decided by the summed price."""
    spread = _hot_orders(spark, sf_dir) is not None
    return _members(_with_outcome(_named(_events(spark, sf_dir, spread), "t"), spread))


def logs(
    spark: SparkSession, sf_dir: str, fleet_columns: Sequence[str] = ENTRY_COLUMNS,
    member_columns: Sequence[str] = MATCH_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """The given columns of `entries` and `match_members`, stored. Both come of the
    same lines, which are joined, sorted and stored once: a race of either kind is the
    same rows, only its name differs."""
    hot = _hot_orders(spark, sf_dir)
    if hot is not None:
        return (cut_lineage(entries(spark, sf_dir).select(*fleet_columns)),
                cut_lineage(match_members(spark, sf_dir).select(*member_columns)))
    rows = _with_outcome(_with_score(_named(_events(spark, sf_dir, False), "c"), None), False)
    asked = {"race_no", "season", "club", "div", "outcome", *fleet_columns, *member_columns}
    stored = cut_lineage(rows.drop("regatta", "race").select(
        *[c for c in rows.columns if c in asked - {"regatta", "race"}]))
    return (_entries(_named(stored, "c"), fleet_columns),
            _members(_named(stored, "t"), member_columns))


SAILORS_SQL = """
team_regions AS (
  SELECT n_name AS team, nullif(r_name, 'AFRICA') AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
sailors AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN 'sup-' || s_suppkey
                         ELSE s_name || '-' || n_name END AS key,
    s_name AS name, CASE WHEN s_suppkey % 10 <> 0 THEN 'sup-' || s_suppkey END AS link,
    n_name AS team, region,
    CASE WHEN s_suppkey % 2 = 1 THEN 'F' WHEN s_suppkey % 10 <> 0 THEN 'M' END AS gender,
    CASE WHEN s_suppkey % 4 = 0 THEN CAST(20 + s_suppkey % 10 AS VARCHAR) || ' Jr'
         ELSE CAST(2020 + s_suppkey % 10 AS VARCHAR) END AS year, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN team_regions ON team = n_name)"""

_EVENTS_SQL = """
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey
      ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1),
events_all AS (
  SELECT l_orderkey AS race_no, s.key, s.name, s.link, s.team, s.region, s.gender, s.year,
    s.s_acctbal, l_extendedprice, l_tax, l_linestatus,
    CASE WHEN l_returnflag = 'N' THEN 'Crew' ELSE 'Skipper' END AS pos,
    CAST(o_orderdate AS DATE) AS date,
    (CASE WHEN month(o_orderdate) <= 6 THEN 's' ELSE 'f' END)
      || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS season,
    'V' || (o_custkey % 7) AS venue, o_custkey % 50 AS club,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND s.gender = 'F'
         THEN '-w' ELSE '' END AS kind
  FROM kept JOIN orders ON l_orderkey = o_orderkey JOIN sailors s ON l_suppkey = s_suppkey)"""

ENTRIES_SQL = (
    "WITH " + SAILORS_SQL.strip() + "," + _EVENTS_SQL + """,
placed AS (
  SELECT *, season || '/c' || club || kind AS regatta,
    rank() OVER (PARTITION BY race_no, kind, pos
                 ORDER BY floor(l_extendedprice / 1000) DESC) AS place
  FROM events_all),
entries AS (
  SELECT race_no, regatta || '/' || race_no AS race,
    regatta || '/' || race_no || CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS race_id,
    CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS div,
    key, name, link, team, region, gender, year, pos,
    CASE WHEN l_tax <> 0.08 THEN CAST(place AS INTEGER) END AS score,
    date, season, regatta, venue, 'Combined' AS scoring
  FROM placed)
"""
)

MATCHES_SQL = (
    "WITH " + SAILORS_SQL.strip() + "," + _EVENTS_SQL + """,
sided AS (
  SELECT *, season || '/t' || club || kind AS regatta,
    CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS side,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM events_all),
sums AS (
  SELECT race_no, regatta, sum(CASE WHEN side = 'A' THEN cents END) AS a,
    sum(CASE WHEN side = 'B' THEN cents END) AS b FROM sided GROUP BY 1, 2),
members AS (
  SELECT x.race_no, x.regatta || '/' || x.race_no AS race, side, key, name, team, region,
    gender, pos, date, season, x.regatta, venue,
    CASE WHEN (side = 'A' AND a > b) OR (side = 'B' AND b > a) THEN 'win' ELSE 'lose' END
      AS outcome
  FROM sided x JOIN sums y ON x.race_no = y.race_no AND x.regatta = y.regatta
  WHERE a IS NOT NULL AND b IS NOT NULL)
"""
)


# A fixed rating per (pool, sailor), so the rank and team queries have an
# exact SQL form: only sailors that compete in a pool have a row.
POOL_INDEX = {p: i for i, p in enumerate(["sr", "cr", "wsr", "wcr", "tsr", "tcr", "wtsr", "wtcr"])}


def pool_members(fleet: DataFrame, members: DataFrame) -> DataFrame:
    from windlass.plans.unify import match_women, pool_name, womens_regattas

    # A row a regatta, stored so that its size is known: the rows meet it where they
    # are and combine to a few pools a sailor before anything is shuffled.
    a = fleet.join(womens_regattas(fleet), "regatta").select(
        pool_name(F.col("womens"), False, F.col("pos")).alias("pool"), "key"
    )
    b = members.join(cut_lineage(match_women(members)), "regatta").select(
        pool_name(F.col("womens"), True, F.col("pos")).alias("pool"), "key"
    )
    return a.distinct().unionByName(b.distinct()).distinct()


def static_state(spark: SparkSession, sf_dir: str, fleet: DataFrame, members: DataFrame) -> DataFrame:
    """A table of its own: ranks count it before they read it."""
    index = F.create_map(*[F.lit(x) for pair in POOL_INDEX.items() for x in pair])[F.col("pool")]
    n = F.col("s_suppkey")
    return cut_lineage(pool_members(fleet, members).join(
        sailors(spark, sf_dir).select("key", "s_suppkey"), "key"
    ).select(
        "pool", "key", (20 + ((n * 7 + index * 13) % 97) / 8.0).alias("mu"),
        (2 + ((n + index * 3) % 10) / 4.0).alias("sigma"),
    ))


def people(spark: SparkSession, sf_dir: str, fleet: DataFrame) -> DataFrame:
    """Sailors with teams, seasons per position, exposure and finish ratios."""
    from windlass.operators.exposure import exposure, merge_regions
    from windlass.plans.history import finish_ratio
    from windlass.plans.rollups import people_table

    keys = ["race", "pos"]
    scored = fleet.filter("score is not null")
    spread = hot_groups(scored.select(*keys), keys) is not None
    seen = finish_ratio(exposure(merge_regions(scored, REGION_ALIAS), keys, spread), keys)
    n = F.col("s_suppkey")
    second = F.when(n % 7 == 0, F.concat(F.lit("NATION_"), (n % 25).cast("string")))
    dim = sailors(spark, sf_dir).withColumn(
        "teams", F.array_distinct(F.array_compact(F.array("team", second)))
    ).select("key", "name", "gender", "year", "team", "teams")
    return people_table(fleet, seen, dim)


ALL_SQL = (
    ENTRIES_SQL.rstrip() + "," + MATCHES_SQL[MATCHES_SQL.index("sided AS"):].rstrip() + """,
fw AS (SELECT regatta, count(*) FILTER (gender = 'F') >= 4 AND count(*) FILTER (gender = 'M') = 0 AS w
  FROM (SELECT DISTINCT regatta, pos, key, gender FROM entries) GROUP BY 1),
mw AS (SELECT regatta, count(*) FILTER (gender = 'F') >= 4 AND count(*) FILTER (gender = 'M') = 0 AS w
  FROM members GROUP BY 1),
pm AS (SELECT DISTINCT CASE WHEN w THEN 'w' ELSE '' END || CASE WHEN pos = 'Skipper' THEN 'sr' ELSE 'cr' END AS pool,
    key FROM entries JOIN fw USING (regatta)
  UNION SELECT DISTINCT CASE WHEN w THEN 'w' ELSE '' END || 't'
    || CASE WHEN pos = 'Skipper' THEN 'sr' ELSE 'cr' END, key FROM members JOIN mw USING (regatta)),
state AS (SELECT pool, key, 20 + ((s_suppkey * 7 + i * 13) % 97) / 8.0 AS mu,
    2 + ((s_suppkey + i * 3) % 10) / 4.0 AS sigma
  FROM pm JOIN sailors USING (key) JOIN (VALUES ('sr', 0), ('cr', 1), ('wsr', 2), ('wcr', 3), ('tsr', 4),
    ('tcr', 5), ('wtsr', 6), ('wtcr', 7)) v(pool, i) USING (pool)),
scored AS (SELECT race, pos, key, score, CASE WHEN region = 'ASIA' THEN 'AMERICA' ELSE region END AS region,
    count(*) OVER (PARTITION BY race, pos) AS field FROM entries WHERE score IS NOT NULL),
kinds AS (SELECT race, pos, count(DISTINCT coalesce(region, '?')) > 1 AS crossed, count(region) AS known
  FROM scored GROUP BY 1, 2),
exposed AS (SELECT s.race, s.pos, s.key, CAST(crossed AS INTEGER) AS is_cross,
    CASE WHEN crossed AND s.region IS NOT NULL
         THEN known - count(*) OVER (PARTITION BY s.race, s.pos, s.region) ELSE 0 END AS out_links,
    1 - (score - 1) / nullif(field - 1.0, 0) AS ratio
  FROM scored s JOIN kinds k ON s.race = k.race AND s.pos = k.pos),
tot AS (SELECT key, count(*) AS races, sum(is_cross) AS cross_races, sum(out_links) AS out_links,
    avg(CASE WHEN pos = 'Skipper' THEN ratio END) AS skipper_ratio,
    avg(CASE WHEN pos = 'Crew' THEN ratio END) AS crew_ratio FROM exposed GROUP BY key),
seas AS (SELECT key, list_sort(list(DISTINCT season) FILTER (pos = 'Skipper')) AS skipper_seasons,
    list_sort(list(DISTINCT season) FILTER (pos = 'Crew')) AS crew_seasons FROM entries GROUP BY key),
people AS (SELECT s.key, name, gender, year, team,
    CASE WHEN s_suppkey % 7 = 0 AND 'NATION_' || (s_suppkey % 25) <> team
         THEN [team, 'NATION_' || (s_suppkey % 25)] ELSE [team] END AS teams,
    coalesce(skipper_seasons, []) AS skipper_seasons, coalesce(crew_seasons, []) AS crew_seasons,
    coalesce(races, 0) AS races, coalesce(cross_races, 0) AS cross_races,
    coalesce(out_links, 0) AS out_links, skipper_ratio, crew_ratio,
    CASE WHEN contains(year, ' ') THEN 2000 + CAST(split_part(year, ' ', 1) AS INTEGER)
         ELSE CAST(year AS INTEGER) END AS grad
  FROM sailors s LEFT JOIN seas USING (key) LEFT JOIN tot USING (key)),
ps AS (SELECT *, CASE WHEN pool LIKE '%sr' THEN skipper_seasons ELSE crew_seasons END AS place
  FROM state JOIN people USING (key)),
ranked AS (SELECT *, CASE WHEN pool LIKE '%t%' THEN list_has_any(place, ['s01'])
      ELSE list_has_any(place, ['f00', 's01']) AND out_links > 70 END AND grad > 2022 AS ok FROM ps),
ranks AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY pool, ok ORDER BY mu - 3 * sigma DESC, key)
      ELSE 0 END AS rank FROM ranked)
"""
)
