"""Page parsing: pages are rendered from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import markup
from windlass.functions.ids import needs_fetch
from windlass.plans import rendered_pages as rendered
from windlass.plans.domain import SAILORS_SQL, table
from windlass.plans.registry import query
from windlass.session import cut_lineage
from windlass.sources import fleet_pages as fleet
from windlass.sources import match_pages as match
from windlass.sources import sailor_pages

_BOATS = "WITH " + SAILORS_SQL.strip() + """, d AS (
    SELECT l_orderkey AS k, l_suppkey AS n, l_linenumber AS ln, l_linestatus AS st, team FROM (SELECT *,
      row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn
      FROM lineitem) JOIN sailors ON l_suppkey = s_suppkey WHERE rn = 1)"""

_SCORES = _BOATS + """, sc AS (SELECT 's01/r' || k || '-' || (n // 4096) AS regatta, k, n, 'Bay ' || (k % 7) AS venue, team,
    '/schools/' || lower(team) || '-' || n || '/' AS team_link, 'R&D ' || n AS boat, div, race_no,
    CAST((ln * 3 + race_no * 5 + CASE WHEN div = 'B' THEN 7 ELSE 0 END) % 20 + 1 AS INTEGER) AS score
  FROM d, (VALUES ('A'), ('B')) v(div), (VALUES (1), (2)) r(race_no))"""


@query(
    "page_links", "A07 A13 A17",
    """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""",
)
def page_links(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.explode(markup.all_matches(F.col("html"), r'<a href="([^"]*)"', 1)).alias("link")
    )


@query(
    "season_index", "A07 A05 A19 C13",
    """SELECT season, season || '/r' || o_orderkey AS regatta, scoring, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN o_orderstatus = 'F' THEN 'Official' ELSE 'Pending' END AS status
    FROM (SELECT *, (CASE WHEN month(o_orderdate) <= 6 THEN 's' ELSE 'f' END)
        || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS season,
      CASE left(o_orderpriority, 1) WHEN '1' THEN '3 Divisions' WHEN '2' THEN '2 Divisions'
        WHEN '3' THEN '1 Division' WHEN '4' THEN 'Combined' ELSE 'Team' END AS scoring FROM orders)""",
)
def season_index(spark, sf):
    return fleet.season_index(cut_lineage(rendered.season_index_pages(spark, sf)))


@query(
    "fleet_fetch_list", "A07 C13 C14 C15",
    """SELECT 's01/r' || o_orderkey AS regatta FROM orders
    WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND month(o_orderdate) <= 6 AND left(o_orderpriority, 1) <> '5'
      AND (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3)
        OR (o_orderstatus <> 'F' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-30') <= 14))""",
)
def fleet_fetch_list(spark, sf, today="2001-06-30"):
    index = fleet.season_index(cut_lineage(rendered.season_index_pages(spark, sf))).filter("season = 's01'")
    seen = table(spark, sf, "lineitem").filter("l_linenumber >= 3").select(
        F.concat(F.lit("s01/r"), F.col("l_orderkey").cast("string")).alias("regatta"),
        F.lit(True).alias("seen"),
    ).distinct()
    return index.join(seen, "regatta", "left").filter(
        F.col("scoring").isin(fleet.FLEET_SCORING) & needs_fetch(
            F.coalesce("seen", F.lit(False)), F.col("status"), F.col("date"), F.to_date(F.lit(today))
        )
    ).select("regatta")


def _fleet_pages(spark, sf, column):
    """Only the asked page is rendered and stored."""
    return cut_lineage(rendered.fleet_pages(spark, sf).select("regatta", F.col(column).alias("html")))


@query(
    "fleet_scores", "A08 A09 A10",
    _SCORES + " SELECT regatta, venue, team, team_link, boat, div, 2 AS races, race_no, score FROM sc",
)
def fleet_scores(spark, sf):
    return fleet.score_rows(_fleet_pages(spark, sf, "scores"))


@query(
    "fleet_sailors", "A08 A11 F17 I02",
    _BOATS + """, p AS (SELECT * FROM (VALUES ('A', 'Skipper', 'Sk', 'a', '25', ''), ('A', 'Crew', 'Cr', 'a', '26', '1'),
      ('A', 'Crew', 'Cr', 'c', '27', '2'), ('B', 'Skipper', 'Sk', 'b', '25', '1-2'), ('B', 'Crew', 'Cr', 'b', '24', ''))
      v(div, pos, nm, sfx, year, range))
    SELECT 's01/r' || k || '-' || (n // 4096) AS regatta, '/schools/' || lower(team) || '-' || n || '/' AS team_link, 'R&D ' || n AS boat,
      div, pos, nm || ' ' || n || sfx AS name, year,
      CASE WHEN nm || sfx = 'Ska' AND n % 10 <> 0 THEN 'sk-' || n END AS link, range FROM d, p""",
)
def fleet_sailors(spark, sf):
    return fleet.sailor_rows(_fleet_pages(spark, sf, "sailors"))


@query(
    "fleet_entries_from_pages", "A08 D08 Q8 Q10",
    _SCORES + """, e AS (SELECT sc.*, pos, nm || ' ' || n || sfx AS name, year,
        CASE WHEN nm || sfx = 'Ska' AND n % 10 <> 0 THEN 'sk-' || n END AS link,
        onm || ' ' || n || osfx AS partner, CASE WHEN onm || osfx = 'Ska' AND n % 10 <> 0 THEN 'sk-' || n
          ELSE 'Unknown' END AS partner_link
      FROM sc JOIN (VALUES ('A', 1, 'Skipper', 'Sk', 'a', '25', 'Cr', 'a'), ('A', 2, 'Skipper', 'Sk', 'a', '25', 'Cr', 'c'),
        ('A', 1, 'Crew', 'Cr', 'a', '26', 'Sk', 'a'), ('A', 2, 'Crew', 'Cr', 'c', '27', 'Sk', 'a'),
        ('B', 1, 'Skipper', 'Sk', 'b', '25', 'Cr', 'b'), ('B', 2, 'Skipper', 'Sk', 'b', '25', 'Cr', 'b'),
        ('B', 1, 'Crew', 'Cr', 'b', '24', 'Sk', 'b'), ('B', 2, 'Crew', 'Cr', 'b', '24', 'Sk', 'b'))
        v(div, race_no, pos, nm, sfx, year, onm, osfx) ON sc.div = v.div AND sc.race_no = v.race_no)
    SELECT regatta || '/' || race_no || div AS race_id, name, pos, score, link, year, team, venue, partner, partner_link
    FROM e""",
)
def fleet_entries_from_pages(spark, sf):
    pages = cut_lineage(rendered.fleet_pages(spark, sf))
    # Parsed once each: the joins below read them more than once.
    scores = cut_lineage(fleet.score_rows(pages.select("regatta", F.col("scores").alias("html"))))
    people = cut_lineage(fleet.sailor_rows(pages.select("regatta", F.col("sailors").alias("html"))))
    entries = cut_lineage(fleet.fleet_entries(scores, people))
    return fleet.resolve_conflicts(entries).select(
        "race_id", "name", "pos", "score", "link", "year", "team", "venue", "partner", "partner_link"
    )


@query(
    "illegal_duplicates_removed", "J17 Q9",
    """SELECT CAST(l_orderkey AS VARCHAR) AS race_id, CAST(l_suppkey AS VARCHAR) AS name, l_linenumber FROM (SELECT *,
      count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""",
)
def illegal_duplicates_removed(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("race_id"), F.col("l_suppkey").cast("string").alias("name"),
        "l_linenumber",
    )
    return fleet.resolve_conflicts(rows)


_MATCH_ORDERS = _BOATS + """, o AS (SELECT k, 0 AS h FROM d GROUP BY 1 HAVING count(*) FILTER (st = 'O') > 0
    AND count(*) FILTER (st = 'F') > 0),
  three AS (SELECT * FROM (SELECT d.k, h, n, CASE WHEN st = 'O' THEN 'A' ELSE 'B' END AS side, row_number() OVER (
      PARTITION BY d.k, h, st ORDER BY n) - 1 AS boat FROM d JOIN o ON d.k = o.k) WHERE boat < 3)"""


def _match_pages(spark, sf, column):
    return cut_lineage(rendered.match_pages(spark, sf).select("regatta", F.col(column).alias("html")))


@query(
    "match_results", "A12 A05 I08",
    _MATCH_ORDERS + """ SELECT 's01/m' || k || '-' || h AS regatta, 'Bay ' || (k % 7) AS venue, DATE '2001-03-04' AS date, round, race_no,
      'Uni ' || a || k AS uni_a, 'Nick ' || a AS nick_a, lower(a) || k AS link_a, '1-2-5' AS score_a, oa AS outcome_a,
      'Uni ' || b || k AS uni_b, 'Nick ' || b AS nick_b, lower(b) || k AS link_b, '3-4-6' AS score_b, ob AS outcome_b
    FROM o, (VALUES ('Round 1', 1, 'A', 'B', 'win', 'lose'), ('Round 2', 3, 'B', 'A', 'lose', 'win'))
      v(round, race_no, a, b, oa, ob)""",
)
def match_results(spark, sf):
    return match.match_rows(_match_pages(spark, sf, "races"))


@query(
    "match_report_sailors", "A13 F14",
    _MATCH_ORDERS + """ SELECT 's01/m' || d.k || '-' || h AS regatta, p || ' ' || n AS name,
      CASE WHEN p = 'Sk' AND n % 10 <> 0 THEN 'sk-' || n ELSE 'Unknown' END AS link
    FROM d JOIN o ON d.k = o.k, (VALUES ('Sk'), ('Cr')) v(p)""",
)
def match_report_sailors(spark, sf):
    return match.report_sailors(_match_pages(spark, sf, "report"))


@query(
    "match_report_teams", "A14",
    _MATCH_ORDERS + """ SELECT 's01/m' || k || '-' || h AS regatta, CAST(i AS VARCHAR) AS rank, i || k::VARCHAR AS team_id,
      'Nick ' || t AS nick, 'Uni ' || t || k AS uni, '/schools/' || lower(t) || k || '/' AS team_link,
      '*' AS tie_mark, 'Head & tail ' || t AS tie_text FROM o, (VALUES (1, 'A'), (2, 'B'), (3, 'C')) v(i, t)""",
)
def match_report_teams(spark, sf):
    t = match.report_teams(_match_pages(spark, sf, "report"))
    return t.select(
        *[c for c in t.columns if c != "tiebreaker"], F.col("tiebreaker.mark").alias("tie_mark"),
        F.col("tiebreaker.text").alias("tie_text"),
    )


@query(
    "match_rotation", "A15",
    _MATCH_ORDERS + """, t AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C')) v(i, t)),
    b AS (SELECT k, h, side, boat, 'Sk ' || n AS s, '25' AS sy, 'Cr ' || n AS c, '26' AS cy FROM three
      UNION ALL SELECT k, h, 'C', 0, 'Unknown', 'Unknown', 'Unknown', 'Unknown' FROM o)
    SELECT 's01/m' || b.k || '-' || b.h AS regatta, round, 'Team ' || x.t || b.k AS team, x.i || b.k::VARCHAR AS team_id,
      'Full ' || x.t || b.k AS full_name, y.i || b.k::VARCHAR AS opp_id, 'Team ' || y.t || b.k AS opponent,
      'Full ' || y.t || b.k AS opponent_full, CAST(boat AS INTEGER) AS boat, pos,
      CASE WHEN pos = 'Skipper' THEN s ELSE c END AS name, CASE WHEN pos = 'Skipper' THEN sy ELSE cy END AS year,
      CASE WHEN pos = 'Skipper' THEN c ELSE s END AS partner
    FROM b JOIN t x ON b.side = x.t JOIN t y ON x.t <> y.t, (VALUES ('Round 1'), ('Round 2')) r(round),
      (VALUES ('Skipper'), ('Crew')) p(pos)""",
)
def match_rotation(spark, sf):
    return match.rotation_sailors(_match_pages(spark, sf, "rotation"))


@query(
    "match_rotation_teams", "A16",
    _MATCH_ORDERS + """ SELECT 's01/m' || k || '-' || h AS regatta, i || k::VARCHAR AS team_id, 'Team ' || t || k AS team,
      'Full ' || t || k AS uni FROM o, (VALUES (1, 'A'), (2, 'B'), (3, 'C')) v(i, t)""",
)
def match_rotation_teams(spark, sf):
    return match.rotation_teams(_match_pages(spark, sf, "rotation"))


@query(
    "matches_from_pages", "A12 A15 D01 D04 D06 D07",
    _MATCH_ORDERS + """ SELECT 's01/m' || k || '-' || h || '/' || race_no AS race_id, round, side, 'Team ' || side || k AS team,
      CASE WHEN side = 'A' THEN 'win' ELSE 'lose' END AS outcome, CAST(boat AS INTEGER) AS boat, pos, p || ' ' || n AS name,
      CASE WHEN p = 'Sk' AND n % 10 <> 0 THEN 'sk-' || n ELSE p || ' ' || n || '-Team ' || side || k END AS key
    FROM three, (VALUES ('Round 1', 1), ('Round 2', 3)) v(round, race_no), (VALUES ('Skipper', 'Sk'), ('Crew', 'Cr')) w(pos, p)""",
)
def matches_from_pages(spark, sf):
    pages = cut_lineage(rendered.match_pages(spark, sf))

    def html(c):
        return pages.select("regatta", F.col(c).alias("html"))

    # Parsed once for the sailors and the teams.
    rotation = cut_lineage(match.rotation_rows(html("rotation")))
    rows = match.assemble_matches(
        cut_lineage(match.match_rows(html("races"))), cut_lineage(match.sailors_of(rotation)),
        match.report_sailors(html("report")), cut_lineage(match.report_teams(html("report"))),
        match.teams_of(rotation),
    )
    side = F.substring("team", 6, 1)
    return rows.select(
        "race_id", "round", side.alias("side"), "team", "outcome", "boat", "pos", "name", "key"
    )


_META = "WITH " + SAILORS_SQL.strip() + """ SELECT key, link, name, 'Ann "B"' AS first_name, split_part(name, '#', 2)
  AS last_name, gender, '2025' AS year, lower(team) AS team_link, team, CAST(s_suppkey AS VARCHAR) AS id,
  'x' AS external_id FROM sailors WHERE link IS NOT NULL"""


@query("sailor_page_data", "A17 I19", _META + " AND s_suppkey % 13 <> 0")
def sailor_page_data(spark, sf):
    return sailor_pages.sailor_meta(rendered.sailor_pages(spark, sf)).withColumnRenamed(
        "teamLink", "team_link"
    )


@query(
    "patched_sailor_pages", "A18 D05 H01",
    "SELECT key, name, first_name, year, id FROM (" + _META + ") WHERE CAST(id AS BIGINT) % 13 <> 0 UNION ALL "
    "SELECT key, name, NULL, '2016', NULL FROM (" + _META + ") WHERE CAST(id AS BIGINT) % 13 = 0",
)
def patched_sailor_pages(spark, sf):
    from windlass.plans.domain import sailors

    parsed = sailor_pages.sailor_meta(rendered.sailor_pages(spark, sf))
    patches = sailors(spark, sf).filter("link is not null").select("key", "name", F.lit("2016").alias("year"))
    return sailor_pages.patch(parsed, patches).select("key", "name", "first_name", "year", "id")


@query(
    "sailors_without_page", "D05 H03 C05",
    "WITH " + SAILORS_SQL.strip() + """ SELECT DISTINCT name, year, team, name || '-' || team AS key FROM sailors
      WHERE link IS NULL""",
)
def sailors_without_page(spark, sf):
    from windlass.plans.domain import entries, sailors

    return sailor_pages.unlinked_sailors(entries(spark, sf), sailors(spark, sf))
