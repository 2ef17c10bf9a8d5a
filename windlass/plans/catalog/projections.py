"""Projections, filters and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from windlass.functions import ids
from windlass.functions import rating_math as rm
from windlass.operators.compare import drop_all_null, normalised
from windlass.plans import domain
from windlass.plans.domain import ENTRIES_SQL, SAILORS_SQL, table
from windlass.plans.registry import query

SAILORS_WITH = "WITH " + SAILORS_SQL.strip()


@query(
    "race_id_parts", "C01 C02 C03 I01 I04",
    ENTRIES_SQL + """SELECT race_id, pos, key, CAST(race_no AS INTEGER) AS race_num,
      right(race_id, 1) AS race_div, race AS adjusted_id, season AS season_part FROM entries""",
)
def race_id_parts(spark, sf):
    e = domain.entries(spark, sf)
    rid = F.col("race_id")
    return e.select(
        "race_id", "pos", "key", ids.race_number(rid).alias("race_num"),
        ids.race_division(rid).alias("race_div"),
        ids.adjusted_race_id(rid, F.col("scoring")).alias("adjusted_id"),
        ids.season_of(rid).alias("season_part"),
    )


@query(
    "surrogate_keys", "C04 C05 C06 C07 I20",
    SAILORS_WITH + """ SELECT s_suppkey, coalesce(link, 'Unknown') AS link_filled,
      key AS sailor_key,
      CASE WHEN link IS NOT NULL THEN link WHEN s_suppkey % 20 <> 0 THEN name || '/' || team
           ELSE 'Unknown' END AS partner_key FROM sailors""",
)
def surrogate_keys(spark, sf):
    s = domain.sailors(spark, sf)
    filled = F.coalesce("link", F.lit(ids.UNKNOWN))
    name = F.when(F.col("s_suppkey") % 20 != 0, F.col("name"))
    return s.select(
        "s_suppkey", filled.alias("link_filled"),
        ids.surrogate_key(filled, F.col("name"), F.col("team")).alias("sailor_key"),
        ids.partner_key(filled, name, F.col("team")).alias("partner_key"),
    )


@query(
    "renamed_match_log", "C08 C09 C10 H01",
    """SELECT CAST(o_orderkey AS VARCHAR) AS race_id, CAST(o_orderkey AS VARCHAR) AS adjusted_race_id,
      'team' AS scoring, CAST(o_orderdate AS DATE) AS date, NULL::VARCHAR AS flag, 'orders' AS part
    FROM orders
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), NULL, NULL, CAST(l_shipdate AS DATE), l_returnflag, 'lines'
    FROM lineitem""",
)
def renamed_match_log(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("raceID"), F.to_date("o_orderdate").alias("Date")
    ).withColumns({
        "adjusted_race_id": F.col("raceID"), "scoring": F.lit("team"), "part": F.lit("orders"),
    }).withColumnsRenamed({"Date": "date", "raceID": "race_id"})
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("race_id"),
        F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("flag"),
        F.lit("lines").alias("part"),
    )
    return orders.unionByName(lines, allowMissingColumns=True)


@query(
    "drop_empty_columns", "C10 E27 I20",
    "SELECT c_custkey, c_name FROM customer",
)
def drop_empty_columns(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.nullif(F.col("c_custkey"), F.col("c_custkey")).alias("empty")
    )
    return drop_all_null(c)


@query(
    "position_filter", "C11 I06",
    ENTRIES_SQL + """SELECT race_id, key, score FROM entries
      WHERE pos = 'Skipper' AND contains(pos, 'kip')""",
)
def position_filter(spark, sf):
    return domain.entries(spark, sf).filter(
        (F.col("pos") == "Skipper") & F.col("pos").contains("kip")
    ).select("race_id", "key", "score")


@query(
    "recent_races", "C12 I10",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, dayofweek(o_orderdate) + 1 AS weekday,
      strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders
    WHERE CAST(o_orderdate AS DATE) > DATE '2001-06-01' - INTERVAL 14 DAY""",
)
def recent_races(spark, sf, today="2001-06-01"):
    date = F.to_date("o_orderdate")
    return table(spark, sf, "orders").filter(
        F.col("o_orderdate") >= F.date_add(F.date_sub(F.lit(today), 14), 1).cast("timestamp_ntz")
    ).select(
        "o_orderkey", date.alias("date"), F.dayofweek(date).alias("weekday"),
        F.date_format(date, "yyyy-MM-dd").alias("iso"),
    )


@query(
    "scoring_filter", "C13 C16 C17",
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND starts_with(o_orderstatus, 'F')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE contains(c_mktsegment, 'BUILD'))""",
)
def scoring_filter(spark, sf):
    wanted = table(spark, sf, "customer").filter(F.col("c_mktsegment").contains("BUILD"))
    return table(spark, sf, "orders").filter(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
        & F.col("o_orderstatus").startswith("F")
    ).join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "pages_to_fetch", "C14 C15 D05 I09",
    """WITH seen AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber >= 4)
    SELECT o_orderkey, l_orderkey IS NOT NULL AS seen,
      date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age
    FROM orders LEFT JOIN seen ON o_orderkey = l_orderkey
    WHERE l_orderkey IS NULL OR (o_orderstatus <> 'F'
      AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 14)""",
)
def pages_to_fetch(spark, sf, today="2001-08-01"):
    seen = table(spark, sf, "lineitem").filter("l_linenumber >= 4").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("seen")
    ).distinct()
    status = F.when(F.col("o_orderstatus") == "F", "Official").otherwise("Pending")
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    known = F.coalesce("seen", F.lit(False))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", status.alias("status"), ids.parse_date(text).alias("date")
    )
    day = F.to_date(F.lit(today))
    return orders.join(seen, "o_orderkey", "left").filter(
        ids.needs_fetch(known, F.col("status"), F.col("date"), day)
    ).select("o_orderkey", known.alias("seen"), F.datediff(day, "date").alias("age"))


@query(
    "grad_year_eligible", "C21 I21 I03",
    SAILORS_WITH + """ SELECT key, CASE WHEN contains(year, ' ')
        THEN 2000 + CAST(split_part(year, ' ', 1) AS INTEGER) ELSE CAST(year AS INTEGER) END
        AS grad, lower(replace(replace(team, ' ', '-'), '/', '-')) AS team_slug
    FROM sailors WHERE (CASE WHEN contains(year, ' ')
        THEN 2000 + CAST(split_part(year, ' ', 1) AS INTEGER) ELSE CAST(year AS INTEGER) END) > 2022""",
)
def grad_year_eligible(spark, sf):
    grad = ids.grad_year(F.col("year"))
    return domain.sailors(spark, sf).filter(grad > domain.GRAD_CUTOFF).select(
        "key", grad.alias("grad"), ids.slug(F.col("team")).alias("team_slug")
    )


@query(
    "text_functions", "I02 I03 I05 I06 I07 C25",
    """SELECT s_suppkey, split_part(s_name || ' ''24 Jr', ' ''', 1) AS name,
      split_part(s_name || ' ''24 Jr', ' ''', 2) AS year, lower(trim('  ' || s_name || ' ')) AS folded,
      regexp_matches(CAST(s_suppkey AS VARCHAR), '^[0-9]+$') AS is_number,
      split_part(s_name, '#', 1) AS first_token, contains(s_name, '7') AS has_seven,
      replace(s_name, '#', '/') AS replaced FROM supplier""",
)
def text_functions(spark, sf):
    text = F.concat(F.col("s_name"), F.lit(" '24 Jr"))
    parts = F.split(text, " '", 2)
    return table(spark, sf, "supplier").select(
        "s_suppkey", parts[0].alias("name"), parts[1].alias("year"),
        normalised(F.concat(F.lit("  "), "s_name", F.lit(" "))).alias("folded"),
        F.col("s_suppkey").cast("string").rlike(r"^\d+$").alias("is_number"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_token"),
        F.col("s_name").contains("7").alias("has_seven"),
        F.replace("s_name", F.lit("#"), F.lit("/")).alias("replaced"),
    )


@query(
    "date_forms", "I09 I10 C12",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_iso, CAST(o_orderdate AS DATE) AS from_us,
      CAST(o_orderdate AS DATE) AS from_epoch, CAST(o_orderdate AS DATE) AS from_tuple FROM orders""",
)
def date_forms(spark, sf):
    d = F.col("o_orderdate")
    millis = F.unix_millis(d.cast("timestamp")).cast("string")
    tup = F.concat(
        F.lit("("), F.year(d).cast("string"), F.lit(", "), F.month(d).cast("string"), F.lit(", "),
        F.dayofmonth(d).cast("string"), F.lit(")"),
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        ids.parse_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).alias("from_iso"),
        ids.parse_date(F.date_format(d, "MM/dd/yyyy")).alias("from_us"),
        ids.parse_date(millis).alias("from_epoch"), ids.parse_date(tup).alias("from_tuple"),
    )


@query(
    "season_calendar", "I11 C16 D17",
    """WITH span AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders),
    seasons AS (SELECT h || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS season
      FROM (SELECT unnest(range(a, b + 1)) AS y FROM span), (VALUES ('f'), ('s')) v(h)),
    counts AS (SELECT (CASE WHEN month(o_orderdate) <= 6 THEN 's' ELSE 'f' END)
        || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS season, count(*) AS n
      FROM orders GROUP BY 1)
    SELECT season, CAST(coalesce(n, 0) AS BIGINT) AS races FROM seasons LEFT JOIN counts USING (season)""",
)
def season_calendar(spark, sf):
    orders = table(spark, sf, "orders")
    years = orders.agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    calendar = years.filter("a is not null").select(
        F.explode(ids.season_list(F.col("a"), F.col("b"))).alias("season"))
    counts = orders.groupBy(
        ids.season_code(F.col("o_orderdate")).alias("season")
    ).agg(F.count("*").alias("n"))
    return calendar.join(counts, "season", "left").select(
        "season", F.coalesce("n", F.lit(0)).alias("races")
    )


@query(
    "numeric_functions", "I13 I14 I21",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS BIGINT) AS rounded_cast,
      CAST(trunc(l_extendedprice) AS INTEGER) AS truncated,
      round(pow(l_discount, 2), 6) AS squared, round(exp(l_tax), 6) AS e_tax,
      round(ln(l_extendedprice), 6) AS log_price, round(sqrt(l_quantity), 6) AS root,
      greatest(-800, least(l_extendedprice - 40000, 800)) AS clamped FROM lineitem""",
)
def numeric_functions(spark, sf):
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.rint(p).cast("bigint").alias("rounded_cast"), p.cast("int").alias("truncated"),
        F.round(F.pow("l_discount", F.lit(2)), 6).alias("squared"),
        F.round(F.exp("l_tax"), 6).alias("e_tax"), F.round(F.ln(p), 6).alias("log_price"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.greatest(F.lit(-800.0), F.least(p - 40000, F.lit(800.0))).alias("clamped"),
    )


@query(
    "ordinal_ratings", "I12 I15",
    """SELECT s_suppkey, round(24.0 * ((25 + s_acctbal / 1000) - 3 * 2.5) + 1000, 7) AS scaled,
      round((25 + s_acctbal / 1000) - 3 * 2.5, 7) AS unscaled,
      round(25.0 * ((25 + s_acctbal / 1000) - 3 * 2.5) + 1000, 7) AS alpha_25,
      round(exp(-0.5 * pow((30 - (25 + s_acctbal / 1000)) / 2.5, 2)) / (2.5 * sqrt(2 * pi())), 8)
        AS density FROM supplier""",
)
def ordinal_ratings(spark, sf):
    mu, sigma = 25 + F.col("s_acctbal") / 1000, F.lit(2.5)
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.round(rm.ordinal(mu, sigma), 7).alias("scaled"),
        F.round(mu - 3 * sigma, 7).alias("unscaled"),
        F.round((mu - 3 * sigma) * 25 + 1000, 7).alias("alpha_25"),
        F.round(rm.normal_pdf(F.lit(30.0), mu, sigma), 8).alias("density"),
    )


@query(
    "density_curves", "I15 E21",
    SAILORS_WITH + """, t AS (SELECT team, avg(25 + s_acctbal / 1000) AS mu,
        greatest(coalesce(stddev_samp(s_acctbal / 1000), 1), 0.1) AS sd FROM sailors GROUP BY team)
    SELECT team, x, round(exp(-0.5 * pow((x - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 6) AS density
    FROM t, range(-25, 76) r(x)""",
)
def density_curves(spark, sf):
    t = domain.sailors(spark, sf).groupBy("team").agg(
        F.avg(25 + F.col("s_acctbal") / 1000).alias("mu"),
        F.greatest(
            F.coalesce(F.stddev_samp(F.col("s_acctbal") / 1000), F.lit(1.0)), F.lit(0.1)
        ).alias("sd"),
    )
    grid = t.select("team", "mu", "sd", F.explode(F.sequence(F.lit(-25), F.lit(75))).alias("x"))
    return grid.select(
        "team", "x", F.round(rm.normal_pdf(F.col("x"), F.col("mu"), F.col("sd")), 6).alias("density")
    )


@query(
    "array_functions", "I16 C19 C23 D19 F16",
    """WITH a AS (SELECT p_partkey, [p_brand, p_type, p_brand, CAST(p_size AS VARCHAR)] AS xs,
        [p_type, 'SMALL'] AS ys FROM part)
    SELECT p_partkey, list_contains(xs, 'SMALL') AS has_small, coalesce(list_position(xs, 'SMALL'), 0) AS at_small,
      xs[-1] AS last_item, array_to_string(list_sort(list_distinct(xs)), ',') AS uniq,
      array_to_string(xs[1:2], ',') AS head2, list_has_any(xs, ['SMALL', 'LARGE']) AS overlaps,
      array_to_string(list_filter(xs, lambda x: x <> 'SMALL'), ',') AS removed,
      array_to_string(list_concat(xs, ys), ',') AS joined,
      ys[1] || ':' || xs[1] AS zipped FROM a""",
)
def array_functions(spark, sf):
    a = table(spark, sf, "part").select(
        "p_partkey",
        F.array("p_brand", "p_type", "p_brand", F.col("p_size").cast("string")).alias("xs"),
        F.array_append(F.array("p_type"), F.lit("SMALL")).alias("ys"),
    )
    zipped = F.arrays_zip("ys", "xs")[0]
    return a.select(
        "p_partkey", F.array_contains("xs", "SMALL").alias("has_small"),
        F.array_position("xs", "SMALL").alias("at_small"),
        F.element_at("xs", -1).alias("last_item"),
        F.array_join(F.array_sort(F.array_distinct("xs")), ",").alias("uniq"),
        F.array_join(F.slice("xs", 1, 2), ",").alias("head2"),
        F.arrays_overlap("xs", F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("overlaps"),
        F.array_join(F.array_remove("xs", "SMALL"), ",").alias("removed"),
        F.array_join(F.concat("xs", "ys"), ",").alias("joined"),
        F.concat_ws(":", zipped["ys"], zipped["xs"]).alias("zipped"),
    )


@query(
    "map_functions", "I17 I18",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS building,
      coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_nationkey AS VARCHAR) END, '') AS machinery
    FROM customer""",
)
def map_functions(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.map_from_arrays(F.array("c_mktsegment"), F.array("c_acctbal")).alias("balance"),
        F.map_from_entries(
            F.array(F.struct("c_mktsegment", F.col("c_nationkey").cast("string")))
        ).alias("nation"),
    )
    return c.select(
        "c_custkey", F.col("balance")["BUILDING"].alias("building"),
        F.coalesce(F.col("nation")["MACHINERY"], F.lit("")).alias("machinery"),
    )


@query(
    "json_functions", "I19",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"' || event_type || '"}' AS compact
    FROM events""",
)
def json_functions(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("type"))).alias("compact"),
    )


@query(
    "missing_scores", "I20 I22 C18 F08",
    ENTRIES_SQL + """, n AS (SELECT race, pos, count(*) AS field FROM entries GROUP BY 1, 2)
    SELECT e.race, e.pos, key, coalesce(score, field + 1) AS filled, field
    FROM entries e JOIN n ON e.race = n.race AND e.pos = n.pos""",
)
def missing_scores(spark, sf):
    e = domain.entries(spark, sf)
    field = e.groupBy("race", "pos").agg(F.count("*").alias("field"))
    return e.join(field, ["race", "pos"]).select(
        "race", "pos", "key", F.coalesce("score", F.col("field") + 1).alias("filled"), "field"
    )


@query(
    "score_strings", "I08 A10 A11",
    """WITH s AS (SELECT p_partkey, p_size, 1 + p_size % 3 AS a, 4 + p_size % 2 AS b FROM part)
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 100 END AS cell,
      a + b + 7 AS place_sum, a || ',' || CASE WHEN a + 1 <= b THEN
        array_to_string(range(a + 1, b + 1), ',') || ',' ELSE '' END || 9 AS races,
      array_to_string(range(1, p_size + 1), ',') AS all_races FROM s""",
)
def score_strings(spark, sf):
    size = F.col("p_size")
    a, b = F.lit(1) + size % 3, F.lit(4) + size % 2
    s = table(spark, sf, "part").select(
        "p_partkey", "p_size",
        F.when(size % 2 == 0, size.cast("string")).otherwise("DNF").alias("text"),
        F.concat(F.lit("("), (size + 100).cast("string"), F.lit(", DNF)")).alias("title"),
        F.concat_ws("-", a.cast("string"), b.cast("string"), F.lit("7")).alias("places"),
        F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit(",9")).alias("range"),
    )
    places = F.transform(F.split("places", "-"), lambda x: x.cast("int"))
    return s.select(
        "p_partkey", ids.score_cell(F.col("text"), F.col("title")).alias("cell"),
        F.aggregate(places, F.lit(0), lambda acc, x: acc + x).alias("place_sum"),
        F.array_join(ids.race_range(F.col("range"), size), ",").alias("races"),
        F.array_join(ids.race_range(F.lit(""), size), ",").alias("all_races"),
    )
