import json
import os
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from windlass import schemas
from windlass.plans.unify import match_boats, merge_people, unify_fleet, unify_matches
from windlass.sources import files, sinks
from windlass.sources.fleet_pages import fleet_entries, resolve_conflicts, sailor_rows, score_rows
from windlass.sources.match_pages import match_rows
from windlass.sources.sailor_pages import sailor_meta
from windlass.streaming.upsert import merge_batch, result_stream, start_upsert


def _pages(spark, **html):
    return spark.createDataFrame(list(html.items()), "regatta string, html string")


def _scores(rows, races=2):
    heads = "".join(f'<th class="right">{i}</th>' for i in [*range(1, races + 1), "TOT"])
    return (f'<span itemprop="location">Lake</span><table class="results"><thead><tr>{heads}</tr></thead>'
            f"<tbody>{''.join(rows)}</tbody></table>")


def test_score_layouts(spark):
    one = _scores(['<tr class="divA"><td>1</td><td></td><td><a href="/schools/x/">X U</a> Xs</td>'
                   '<td>3</td><td title="(9, DNF)">DNF</td><td>12</td></tr><tr class="totalrow"></tr>'])
    line = '<tr class="div{0}"><td></td><td></td><td>{1}</td><td>{0}</td><td>{2}</td><td>{2}</td><td>9</td></tr>'
    link = '<a href="/schools/y/">Y U</a>'
    three = _scores([line.format("A", link, 1), line.format("B", "Ys", 2), line.format("C", "", 3),
                     '<tr class="totalrow"></tr>'])
    got = sorted(map(tuple, score_rows(_pages(spark, one=one, three=three, none="<p>soon</p>")).select(
        "regatta", "team", "team_link", "boat", "div", "race_no", "score", "venue").collect()))
    assert got == [
        ("one", "X U", "/schools/x/", "Xs", "A", 1, 3, "Lake"),
        ("one", "X U", "/schools/x/", "Xs", "A", 2, 9, "Lake"),
    ] + [("three", "Y U", "/schools/y/", "Ys", d, r, n, "Lake")
         for n, d in enumerate("ABC", 1) for r in (1, 2)]


def test_partner_stays_with_its_race(spark):
    """A race without a crew must not shift the next partner."""
    scores = _scores(['<tr class="divA"><td>1</td><td></td><td><a href="/schools/x/">X U</a> Xs</td>'
                      + "".join(f"<td>{i}</td>" for i in (1, 2, 3)) + '<td>6</td></tr>',
                      '<tr class="totalrow"></tr>'], races=3)
    row = ('<tr class="{}"><td>1</td><td><a href="/schools/x/">l</a></td>{}<td class="division-cell">{}</td>'
           "<td>{}</td><td>{}</td><td>{}</td><td>{}</td></tr>")
    listed = "<table class='x sailors'>".replace("'", '"') + row.format(
        "topborder", '<td class="teamname">Xs</td>', "A", "Ann Ash '25", "", "Bo Oak '26", "2") + (
        row.format("row", "<td></td>", "", "No show", "", "Cy Elm '26", "3")) + "</table>"
    got = {(r.name, r.race_no): (r.partner, r.score) for r in fleet_entries(
        score_rows(_pages(spark, r=scores)), sailor_rows(_pages(spark, r=listed))).collect()}
    assert got == {
        ("Ann Ash", 1): ("Unknown", 1), ("Ann Ash", 2): ("Bo Oak", 2), ("Ann Ash", 3): ("Cy Elm", 3),
        ("Bo Oak", 2): ("Ann Ash", 2), ("Cy Elm", 3): ("Ann Ash", 3),
    }


def test_conflicts(spark):
    df = spark.createDataFrame([("r/1A", "x", "Skipper"), ("r/1A", "x", "Crew"), ("r/1A", "y", "Crew"),
                                ("r/1B", "x", "Skipper")], "race_id string, name string, pos string")
    assert sorted((r.race_id, r.name) for r in resolve_conflicts(df).collect()) == [("r/1A", "y"), ("r/1B", "x")]


def test_match_rows_without_table(spark):
    assert match_rows(_pages(spark, m="<p>no scores</p>")).count() == 0


def test_sailor_meta(spark):
    body = json.dumps({"name": "Al \"B\" C", "school": "url:/schools/t/", "gender": "M", "year": "2024"})
    page = f"<meta name=\"ts:data\" content='{body}'><ul id=\"menu\"><li>a</li><li>T &amp; U</li></ul>"
    df = spark.createDataFrame([("al", page), ("broken", "<p></p>")], "link string, html string")
    (r,) = sailor_meta(df).collect()
    assert (r.key, r.name, r.teamLink, r.team, r.id) == ("al", 'Al "B" C', "t", "T & U", None)


def test_files(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"a": {"0": 1, "1": None}, "b": {"0": "x", "1": "y"}}))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = sorted(map(tuple, files.read_column_json(spark, str(tmp_path / "old.json"), schema).collect()), key=repr)
    assert got == [(1, "x"), (None, "y")]
    assert files.read_or_empty(spark, str(tmp_path / "none"), schemas.FLEET_ENTRY).count() == 0
    df = spark.range(3)
    sinks.write_snapshot(df, str(tmp_path / "s"), "2024-01-01", "parquet")
    assert spark.read.parquet(str(tmp_path / "s/latest")).count() == 3
    sinks.truncate(df, str(tmp_path / "s/latest"))
    assert spark.read.parquet(str(tmp_path / "s/latest")).count() == 0


def test_unify(spark):
    fleet = spark.createDataFrame([{
        "Score": 1, "Sailor": "Bo", "Link": None, "Position": "Crew", "Partner": "Al", "PartnerLink": "al",
        "Regatta": "f24/o", "Scoring": "Combined", "raceID": "f24/o/2B", "Date": "09/07/2024", "Team": "T1",
    }], schemas.FLEET_ENTRY)
    r = unify_fleet(fleet).first()
    assert (r.race, r.race_no, r["div"], r.key, r.partner_key, str(r.date), r.season) == (
        "f24/o/2", 2, "B", "Bo-T1", "al", "2024-09-07", "f24")
    boat = {"skipperName": "A", "skipperKey": "a", "crewName": "U", "crewKey": "Unknown-T"}
    match = spark.createDataFrame([{
        "raceID": "s24/m/1", "regatta": "s24/m", "raceNum": 1, "round": "R", "date": "2024-03-04",
        "teamAName": "T", "teamBName": "O", "teamBNick": "N", "teamAOutcome": "win", "teamBOutcome": "lose",
        "teamABoats": [boat, {**boat, "skipperKey": "b", "crewKey": "c", "crewName": "C"}],
        "teamBBoats": [{**boat, "skipperKey": "d", "crewKey": None}],
    }], schemas.TEAM_MATCH)
    got = {r.key: (r.side, r.pos, r.partner, r.outcome) for r in match_boats(unify_matches(match)).collect()}
    assert got == {"a": ("A", "Skipper", "U", "win"), "b": ("A", "Skipper", "C", "win"),
                   "c": ("A", "Crew", "A", "win"), "d": ("B", "Skipper", "U", "lose")}


def test_merge_people(spark):
    people = spark.createDataFrame(
        [("bo", "Bo", "M", "2026", "bo", "T1"), ("bo-2", "Bob", None, "2027", "bo-2", "T2"),
         ("al", "Al", "M", "2025", "al", "T1")],
        "key string, name string, gender string, year string, link string, team string")
    merges = spark.createDataFrame([("bo-2", "bo"), ("absent", "gone")], schemas.IDENTITY_MERGE)
    got = {r.key: (r.name, r.year, r.links, r.teams) for r in merge_people(people, merges).collect()}
    assert got == {"bo": ("Bo", "2026", ["bo", "bo-2"], ["T1", "T2"]), "al": ("Al", "2025", ["al"], ["T1"])}


def test_stream_upsert(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("season", "race", "name")]
                          + [T.StructField("score", T.IntegerType())])
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()

    def drop(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(schema.names, r))) for r in rows))

    def run():
        start_upsert(result_stream(spark, str(inbox), schema), store, str(tmp_path / "cp"),
                     ["season", "race", "name"], ["fetched", "score"], until_done=True).awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(store).select(*schema.names).collect()))

    drop("a.json", [("f24", "1", "x", 1), ("f24", "1", "y", 2), ("s24", "1", "x", 3)])
    assert len(run()) == 3
    time.sleep(1)
    drop("b.json", [("f24", "1", "y", 5), ("f25", "1", "z", 1)])
    want = [("f24", "1", "x", 1), ("f24", "1", "y", 5), ("f25", "1", "z", 1), ("s24", "1", "x", 3)]
    assert run() == want
    again = spark.read.parquet(store).filter("season = 'f24'")
    merge_batch(again.select("season", "race", "name", "score", "fetched"), store,
                ["season", "race", "name"], ["fetched"], "season")
    assert run() == want
    assert os.path.isdir(store)
    assert spark.read.parquet(store).filter(F.col("fetched").isNull()).count() == 0


def test_stream_upsert_keeps_newer_results(spark, tmp_path):
    store = str(tmp_path / "store")
    schema = "season string, race string, score int, at int"

    def merge(*rows):
        merge_batch(spark.createDataFrame(rows, schema), store, ["season", "race"], ["at"], "season")
        return sorted(tuple(r) for r in spark.read.parquet(store).select(
            "race", "score", "at").collect())

    assert merge(("f24", "1", 5, 2), ("f24", "2", 7, 2)) == [("1", 5, 2), ("2", 7, 2)]
    # A late file: older than what is stored for one race, newer for the other.
    assert merge(("f24", "1", 9, 1), ("f24", "2", 8, 3)) == [("1", 5, 2), ("2", 8, 3)]
    assert merge(("f24", "1", 6, 2)) == [("1", 6, 2), ("2", 8, 3)]


def test_markup_accepts_any_quoting(spark):
    from windlass.functions import markup as m

    page = """<p class=results>no</p><table id=x class='a results b'><tr><td class=right>1</td>
      <td data-k="v" class = "far right">2</td><td class="rightmost">3</td></tr></table>
      <table class="results"><tr></tr></table>"""
    row = spark.createDataFrame([(page, "<a>")], "h string, e string").select(
        m.cells_of_class(m.table_of_class(F.col("h"), "results"), "right").alias("cells"),
        m.attribute(m.table_of_class(F.col("h"), "results"), "id").alias("id"),
        m.table_of_class(F.col("h"), "sailors").alias("none"),
        m.attribute(F.lit("<a class=''>"), "class").alias("blank"),
        m.attribute(F.col("e"), "class").alias("absent"),
    ).first()
    assert [c.split(">")[1][0] for c in row.cells] == ["1", "2"]
    assert (row.id, row.none, row.blank, row.absent) == ("x", None, "", None)


def test_match_heats_lose_no_pairing(spark):
    from windlass.plans.rendered_pages import match_heats

    rows = [(1, n, "O") for n in range(1, 400)] + [(1, 9000, "F")]
    rows += [(2, 5, "O"), (2, 90000, "F"), (3, 7, "O")]
    rows += [(4, n, "OF"[n % 2]) for n in range(500)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linestatus string")
    pages = {}
    for r in match_heats(lines, items=64).collect():
        pages.setdefault((r.l_orderkey, r.heat), {"O": set(), "F": set()})[r.l_linestatus].add(r.l_suppkey)
    assert all(p["O"] and p["F"] for p in pages.values())
    for order in (1, 2, 4):
        for side in "OF":
            met = set().union(*(p[side] for (k, _), p in pages.items() if k == order))
            assert met == {n for k, n, s in rows if k == order and s == side}
    assert not any(k == 3 for k, _ in pages)
    assert len([k for k in pages if k[0] == 2]) == 1
