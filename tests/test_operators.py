import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windlass.functions import ids
from windlass.operators import compare, dedup
from windlass.operators.exposure import exposure
from windlass.operators.graph import connected_components, page_rank
from windlass.operators.groups import hot_groups, rank_in_group
from windlass.operators.head_to_head import fleet_head_to_head, match_head_to_head
from windlass.operators.ordering import latest_before, race_order
from windlass.sources.sinks import append_to_array, bounded_lists, merge_documents


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("tiebreak", [[], ["k"]])
def test_rank_of_hot_groups_equals_plain_rank(spark, descending, tiebreak):
    rng = random.Random(1)
    data = [("hot", rng.randint(0, 60), i) for i in range(900)]
    data += [("cold", rng.randint(0, 5), i) for i in range(20)]
    data += [("same", 7, i) for i in range(200)]
    data += [("hot", None, i) for i in range(40)] + [("hot", 3, None)] * 3 + [(None, 2, 5)] * 60
    df = spark.createDataFrame(data, "g string, v int, k int")
    hot = hot_groups(df, ["g"], limit=50)
    got = rank_in_group(df, ["g"], "v", "r", tiebreak, descending, hot=hot)
    want = rank_in_group(df, ["g"], "v", "r", tiebreak, descending)
    assert _rows(got) == _rows(want)
    assert hot_groups(df, ["g"], limit=5000) is None
    words = df.withColumn("v", F.concat(F.lit("w"), F.col("v").cast("string")))
    got = rank_in_group(words, ["g"], "v", "r", tiebreak, descending, hot=hot)
    assert _rows(got) == _rows(rank_in_group(words, ["g"], "v", "r", tiebreak, descending))


@pytest.mark.parametrize("inclusive", [True, False])
def test_latest_before_across_chunks(spark, inclusive):
    rng = random.Random(2)
    data = [(rng.choice("ab"), i, rng.randint(0, 1), rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, seq long, step int, v int")
    got = latest_before(df, ["k"], ["seq", "step"], ["v"], chunk=F.floor(F.col("seq") / 7),
                        inclusive=inclusive, suffix="_last")
    w = Window.partitionBy("k").orderBy("seq", "step").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    want = df.withColumn("v_last", F.last("v", True).over(w))
    assert _rows(got.select("k", "seq", "v_last")) == _rows(want.select("k", "seq", "v_last"))


def test_race_order_keeps_regattas_together(spark):
    log = [
        ("x", "x/1", "2024-01-01", 1, "A"), ("y", "y/1", "2024-01-01", 2, "A"),
        ("x", "x/2", "2024-01-03", 2, "A"), ("y", "y/2", "2024-01-02", 3, "B"),
        ("z", "z/1", "2024-01-01", None, "A"), (None, "n", "2024-01-01", 1, "A"),
        ("x", "x/1", "2024-01-01", 1, "B"),
    ]
    df = spark.createDataFrame(log, "regatta string, race string, date string, race_no int, div string")
    for rows in (df, df.orderBy(F.desc("race"))):
        got = {r.race: (r.seq, r.regatta_seq) for r in race_order(rows).collect()}
        assert got == {"x/1": (0, 0), "x/2": (1, 0), "y/1": (2, 2), "y/2": (3, 2), "z/1": (4, 4)}


def test_exposure_against_pairs(spark):
    rng = random.Random(3)
    data = [(f"r{i % 9}", f"s{i}", rng.choice(["N", "S", "W", None])) for i in range(60)]
    got = {r.key: (r.is_cross, r.out_links)
           for r in exposure(spark.createDataFrame(data, "race string, key string, region string"),
                             ["race"]).collect()}
    for race, key, region in data:
        field = [x for x in data if x[0] == race]
        cross = len({x[2] for x in field}) > 1
        links = sum(1 for x in field if cross and region and x[2] and x[2] != region)
        assert got[key] == (int(cross), links)


@pytest.mark.parametrize("part_rows", [3, 1000])
def test_head_to_head_against_pairs(spark, part_rows):
    rng = random.Random(4)
    data = [(f"r{r}", "s24", f"s{k}", rng.randint(1, 5)) for r in range(8)
            for k in rng.sample(range(12), 9)]
    df = spark.createDataFrame(data, "race string, season string, key string, score int").withColumn(
        "pos", F.lit("Skipper"))
    focus = spark.createDataFrame([("s1",), ("s2",), ("none",)], "key string")
    got = {(r.key, r.rival): (r.races, r.wins)
           for r in fleet_head_to_head(df, focus, ["race", "pos"], part_rows).collect()}
    want = {}
    for race, _, key, score in data:
        if key not in ("s1", "s2"):
            continue
        for other in data:
            if other[0] == race and other[2] != key:
                n, w = want.get((key, other[2]), (0, 0))
                want[(key, other[2])] = (n + 1, w + (other[3] > score))
    assert got == want


def test_match_head_to_head(spark):
    rows = [("m", "s24", "Skipper", "A", "a", "win"), ("m", "s24", "Skipper", "A", "b", "win"),
            ("m", "s24", "Skipper", "B", "c", "lose")]
    df = spark.createDataFrame(rows, "race string, season string, pos string, side string, key string, outcome string")
    got = _rows(match_head_to_head(df, df.select("key"), ["race", "pos"], 1))
    assert got == sorted([
        ("a", "Skipper", "c", "s24", 1, 1), ("b", "Skipper", "c", "s24", 1, 1),
        ("c", "Skipper", "a", "s24", 1, 0), ("c", "Skipper", "b", "s24", 1, 0),
    ], key=repr)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    edges += [(100 + i, 101 + i) for i in range(20)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component
           for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_page_rank_with_loose_end(spark):
    edges = [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 2.0)]
    got = {r.node: r["rank"] for r in page_rank(
        spark.createDataFrame(edges, "src string, dst string, weight double"), tolerance=1e-12).collect()}
    rank = dict.fromkeys("abc", 1 / 3)
    for _ in range(120):
        new = dict.fromkeys("abc", 0.05 + 0.85 * rank["c"] / 3)
        for s, d, share in [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0)]:
            new[d] += 0.85 * rank[s] * share
        rank = new
    assert got == pytest.approx(rank)
    assert sum(got.values()) == pytest.approx(1.0)


def test_dedup_and_upsert(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert _rows(dedup.keep_last(df, ["k"], [F.col("o")])) == [(1, 2, "b"), (2, 1, "c")]
    assert _rows(dedup.keep_first(df, ["k"], [F.col("o")])) == [(1, 1, "a"), (2, 1, "c")]
    assert _rows(dedup.duplicated_rows(df, ["k"])) == [(1, 1, "a"), (1, 2, "b")]
    new = spark.createDataFrame([(2, 9, "z"), (3, 1, "n")], df.schema)
    once = dedup.upsert(df.filter("o = 1"), new, ["k"])
    assert _rows(once) == [(1, 1, "a"), (2, 9, "z"), (3, 1, "n")]
    assert _rows(dedup.upsert(once, new, ["k"])) == _rows(once)


def test_documents(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    batch = spark.createDataFrame([("b", 5), ("c", 6)], "id string, n int")
    assert _rows(merge_documents(stored, batch, "id")) == sorted(
        [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)], key=repr)
    lists = spark.createDataFrame([("a", ["p"]), ("b", ["q"])], "id string, xs array<string>")
    more = spark.createDataFrame([("b", ["q", "r"]), ("c", ["s"])], "id string, xs array<string>")
    got = {r.id: r.xs for r in append_to_array(lists, more, "id", "xs").collect()}
    assert got == {"a": ["p"], "b": ["q", "r"], "c": ["s"]}


def test_bounded_lists_hold_every_row(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 450, "big").otherwise("small"))
    out = bounded_lists(df, ["g"], F.col("id").cast("string"), F.col("id"), "items", 50).collect()
    assert sorted(x for r in out for x in r["items"]) == list(range(500))
    assert max(len(r["items"]) for r in out) < 100


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "k int, p string, q string")
    b = spark.createDataFrame([(1, " X", None), (2, "z", "q")], "k int, p string, q string")
    assert _rows(compare.row_differences(a, b, ["k"], fold_text=True)) == [(2, True, False)]
    assert _rows(compare.rows_not_in(a, a.filter("k = 1"))) == [(2, "y", "q")]
    assert compare.drop_all_null(a.filter("k = 1")).columns == ["k", "p"]


def test_id_functions(spark):
    df = spark.createDataFrame(
        [("f24/open/10A", "Combined", None, "Bo", "T1", "1-3,5", "24 Jr"),
         ("s25/x/2B", "2 Divisions", "bo-b", "Bo", "T1", "", "2026")],
        "id string, scoring string, link string, name string, team string, races string, year string")
    c = F.col
    got = df.select(
        ids.race_number(c("id")), ids.race_division(c("id")),
        ids.adjusted_race_id(c("id"), c("scoring")), ids.surrogate_key(c("link"), c("name"), c("team")),
        ids.season_of(c("id")), ids.race_range(c("races"), F.lit(2)), ids.grad_year(c("year")),
        ids.partner_key(F.lit("Unknown"), c("name"), c("team")),
    ).collect()
    assert tuple(got[0]) == (10, "A", "f24/open/10", "Bo-T1", "f24", [1, 2, 3, 5], 2024, "Bo/T1")
    assert tuple(got[1]) == (2, "B", "s25/x/2B", "bo-b", "s25", [1, 2], 2026, "Bo/T1")
    assert spark.range(1).select(ids.season_list(16, 17)).first()[0] == ["f16", "s16", "f17", "s17"]
    dates = ["2024-03-05", "2024-03-05T00:00:00.000", "03/05/2024", "1709596800000", "(2024, 3, 5)", "soon"]
    got = [str(r[0]) for r in spark.createDataFrame([(d,) for d in dates], "d string").select(
        ids.parse_date(c("d"))).collect()]
    assert got == ["2024-03-05"] * 5 + ["None"]
    cells = spark.createDataFrame([("7", None), ("DNF", "(12, DNF)"), ("OCS", "(9: x)"), ("-", None)],
                                  "t string, title string")
    assert [r[0] for r in cells.select(ids.score_cell(c("t"), c("title"))).collect()] == [7, 12, 9, None]
