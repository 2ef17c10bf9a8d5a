"""Lists, references, merges and histograms: small cases."""

import math

import pytest
from pyspark.sql import functions as F

from windlass import schemas
from windlass.functions import markup
from windlass.functions.ids import quoted_list
from windlass.operators.head_to_head import fleet_everyone, match_everyone
from windlass.operators.histogram import normal_histogram
from windlass.plans.unify import merge_identities, resolve_merges


def test_list_cells_in_either_quotes(spark):
    cells = {
        "['A', 'B']": ["A", "B"], """["O'Brien", 'Lee']""": ["O'Brien", "Lee"],
        r"""['D\'Arcy', "x \"y\""]""": ["D'Arcy", 'x "y"'], "[]": [], "['']": [""],
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["l"] for r in df.select("c", quoted_list(F.col("c")).alias("l")).collect()}
    assert got == cells


def test_references_and_quoting(spark):
    pages = {
        "<a href='/s/x/' class=big>Ren&#233; &#xE9; &amp;#233; &#0;</a>":
            ("/s/x/", "big", "René é &#233; &#0;"),
        '<a class="a b" href=/y title="">&lt;b&gt;&apos;</a>': ("/y", "a b", "<b>'"),
        "<p>none</p>": (None, None, "none"),
    }
    df = spark.createDataFrame([(h,) for h in pages], "h string")
    h = F.col("h")
    got = df.select("h", markup.link(h), markup.attribute(h, "class"), markup.text(h)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == pages


def test_chains_of_merges_end_at_their_last_key(spark):
    merges = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "w"), ("w", "v"), ("s", "s"),
              (None, "q"), ("d", "f"), ("d", "e")]
    df = spark.createDataFrame(merges, schemas.IDENTITY_MERGE)
    got = {r[0]: r[1] for r in resolve_merges(df).collect()}
    assert got == {"a": "c", "b": "c", "x": "v", "y": "v", "z": "v", "w": "v", "d": "e"}
    rows = spark.createDataFrame([("a", 1), ("d", 2), ("k", 3), (None, 4)], "key string, n int")
    assert {r["n"]: r["key"] for r in merge_identities(rows, df).collect()} == {
        1: "c", 2: "e", 3: "k", 4: None}


@pytest.mark.parametrize("length", [2, 3, 5])
def test_cycles_of_merges_are_an_error(spark, length):
    ring = [(f"k{i}", f"k{(i + 1) % length}") for i in range(length)]
    with pytest.raises(ValueError, match="cycle"):
        resolve_merges(spark.createDataFrame(ring, schemas.IDENTITY_MERGE))


def test_histogram_with_the_normal_curve(spark):
    rows = [("p", float(x)) for x in [0, 1, 1, 2, 3, 9]] + [("q", 5.0), ("q", 5.0), ("p", None)]
    got = normal_histogram(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 3).collect()
    p = {r["bin"]: r for r in got if r["g"] == "p"}
    assert [p[b]["n"] for b in range(3)] == [4, 1, 1] and p[1]["start"] == 3.0
    mean = 16 / 6
    sd = math.sqrt(sum((x - mean) ** 2 for x in [0, 1, 1, 2, 3, 9]) / 6)
    density = math.exp(-0.5 * ((4.5 - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
    assert p[1]["expected"] == pytest.approx(6 * 3 * density)
    q = {r["bin"]: r for r in got if r["g"] == "q"}
    assert [q[b]["n"] for b in range(3)] == [2, 0, 0] and q[0]["expected"] is None


@pytest.mark.parametrize("how", [{}, {"block_rows": 5, "side_rows": 2}])
def test_everybody_against_everybody_by_season(spark, how):
    rows = [(f"r{r}", f"g{r % 2}", "Skipper", "s24" if r < 3 else "f24", f"k{(r * 3 + i) % 7}",
             float(i % 3), "AB"[i % 2], "win" if i % 2 else "lose")
            for r in range(5) for i in range(6)]
    df = spark.createDataFrame(rows, (
        "race string, regatta string, pos string, season string, key string, score double, "
        "side string, outcome string"))
    fleet, match = {}, {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] != b[4]:
                at = (a[4], b[4], a[3])
                n, w = fleet.get(at, (0, 0))
                fleet[at] = (n + 1, w + (b[5] > a[5]))
                if a[6] != b[6]:
                    n, w = match.get(at, (0, 0))
                    match[at] = (n + 1, w + (a[7] == "win"))

    def counted(df):
        return {(r["key"], r["rival"], r["season"]): (r["races"], r["wins"]) for r in df.collect()}

    assert counted(fleet_everyone(df, ["race", "pos"], **how)) == fleet
    assert counted(match_everyone(df, ["race", "pos"], **how)) == match
    assert fleet_everyone(df.limit(0), ["race", "pos"]).count() == 0
