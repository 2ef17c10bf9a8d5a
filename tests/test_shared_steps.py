"""The steps that the ranked and the head-to-head queries share: same rows, less work."""

import random

from pyspark.sql import functions as F

from windlass.operators import groups
from windlass.operators.exposure import exposure
from windlass.operators.head_to_head import fleet_everyone, fleet_head_to_head
from windlass.plans import domain
from windlass.plans.unify import fleet_women, womens_regattas


def log(spark, races=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for n in range(races):
        for who in rng.sample(range(30), rng.randint(1, 9)):
            rows.append((f"g{n % 6}", None if n == 7 else f"r{n}", rng.choice(["Skipper", "Crew"]),
                         f"k{who}", "F" if n % 6 < 2 or who % 3 else rng.choice(["M", None]),
                         rng.choice(["EAST", "WEST", "?", None]), "f00", float(who)))
    return spark.createDataFrame(
        rows, "regatta string, race string, pos string, key string, gender string, "
              "region string, season string, score double")


def rows_of(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_windows_count_rivals_as_joins_do(spark):
    cols = ["race", "pos", "key", "is_cross", "out_links", "field"]
    keys = ["race", "pos"]
    by_join, by_window = exposure(log(spark), keys), exposure(log(spark), keys, spread=False)
    assert dict(by_join.dtypes) == dict(by_window.dtypes)
    assert rows_of(by_join, *cols) == rows_of(by_window, *cols)


def test_womens_regattas_are_those_of_the_full_count(spark):
    want = rows_of(fleet_women(log(spark)), "regatta", "womens")
    assert rows_of(womens_regattas(log(spark)), "regatta", "womens") == want
    assert any("True" in w for w in want) and any("False" in w for w in want)


def test_keys_are_counted_only_in_full_slots(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("g")).unionAll(
        spark.range(60).select(F.lit(-1).cast("long").alias("g")))
    hot = groups.hot_groups(df, ["g"], 50)
    assert [tuple(r) for r in hot.collect()] == [(-1, 60)]
    # Where no slot is above the limit, keys are not counted at all.
    frame = type(df)
    grouped, group_by = [], frame.groupBy
    frame.groupBy = lambda self, *cols: grouped.append(cols) or group_by(self, *cols)
    try:
        assert groups.hot_groups(df, ["g"], 1000) is None
    finally:
        frame.groupBy = group_by
    assert grouped == [("_slot",)]


def test_large_races_meet_in_parts_and_small_ones_at_once(spark):
    entries = log(spark).filter("race is not null")
    focus = entries.select("key").distinct().limit(8)
    keys = ["race", "pos"]
    for side_rows, part_rows in ((1, 1), (3, 2), (10**6, 10**6)):
        whole = fleet_everyone(log(spark), keys, side_rows=side_rows)
        met = fleet_head_to_head(log(spark), focus, keys, part_rows)
        if side_rows == 1:
            want_whole, want_met = rows_of(whole, *whole.columns), rows_of(met, *met.columns)
        assert rows_of(whole, *whole.columns) == want_whole
        assert rows_of(met, *met.columns) == want_met


def test_the_state_is_computed_once(spark, tmp_path, monkeypatch):
    """Ranks count the state's rows and then read them: both from a table."""
    monkeypatch.setattr(domain, "sailors", lambda s, d: s.range(30).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("s_suppkey")))
    members = log(spark).withColumns({"side": F.lit("A"), "outcome": F.lit("win")})
    state = domain.static_state(spark, "", log(spark), members)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert state.count() == state.select("pool", "key").distinct().count() > 0
