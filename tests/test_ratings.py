import random

import pytest
from pyspark.sql import functions as F

from reference_model import fold, rate_race
from windlass.functions.rating_math import DEFAULT, RatingParams, normal_cdf, ordinal
from windlass.operators.one_race import rate_races
from windlass.operators.rating_fold import fold_ratings, rateable, skip_seen
from windlass.operators.rating_kernel import FoldOptions, normalised_weights

GOLDEN = {
    2: [(27.945358, 7.956891, 1097.7924), (22.054642, 7.956891, 956.4153)],
    3: [(28.2065, 8.153362, 1089.9139), (25.801625, 7.946024, 1047.1253),
        (20.991875, 7.946024, 931.6913)],
}
PLAYERS = "race string, team long, rank double, key string, mu double, sigma double"


@pytest.mark.parametrize("spread", [False, True])
def test_goldens(spark, spread):
    rows = [(f"n{n}", i, float(i + 1), f"p{i}", 25.0, 25 / 3) for n in GOLDEN for i in range(n)]
    rated = rate_races(
        spark.createDataFrame(rows, PLAYERS), ["race"], RatingParams(tau=0.0), spread=spread
    ).withColumn("ord", ordinal(F.col("mu1"), F.col("sigma1")))
    for r in rated.collect():
        mu, sigma, value = GOLDEN[int(r.race[1:])][r.team]
        assert r.mu1 == pytest.approx(mu, abs=1e-5)
        assert r.sigma1 == pytest.approx(sigma, abs=1e-5)
        assert r.ord == pytest.approx(value, abs=1e-3)


def _race(rng, name, teams, size):
    return [
        (name, t, float(rank), f"{name}{t}-{i}", rng.uniform(15, 35), rng.uniform(1, 8))
        for t in range(teams)
        for rank in [rng.randint(1, max(2, teams // 2))]
        for i in range(size)
    ]


@pytest.mark.parametrize("spread", [False, True])
def test_windows_match_double_loop(spark, spread):
    rng = random.Random(3)
    rows = [r for i in range(12) for r in _race(rng, f"r{i}", rng.randint(2, 9), rng.randint(1, 3))]
    rated = rate_races(spark.createDataFrame(rows, PLAYERS), ["race"], DEFAULT, spread=spread)
    got = {r.key: (r.mu1, r.sigma1) for r in rated.collect()}
    for name in {r[0] for r in rows}:
        teams = sorted({r[1] for r in rows if r[0] == name})
        members = [[r for r in rows if r[0] == name and r[1] == t] for t in teams]
        want = rate_race([[(r[4], r[5]) for r in m] for m in members],
                         [m[0][2] for m in members], tau=DEFAULT.tau)
        for m, w in zip(members, want):
            for r, (mu, sigma) in zip(m, w):
                assert got[r[3]] == pytest.approx((mu, sigma), abs=1e-9)


def _log(seed, races, sailors, islands=1):
    rng = random.Random(seed)
    rows = []
    for seq in range(races):
        island = rng.randrange(islands)
        pool = rng.choice(["sr", "cr"])
        crew = rng.sample(range(sailors), rng.randint(2, 7))
        for k in crew:
            rows.append((pool, seq, f"i{island}s{k}", float(rng.randint(1, 4))))
    return rows


def _rows(spark, log):
    df = spark.createDataFrame(log, "pool string, seq long, key string, score double")
    df = df.withColumn("race", F.concat("pool", F.lit("/"), F.col("seq").cast("string")))
    return rateable(df, F.col("pool"), F.col("score"))


def _check(rated, log):
    want = fold([(p, s, k, r, k) for p, s, k, r in log])
    got = rated.collect()
    assert len(got) == len(want) == len(log)
    for r in got:
        before, after, place = want[(r.pool, r.seq, r.key)]
        assert (r.mu0, r.sigma0) == pytest.approx(before, abs=1e-8)
        assert (r.mu1, r.sigma1) == pytest.approx(after, abs=1e-8)
        assert r.predicted == place


def test_fold_matches_one_race_at_a_time(spark):
    log = _log(1, 120, 15)
    _check(fold_ratings(_rows(spark, log)), log)


def test_fold_ignores_row_order(spark):
    log = _log(2, 60, 10)
    shuffled = list(log)
    random.Random(0).shuffle(shuffled)
    _check(fold_ratings(_rows(spark, shuffled)), log)


def test_blocks_give_the_same_result(spark):
    log = _log(4, 150, 12, islands=4)
    _check(fold_ratings(_rows(spark, log), max_group_rows=60), log)


def test_race_larger_than_a_group(spark):
    log = [("sr", s, k, r) for _, s, k, r in _log(5, 12, 12)]
    log += [("sr", 12, f"i0s{k}", float(k % 9)) for k in range(40)]
    log += [("sr", 13, f"i0s{k}", float(k)) for k in range(5)]
    _check(fold_ratings(_rows(spark, log), max_group_rows=20), log)


def test_state_restore_equals_full_run_and_rerun_adds_nothing(spark):
    from windlass.operators.rating_fold import final_state

    log = _log(6, 80, 10)
    rows = _rows(spark, log)
    full = fold_ratings(rows)
    first = fold_ratings(rows.filter("seq < 50"))
    second = fold_ratings(skip_seen(rows, first), state=final_state(first))
    _check(first.unionByName(second), log)
    assert skip_seen(rows, full).count() == 0


def test_only_own_pool_moves_and_change_is_after_minus_before(spark):
    rated = fold_ratings(_rows(spark, _log(7, 60, 8)))
    jumps = {}
    for r in sorted(rated.collect(), key=lambda r: r.seq):
        last = jumps.get((r.pool, r.key))
        if last:
            assert (r.mu0, r.sigma0) == last
        jumps[(r.pool, r.key)] = (r.mu1, r.sigma1)


def test_weights(spark):
    assert normalised_weights([0, -0.5]) == [2.0, 1.0]
    assert normalised_weights([0]) == [2.0]
    rows = [("r", t, float(t), f"t{t}p{i}", 25.0, 8.0, w)
            for t in range(3) for i, w in enumerate([2.0, 1.0])]
    df = spark.createDataFrame(rows, PLAYERS + ", weight double")
    got = {r.key: (r.mu1, r.sigma1)
           for r in rate_races(df, ["race"], RatingParams(tau=0.0), weight="weight").collect()}
    want = rate_race([[(25.0, 8.0)] * 2] * 3, [0, 1, 2], weights=[[2.0, 1.0]] * 3)
    for t in range(3):
        for i in range(2):
            assert got[f"t{t}p{i}"] == pytest.approx(want[t][i], abs=1e-9)
    fold_rows = rateable(
        df.withColumns({"seq": F.lit(0).cast("long")}), F.lit("pair"), F.col("rank"),
        team=F.col("team"), weight=F.col("weight"),
    )
    folded = fold_ratings(
        fold_rows, FoldOptions(params=RatingParams(mu=25.0, sigma=8.0, tau=0.0))
    )
    for r in folded.collect():
        assert (r.mu1, r.sigma1) == pytest.approx(got[r.key], abs=1e-9)


def test_normal_cdf(spark):
    import math

    xs = [-40.0, -8.0, -7.2, -3.0, -0.5, 0.0, 0.1, 2.0, 6.9, 7.3, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", normal_cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-14)
