"""The fold with the population's running mean, against race after race."""

import random

import pytest
from pyspark.sql import functions as F

from reference_model import rate_race
from windlass.functions.rating_math import DEFAULT
from windlass.operators.population_fold import fold_with_population, running_sum
from windlass.operators.rating_fold import rateable


def log(races=70, sailors=14, seed=0):
    rng = random.Random(seed)
    rows, day = [], 0
    for step in range(races):
        day += rng.choice([0, 0, 1, 3, 30])
        pool = "sr" if step < races // 2 else "cr"
        if pool == "cr" and step == races // 2:
            day = 0  # the second pool's log begins anew
        for who in rng.sample(range(sailors), rng.randint(1, 6)):
            rows.append((pool, step, f"r{step}", f"k{who}", float(rng.randint(1, 4)), day))
    return rows


def one_by_one(rows, people, weekly=0.1):
    state = {p: [DEFAULT.mu, DEFAULT.sigma, None] for p in people}
    out = {}
    for step in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == step]
        mean = sum(s[0] for s in state.values()) / len(state)
        if len(own) < 2:
            continue
        who = [(r[0], r[3]) for r in own]
        weight = sum(state[w][0] for w in who) / len(who) / mean
        for w, r in zip(who, own):
            s = state[w]
            if s[2] is not None and s[1] < DEFAULT.sigma:
                weeks = max((r[5] - s[2]) // 7 - 1, 0)
                s[1] = min(DEFAULT.sigma, s[1] + weeks * weekly * DEFAULT.sigma)
        new = rate_race([[tuple(state[w][:2])] for w in who], [r[4] for r in own],
                        tau=DEFAULT.tau, weights=[[weight]] * len(own))
        for w, r, n in zip(who, own, new):
            out[r[0], r[2], r[3]] = (*state[w][:2], *n[0])
            state[w] = [*n[0], r[5]]
    return out


@pytest.mark.parametrize("races, how", [(70, {}), (24, {"stretch": 10, "max_rounds": 4}), (8, {"max_group_rows": 12})])
def test_population_fold_equals_race_after_race(spark, races, how):
    rows = log(races)
    df = spark.createDataFrame(
        rows, "pool string, seq long, race string, key string, score double, day int")
    ready = rateable(df, F.col("pool"), F.col("score")).join(
        df.select("race", F.col("seq").alias("step"), "day").distinct(), "race")
    people = spark.createDataFrame(
        [(p, f"k{k}") for p in ("sr", "cr") for k in range(16)], "pool string, key string")
    want = one_by_one(rows, [(r["pool"], r["key"]) for r in people.collect()])
    got = fold_with_population(ready, F.col("day"), people, tolerance=1e-11, **how).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["mu0"], r["sigma0"], r["mu1"], r["sigma1"]) == pytest.approx(
            want[r["pool"], r["race"], r["key"]], abs=1e-8)


def test_running_sum_over_chunks(spark):
    df = spark.range(25).select("id", (F.col("id") * 2.0).alias("v"))
    got = running_sum(df, "id", "v", "s", chunk=4).orderBy("id").collect()
    assert [r["s"] for r in got] == [float(k * (k - 1)) for k in range(25)]


def test_a_population_needs_people(spark):
    empty = spark.createDataFrame([], "pool string, key string")
    with pytest.raises(ValueError):
        fold_with_population(empty, F.lit(0), empty)
