"""The wave schedule of the ordered rating: independence, order, cut points."""

import random
from dataclasses import replace

import numpy as np
import pytest

from windlass.operators.rating_fold import (
    _fold_in_steps, _stretches, assign_waves, cut_by_width, fold_ratings, plackett_luce,
    shared_tasks,
)
from windlass.operators.rating_kernel import FoldOptions, waves_and_groups

COLUMNS = ("pool string, seq long, race string, team long, line long, rank double, key string, "
           "weight double")


def linked_log(races=120, sailors=60, seed=0, pools=("sr", "cr")):
    rng = random.Random(seed)
    rows = []
    for seq in range(races):
        pool = rng.choice(pools)
        for place, who in enumerate(rng.sample(range(sailors), rng.randint(1, 7))):
            rows.append((pool, seq, f"r{seq}", who, who, float(place + 1), f"k{who}", 1.0))
    return rows


def test_groups_are_what_races_link():
    race = np.array([0, 0, 1, 1, 2, 2, 3])
    player = np.array([1, 2, 3, 4, 2, 3, 9])
    wave, linked = waves_and_groups(race, player)
    assert wave.tolist() == [1, 1, 1, 1, 2, 2, 1]
    assert len(set(linked[:6].tolist())) == 1 and linked[6] == 9


@pytest.mark.parametrize("level_rows", [20, 90, 10**6])
def test_no_sailor_meets_two_races_of_a_wave_and_order_is_kept(spark, level_rows):
    rows = linked_log()
    log = spark.createDataFrame(rows, COLUMNS)
    stretches = _stretches(log, 1000, level_rows)
    assert sum(n for _, _, n in stretches) == len(rows)
    levels = {(r["pool"], r["seq"]): (r["stretch"], r["wave"], r["n"])
              for r in assign_waves(log, stretches).collect()}
    last = {}
    for pool, seq, *_, key, _ in rows:
        at = levels[pool, seq][:2]
        if (pool, key) in last and last[pool, key][1] != seq:
            assert at > last[pool, key][0]
        last[pool, key] = (at, seq)
    assert sum(n for *_, n in levels.values()) == len(rows)


def test_cut_points_follow_width():
    widths = [(0, 1, 900, 800), (0, 2, 50, 40), (0, 3, 40, 40), (0, 4, 30, 30), (1, 1, 20, 20)]
    plan = cut_by_width(widths, max_group_rows=100, wide_rows=500, most_rows=1000)
    assert [(s, w, step) for s, w, step, _ in plan] == [
        (0, 1, 0), (0, 2, 1), (0, 3, 1), (0, 4, 2), (1, 1, 3)]
    assert plan[0][3] == 15 and {t for *_, t in plan[1:]} == {0}


@pytest.mark.parametrize("wide_rows, level_rows", [(1, 10**6), (12, 100), (10**6, 60)])
def test_any_cut_gives_the_result_of_one_group(spark, wide_rows, level_rows):
    log = spark.createDataFrame(linked_log(seed=4), COLUMNS)
    spec = plackett_luce(FoldOptions())
    want = {(r["pool"], r["race"], r["key"]): r for r in fold_ratings(log).collect()}
    got = _fold_in_steps(log, spec, None, 200, wide_rows, level_rows).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["pool"], r["race"], r["key"]]
        assert r["predicted"] == w["predicted"]
        assert [r["mu0"], r["mu1"], r["sigma1"]] == pytest.approx(
            [w["mu0"], w["mu1"], w["sigma1"]], rel=1e-12)


def test_a_wide_wave_is_spread_over_tasks(spark):
    rows = [("sr", seq, f"r{seq}", 10 * seq + i, i, float(i), f"k{10 * seq + i}", 1.0)
            for seq in range(60) for i in range(10)]
    rows += [("sr", 60 + j, f"m{j}", 10 * i, i, float(i), f"k{10 * (i + j) }", 1.0)
             for j in range(50) for i in range(10)]
    log = spark.createDataFrame(rows, COLUMNS)
    widths = assign_waves(log, _stretches(log, 10**6, 10**6)).groupBy("wave").sum("n").collect()
    plan = cut_by_width(
        [(0, r["wave"], r["sum(n)"], r["sum(n)"]) for r in sorted(widths)], 10**6, 400, 10**7)
    assert plan[0][3] >= 8


def test_waves_are_those_of_race_after_race():
    rng = np.random.default_rng(3)
    for rows in (1, 2, 30, 400):
        race = np.sort(rng.integers(0, rows // 3 + 1, rows))
        player = rng.integers(-9, rows // 2 + 1, rows)
        wave, linked = waves_and_groups(race, player)
        last = {}
        for r in np.unique(race):
            own = np.flatnonzero(race == r)
            due = max(last.get(p, 0) for p in player[own]) + 1
            assert set(wave[own]) == {due} and len(set(linked[own])) == 1
            last.update(dict.fromkeys(player[own], due))
        assert all(len(set(linked[player == p])) == 1 for p in set(player))


def test_a_wave_is_found_without_a_loop_over_its_races():
    race = np.repeat(np.arange(3000), 2)
    player = _Counted.of(np.arange(6000))
    waves_and_groups(race, player)
    assert _Counted.lists == 0


class _Counted(np.ndarray):
    """Counts how often an array is handed out as single Python values."""

    lists = 0

    @classmethod
    def of(cls, values):
        return values.view(cls)

    def tolist(self):
        _Counted.lists += 1
        return super().tolist()


def test_small_linked_groups_share_tasks():
    # (stretch, wave, rows, rows of the largest group) and what cut_by_width gives.
    widths = [(0, 1, 9000, 10), (0, 2, 9000, 10), (1, 1, 900, 400), (2, 1, 9000, 9000)]
    plan = [(0, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0), (2, 1, 2, 7)]
    assert shared_tasks(widths, plan, 1000, 4) == {0: 72}
    assert shared_tasks(widths[:2], plan[:2], 10**6, 4) == {0: 4}


def test_many_groups_are_few_calls_of_the_rule(spark):
    rows = [("sr", seq, f"r{seq}", 4 * (seq % 50) + i, i, float((seq + i) % 4), f"k{4 * (seq % 50) + i}", 1.0)
            for seq in range(200) for i in range(4)]
    log = spark.createDataFrame(rows, COLUMNS)
    rule = plackett_luce(FoldOptions())
    calls = spark.sparkContext.accumulator(0)
    kernel = rule.kernel

    def counted(pdf):
        calls.add(1)
        return kernel(pdf)

    want = {(r["race"], r["key"]): r["mu1"] for r in fold_ratings(log).collect()}
    got = _fold_in_steps(log, replace(rule, kernel=counted), None, 700, 10**6).collect()
    assert {(r["race"], r["key"]): r["mu1"] for r in got} == pytest.approx(want, rel=1e-12)
    # Fifty groups of races that share nobody, in as many calls as there are tasks.
    assert 1 < calls.value < 50
