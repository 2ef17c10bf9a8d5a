"""What the ordered rating stores between steps, and which races are rated alone."""

from dataclasses import replace

from windlass.operators.rating_fold import (
    _fold_in_steps, _Ratings, _single_races, fold_ratings, plackett_luce,
)
from windlass.operators.rating_kernel import FoldOptions
from windlass.session import cut_lineage

COLUMNS = ("pool string, seq long, race string, team long, line long, rank double, key string, "
           "weight double")


def _log(spark, races=90, sailors=20, field=4):
    return spark.createDataFrame([
        ("sr", seq, f"r{seq}", i, i, float(i), f"k{(seq * 7 + i * 3) % sailors}", 1.0)
        for seq in range(races) for i in range(field)], COLUMNS)


def test_a_stretch_of_many_races_is_no_single_race():
    assert _single_races([(0, 40, 900), (41, 41, 500), (42, 42, 50)], 100) == [1]


def test_races_below_the_group_size_never_take_the_path_of_large_ones(spark):
    def refuse(rows, chunk_rows):
        raise AssertionError("rated as a large race")

    log = _log(spark)
    spec = replace(plackett_luce(FoldOptions()), large_race=refuse)
    got = {(r.race, r.key): r.mu1 for r in _fold_in_steps(log, spec, None, 60, 10**6, 10**6).collect()}
    assert got == {(r.race, r.key): r.mu1 for r in fold_ratings(log).collect()}


def test_a_step_leaves_one_row_per_sailor(spark, tmp_path):
    spec = plackett_luce(FoldOptions())
    ratings = _Ratings(spark, None, spec)
    rated = fold_ratings(_log(spark))
    for number, part in enumerate((rated.filter("seq < 50"), rated.filter("seq >= 50"))):
        path = str(tmp_path / f"step{number}")
        part.write.parquet(path)
        ratings.add(path)
        assert spark.read.parquet(ratings.recent[-1]).count() == 20
    last = {r.key: r for r in rated.orderBy("seq").collect()}
    rows = ratings.attach(_log(spark, races=20)).collect()
    assert {r.key: r.mu for r in rows} == {k: last[k].mu1 for k in {r.key for r in rows}}


def test_cut_lineage_leaves_a_table_read_by_column(spark):
    cut = cut_lineage(spark.range(1000).selectExpr("id", "repeat('x', 500) AS text"))
    assert all(f.endswith(".parquet") for f in cut.inputFiles()) and cut.inputFiles()
    assert cut.count() == 1000 and cut.filter("length(text) = 500").count() == 1000


def test_the_log_is_stored_once_and_single_large_races_apart(spark, monkeypatch):
    from windlass.operators import rating_fold

    made, scratch = [], rating_fold.scratch_path

    def recorded(session, name):
        made.append(name)
        return scratch(session, name)

    monkeypatch.setattr(rating_fold, "scratch_path", recorded)
    spec = plackett_luce(FoldOptions())
    log = cut_lineage(_log(spark, races=2))
    whole = {(r.race, r.key): r.mu1 for r in fold_ratings(log).collect()}
    _fold_in_steps(log, spec, None, 30, 10**6, 10**6).collect()
    assert "fold-log" not in made and "fold-alone" not in made
    alone = _fold_in_steps(log, spec, None, 3, 10**6, 10**6).collect()
    assert made.count("fold-alone") == 1
    assert {(r.race, r.key): round(r.mu1, 9) for r in alone} == {
        k: round(v, 9) for k, v in whole.items()}


def test_no_task_gets_more_lines_as_the_table_grows(spark, monkeypatch):
    from windlass.plans import domain

    monkeypatch.setattr(domain, "TASK_LINES", 50)
    for rows in (100, 1000):
        lines = spark.range(rows).selectExpr("id AS l_orderkey", "id % 7 AS l_suppkey")
        dealt = domain._by_order(lines)
        assert dealt.count() == rows
        parts = dealt.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
        assert max(r["count"] for r in parts) <= 100
