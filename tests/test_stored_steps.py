"""What the rating queries store, share and delete, with the rows they had before."""

import datetime
import glob
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass import session
from windlass.operators import rating_fold
from windlass.operators.ordering import latest_before
from windlass.operators.rating_fold import _fold_in_steps, final_state, last_rows, plackett_luce
from windlass.operators.rating_kernel import FoldOptions, races_in_order
from windlass.plans import domain
from windlass.plans.history import rating_events, snapshots
from windlass.plans.unify import POOLS

LOG = ("pool string, seq long, race string, team long, line long, rank double, key string, "
       "weight double")


def linked_log(spark, races=90, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([
        (rng.choice(["sr", "cr"]), seq, f"r{seq}", who, who, float(place + 1), f"k{who}", 1.0)
        for seq in range(races)
        for place, who in enumerate(rng.sample(range(40), rng.randint(1, 6)))], LOG)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders, line items and sailors with copies, missing values and ties."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("tables")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    put("region", [(0, "ASIA"), (1, "AFRICA")], "r_regionkey long, r_name string")
    put("nation", [(0, "A", 0), (1, "B", 1)], "n_nationkey long, n_name string, n_regionkey long")
    put("supplier", [(k, f"S#{k}", k % 2, float(k)) for k in range(20)],
        "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")
    day = datetime.datetime(2000, 3, 1)
    put("orders", [
        (k, None if k == 3 else k, None if k in (4, 5) else day + datetime.timedelta(40 * k),
         rng.choice(["1-URGENT", "2-HIGH", "5-LOW", None])) for k in range(30)],
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [
        (rng.randrange(30), rng.randrange(20), n % 7, rng.choice([None, 1000.5, 2500.0, 7000.25 + n]),
         rng.choice([0.08, 0.01]), rng.choice(["N", "A", None]), rng.choice(["O", "F", None]))
        for n in range(300)],
        "l_orderkey long, l_suppkey long, l_linenumber long, l_extendedprice double, l_tax double, "
        "l_returnflag string, l_linestatus string")
    return str(path)


def test_both_logs_come_of_one_stored_table(spark, tables, monkeypatch):
    stored = []
    cut = domain.cut_lineage
    monkeypatch.setattr(domain, "cut_lineage", lambda df: stored.append(df) or cut(df))
    fleet, members = domain.logs(spark, tables)
    assert len(stored) == 1
    assert fleet.columns == domain.entries(spark, tables).columns
    assert rows_of(fleet) == rows_of(domain.entries(spark, tables))
    assert rows_of(members) == rows_of(domain.match_members(spark, tables))
    few = domain.logs(spark, tables, ["race", "key"], ["race", "side"])
    assert [d.columns for d in few] == [["race", "key"], ["race", "side"]]
    assert rows_of(few[1]) == rows_of(members.select("race", "side"))


def test_logs_of_very_large_orders_are_those_of_small_ones(spark, tables, monkeypatch):
    want = [rows_of(d) for d in domain.logs(spark, tables)]
    monkeypatch.setattr(domain, "HOT_GROUP_ROWS", 9)
    assert [rows_of(d) for d in domain.logs(spark, tables)] == want


def scratch(spark):
    return set(glob.glob(session.shared_dir(spark).removeprefix("file:") + "/*"))


def test_tables_stored_on_the_way_are_deleted(spark):
    before = scratch(spark)

    def make():
        inner = session.cut_alone(spark, lambda: session.cut_lineage(spark.range(5)))
        return session.cut_lineage(inner).join(inner, "id")

    kept = session.cut_alone(spark, make)
    assert len(scratch(spark) - before) == 1
    assert kept.count() == 5


@pytest.mark.parametrize("step_files", [0, 10**6])
def test_a_fold_in_steps_leaves_its_result_alone(spark, step_files, monkeypatch):
    monkeypatch.setattr(rating_fold, "STEP_FILES", step_files)
    monkeypatch.setattr(rating_fold, "FOLD_IN_EVERY", 2)
    want = rows_of(rating_fold.fold_ratings(linked_log(spark)))
    log = session.cut_lineage(linked_log(spark))
    before = scratch(spark)
    rated = _fold_in_steps(log, plackett_luce(FoldOptions()), None, 80, 10**6, 60,
                           log_path=log.inputFiles()[0].rsplit("/", 1)[0])
    assert rows_of(rated) == want
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch(spark) - before]
    assert "waves" not in names and names.count("fold-out") == 1 and names.count("latest") <= 1
    assert not glob.glob(session.shared_dir(spark).removeprefix("file:") + "/fold-steps-*/step=*")


def test_last_rows_are_the_final_state(spark):
    rated = rating_fold.fold_ratings(linked_log(spark)).toPandas()
    for pool, rows in rated.groupby("pool"):
        rows = rows.sample(frac=1, random_state=1).reset_index(drop=True)
        got = rows[last_rows(rows)].set_index("key")["mu1"].to_dict()
        state = final_state(spark.createDataFrame(rows.assign(predicted=0)))
        assert got == {r.key: r.mu for r in state.collect()}


def test_names_order_races_that_share_a_seq():
    rows = pd.DataFrame({"seq": [2, 1, 1, 2, 1, 3], "race": ["b", "z", "a", "b", "z", "a"]})
    assert races_in_order(rows).tolist() == [2, 1, 0, 2, 1, 3]
    alone = pd.DataFrame({"seq": [9, 4, 9], "race": ["a", "b", "a"]})
    assert races_in_order(alone).tolist() == [1, 0, 1]
    assert np.array_equal(races_in_order(alone.iloc[:0]), [])


@pytest.mark.parametrize("inclusive", [True, False])
def test_one_scan_is_the_two_level_scan(spark, inclusive):
    rng = random.Random(3)
    df = spark.createDataFrame(
        [(f"k{rng.randrange(5)}", seq, 0, rng.choice([None, float(seq)]), None) for seq in range(200)],
        "k string, seq long, step int, v double, w double")
    how = {"chunk": F.floor(F.col("seq") / 9), "inclusive": inclusive}
    many = latest_before(df, ["k"], ["seq", "step"], ["v", "w"], **how)
    one = latest_before(df, ["k"], ["seq", "step"], ["v", "w"], spread=False, **how)
    assert one.columns == many.columns and rows_of(one) == rows_of(many)
    assert str(one._jdf.queryExecution().optimizedPlan()).count("Join") == 0


def test_snapshots_need_no_join_with_the_order(spark):
    rated = session.cut_lineage(rating_fold.fold_ratings(linked_log(spark)))
    events = rating_events(rated).withColumn("rating", F.round("rating", 4))
    one, many = snapshots(events, spread=False), snapshots(rating_events(rated))
    assert "Join" not in str(one._jdf.queryExecution().optimizedPlan())
    few = ["race", "key", "pool"]
    assert rows_of(one.select(*few, *POOLS)) == rows_of(
        many.select(*few, *[F.round(p, 4).alias(p) for p in POOLS]))
