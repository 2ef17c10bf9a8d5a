"""The rating stream replayed in pieces, against the batch fold."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windlass.operators.ordering import race_order
from windlass.operators.rating_fold import fold_ratings, rateable
from windlass.streaming.ratings import STATE_SETTINGS, rate_stream

SCHEMA = ("pool string, regatta string, race string, ts timestamp, race_no int, div string, "
          "team long, line long, rank double, key string, weight double")
START = datetime(2024, 3, 1)


def log(regattas=12, seed=0):
    rng = random.Random(seed)
    rows = []
    for g in range(regattas):
        day = START + timedelta(days=rng.randrange(40))
        for no in range(1, rng.randint(2, 5)):
            ts = day + timedelta(days=no // 2)
            for pool in ("sr", "cr"):
                for place, who in enumerate(rng.sample(range(15), rng.randint(2, 6))):
                    rows.append({
                        "pool": pool, "regatta": f"g{g}", "race": f"g{g}/{no}", "ts": str(ts),
                        "race_no": no, "div": "AB"[no % 2], "team": who, "line": who,
                        "rank": float(place + 1), "key": f"k{who}", "weight": 1.0})
    return rows


def heartbeat(ts):
    return [{"pool": p, "ts": str(ts)} for p in ("sr", "cr")]


@pytest.fixture
def replay(spark, tmp_path):
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()

    def send(number, rows):
        (inbox / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
        query = rate_stream(stream, delay="1 day", regatta_days=5).writeStream.option(
            "checkpointLocation", str(tmp_path / "cp")).foreachBatch(
            lambda df, n: df.write.mode("overwrite").parquet(str(out / f"batch={n}"))).trigger(
            availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.read.parquet(str(out)).drop("batch").collect()

    yield send
    for name in STATE_SETTINGS:
        spark.conf.unset(name)


def test_a_replayed_and_restarted_stream_equals_the_batch_fold(spark, replay):
    rows = log()
    rows.sort(key=lambda r: (r["ts"], r["race"]))
    # Rows of a day arrive shuffled; every send is a new start from the checkpoint.
    random.Random(1).shuffle(first := [r for r in rows if r["ts"] < "2024-03-20"])
    second = [r for r in rows if r["ts"] >= "2024-03-20"]
    replay(0, first)
    replay(1, second)
    got = replay(2, heartbeat(START + timedelta(days=100)))
    got = replay(3, heartbeat(START + timedelta(days=200)))
    batch = spark.createDataFrame(
        [{**r, "ts": datetime.fromisoformat(r["ts"])} for r in rows], SCHEMA
    ).withColumn("date", F.col("ts"))
    order = race_order(batch.select("regatta", "race", "date", "race_no", "div"))
    placed = batch.join(order.select("regatta", "race", "seq"), ["regatta", "race"])
    want = {(r["pool"], r["race"], r["key"]): r for r in fold_ratings(rateable(
        placed, F.col("pool"), F.col("rank"), F.col("team"), F.col("line"))).collect()}
    assert len(got) == len(want) and not any(r["late"] for r in got)
    for r in got:
        w = want[r["pool"], r["race"], r["key"]]
        assert [r["mu0"], r["mu1"], r["sigma1"], r["predicted"]] == pytest.approx(
            [w["mu0"], w["mu1"], w["sigma1"], w["predicted"]], abs=1e-9)


def test_late_rows_come_out_unrated_and_change_nothing(spark, replay):
    rows = log(4, seed=3)
    replay(0, rows)
    replay(1, heartbeat(START + timedelta(days=100)))
    before = replay(2, heartbeat(START + timedelta(days=101)))
    assert len(before) == len(rows)
    # Before the watermark: dropped by Spark. A closed regatta's row after it: late.
    dropped = {**rows[0], "regatta": "new", "race": "new/1"}
    late = {**rows[0], "key": "k99", "team": 99, "line": 99, "ts": str(START + timedelta(days=150))}
    replay(3, [dropped, late])
    got = replay(4, heartbeat(START + timedelta(days=180)))
    assert sorted(r for r in got if not r["late"]) == sorted(before)
    assert [(r["key"], r["mu1"]) for r in got if r["late"]] == [("k99", None)]
