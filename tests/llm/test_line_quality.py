"""Line chains against sums over all labellings, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.llm import line_quality
from windlass.llm.line_quality import (
    OWN, WIDTH, Chains, Model, fit, line_features, lines_of, minimise, objective, score_texts,
    training_rows, with_neighbours,
)


@pytest.mark.parametrize("sizes", [[1], [4], [3, 1, 5], [2, 2, 2, 6]])
def test_marginals_and_totals_equal_sums_over_all_labellings(sizes):
    rng = np.random.default_rng(sum(sizes))
    score, arcs = rng.normal(size=sum(sizes)) * 3, rng.normal(size=(2, 2))
    got = Chains(score, arcs, np.array(sizes))
    total, at, pairs = 0.0, 0, np.zeros((2, 2))
    for size in sizes:
        own, weights = score[at:at + size], {}
        for labels in itertools.product((0, 1), repeat=size):
            w = sum(s / 2 if b else -s / 2 for s, b in zip(own, labels))
            weights[labels] = np.exp(w + sum(arcs[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for k in range(size):
            good = sum(w for labels, w in weights.items() if labels[k]) / z
            assert got.marginals[at + k, 1] == pytest.approx(good, rel=1e-9)
        for labels, w in weights.items():
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += w / z
        at += size
    assert got.log_total == pytest.approx(total)
    assert np.allclose(got.arcs, pairs)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    sizes, good = np.array([3, 1, 4]), np.array([True, False, True])
    own = rng.normal(size=(8, OWN))
    model = rng.normal(size=WIDTH + 4) * 0.3
    _, slope = objective(model, own, sizes, good)
    for k in [0, 5, OWN, 2 * OWN + 1, WIDTH - 1, WIDTH, WIDTH + 1, WIDTH + 3]:
        step = np.zeros(len(model))
        step[k] = 1e-5
        up, down = (objective(model + d, own, sizes, good)[0] for d in (step, -step))
        assert slope[k] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_minimise_reaches_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    goal = np.array([1.0, -2.0, 3.0])
    got = minimise(lambda x: ((x - goal) @ a @ (x - goal), 2 * a @ (x - goal)), np.zeros(3), 60)
    assert np.allclose(got, goal, atol=1e-2)


def test_neighbours_stay_inside_a_chain():
    own = np.arange(1.0, 5.0)[:, None].repeat(OWN, axis=1)
    x = with_neighbours(own, np.array([3, 1]))
    assert x[:, OWN].tolist() == [0, 1, 2, 0]
    assert x[:, 2 * OWN].tolist() == [2, 3, 0, 0]
    assert x[:, 3 * OWN].tolist() == [0, 1, 1, 0] and x[:, 3 * OWN + 1].tolist() == [1, 1, 0, 0]


def test_features_of_lines():
    lines = ["Hello Wörld. ".encode(), b"go go go 12##", b"go go go 12##", b"x"]
    got, chars = line_features(lines, np.array([0, 0, 0, 1]))
    name = {n: k for k, n in enumerate(line_quality.FEATURES)}
    assert chars.tolist() == [13, 13, 13, 1]
    assert got[0, name["letters"]] == pytest.approx(10 / 11)
    assert got[1, name["repeated"]] == pytest.approx(2 / 4)
    assert got[1, name["symbols"]] == pytest.approx(2 / 10)
    assert got[:, name["line_again"]].tolist() == [0, 1, 1, 0]
    assert got[:, name["begins"]].tolist() == [1, 0, 0, 0]


def test_long_lines_and_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(line_quality, "LINE_BYTES", 10)
    assert lines_of(b"aaaa bbbb cccc\n\n \nd" + b"e" * 25) == [
        b"aaaa bbbb ", b"cccc", b"deeeeeeeee", b"eeeeeeeeee", b"eeeeee"]
    monkeypatch.setattr(line_quality, "RUN_LINES", 3)
    texts = [b"a\n" * 8, None, b"b"]
    parts = list(line_quality._slices(texts))
    assert sum(len(p[0]) for p in parts) == 9
    assert [s for p in parts for s in p[2].tolist()] == [3, 3, 2, 1]


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))) for _ in range(300)]
    rows = []
    for k in range(n):
        good = k % 4 != 0
        lines = []
        for _ in range(rng.randrange(1, 8)):
            w = rng.choices(words, k=rng.randrange(6, 30))
            lines.append(" ".join(w).capitalize() + "." if good or rng.random() < 0.2
                         else " ".join(x + "###" for x in w))
        rows.append((k, "\n".join(lines), good))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model = fit(df.filter("doc_id < 300").select(F.col("text").cast("binary"), "good"))
    got = score_texts(df.filter("doc_id >= 300"), model).collect()
    right = sum((r["score"] >= 0.7) == r["good"] for r in got)
    assert right >= 0.97 * len(got)


def test_defined_cases(spark):
    labels = spark.createDataFrame(
        [(k, int(g)) for k, _, g in corpus(80)] + [(1, 0), (2, None), (None, 1)],
        "doc_id long, quality int")
    rows = [(k, t, "en") for k, t, _ in corpus(80)]
    rows += [(900, None, "en"), (901, "", None), (902, " \n\t", "en"), (903, "Long line. " * 30_000, "en"),
             (904, "x\n" * 70_000, "en"), (None, "A fine text.", "en"), (905, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    chosen = training_rows(docs, labels, F.coalesce(F.col("doc_id") == 5, F.lit(False)))
    assert chosen.count() == 79
    model = fit(chosen)
    got = score_texts(docs, model)
    assert got.columns == ["doc_id", "text", "score", "_score"]
    scores = {r["doc_id"]: r["_score"] for r in got.collect()}
    assert len(scores) == 87 and all(0 <= s <= 1 for s in scores.values())
    assert scores[900] == scores[901] == scores[902] == model.share
    assert scores[905] == scores[1]
    assert score_texts(docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds_every_score_is_the_share(spark):
    rows = spark.createDataFrame([(bytearray(b"a b"), True)], "text binary, good boolean")
    docs = spark.createDataFrame([("x",), (None,)], "text string")
    assert [r["score"] for r in score_texts(docs, fit(rows)).collect()] == pytest.approx([1, 1])
    assert {r["score"] for r in score_texts(docs, fit(rows.limit(0))).collect()} == {0.5}


def test_training_rows_are_bounded(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    docs = spark.range(5000).selectExpr("id as doc_id", "'a' as text")
    n = training_rows(docs, labels, F.lit(False), 500).count()
    assert 350 < n < 650


def test_scores_do_not_depend_on_how_texts_meet(spark):
    texts = [t.encode() for _, t, _ in corpus(40)]
    rng = np.random.default_rng(0)
    model = Model(np.zeros(OWN), np.ones(OWN), rng.normal(size=WIDTH + 4), (1.0, 0.0), 0.5)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
