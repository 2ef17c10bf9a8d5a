"""Dual-tree assignment and Lloyd rounds against a comparison of all pairs."""

import hashlib
import math

import numpy as np
import pytest

from windlass.llm import vector_codes
from windlass.llm.vector_codes import LEAF, Assignment, Tree, compress, digest, pack, unpack

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(points, entries):
    return ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)


def brute(rows, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None
            and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 4096).astype(np.int64)
    books, codes, error = [], [], 0
    for part in np.split(v, 8, axis=1):
        book = part[:entries].copy()
        for _ in range(rounds):
            own = nearest(part, book)
            for e in set(own.tolist()):
                total, n = part[own == e].sum(axis=0), int((own == e).sum())
                book[e] = [int(t) // n for t in total]
        own = nearest(part, book)
        codes.append(own)
        error = error + ((part - book[own]) ** 2).sum(axis=1)
        books.append(book)
    text = ",".join(str(x) for b in books for e in b.tolist() for x in e)
    codes = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1)]
    out = sorted(zip([r[0] for r in kept], [r[2] for r in kept], codes, error.tolist()), key=str)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 777])
@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_descent_finds_the_nearest_entry_of_every_point(n, kind):
    rng = np.random.default_rng(n)
    if kind == "spread":
        points, entries = rng.integers(-999, 999, (n, 3)), rng.integers(-999, 999, (16, 3))
    elif kind == "clusters":
        centres = rng.integers(-9999, 9999, (5, 3))
        points = centres[rng.integers(0, 5, n)] + rng.integers(-9, 9, (n, 3))
        entries = np.concatenate([centres, points[:3]])
    else:
        points, entries = rng.integers(0, 2, (n, 3)), rng.integers(0, 2, (11, 3))
    got = Assignment(Tree.build(points, LEAF), points, entries)
    want = nearest(points, entries)
    assert got.codes().tolist() == want.tolist()
    sums, counts = got.totals()
    for e in range(len(entries)):
        assert counts[e] == (want == e).sum()
        assert sums[e].tolist() == points[want == e].sum(axis=0).tolist()


def test_clusters_are_assigned_by_whole_nodes():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [9000, 0], [0, 9000], [9000, 9000]])
    points = centres[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 2))
    got = Assignment(Tree.build(points, LEAF), points, centres)
    assert len(got.open) < 10
    assert sum(len(node) for node, _ in got.whole) < 60


def test_chunks_come_back_whole():
    points = np.random.default_rng(2).integers(-5000, 5000, (130, 16))
    for part, (tree, own) in enumerate(unpack(pack(points))):
        assert own.tolist() == points[:, 2 * part:2 * part + 2].tolist()
        assert tree.sums[0].tolist() == own.sum(axis=0).tolist()
        assert tree.counts[0] == 130


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = [float(np.float32(x)) for x in rng.normal(size=dims)]
        rows.append((k * 7 % n, v, int(rng.integers(0, 3)) if k % 5 else None))
    return rows


def coded(df):
    got, books = compress(df)
    rows = got.select("vec_id", "label", "code", "error").collect()
    return sorted((tuple(r) for r in rows), key=str), digest(books)


def test_codes_equal_plain_lloyd_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 64)
    rows = vectors(500) + [(3, vectors(1)[0][1], 9)] * 200  # a hot copy
    got = coded(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == brute(rows)


def test_nulls_and_not_finite_vectors_are_dropped_and_few_vectors_suffice(spark):
    rows = vectors(9, 8) + [
        (90, None, 1), (91, [1.0] * 7 + [None], 1), (92, [math.nan] * 8, 1),
        (93, [math.inf] + [0.0] * 7, 1), (None, [0.5] * 8, None), (None, [0.25] * 8, None)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_other_lengths_get_null_codes(spark):
    rows = vectors(20, 8)
    got = coded(spark.createDataFrame([*rows, (500, [1.0, 2.0], 4), (501, [], 4)], SCHEMA))
    want = brute(rows)
    assert got[1] == want[1]
    assert [r for r in got[0] if r[2]] == want[0]
    assert sorted(r[0] for r in got[0] if r[2] is None) == [500, 501]


def test_empty_tables_and_clashing_names(spark):
    empty, books = compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and books.size == 0
    df = spark.createDataFrame(vectors(30, 8), SCHEMA).selectExpr(
        "*", "vec_id as code", "'x' as Error", "array(1, 2) as more", "date'2020-01-01' as day")
    got, _ = compress(df)
    assert got.columns == ["vec_id", "label", "code", "Error", "more", "day", "_code", "_error"]
    row = got.filter("vec_id = 7").collect()[0]
    assert row["code"] == 7 and row["more"] == [1, 2] and len(row["_code"]) == 16


def test_lengths_that_cannot_be_cut_and_large_components_are_errors(spark):
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))
    with pytest.raises(Exception, match="beyond"):
        compress(spark.createDataFrame([(1, [0.0] * 8, 1), (2, [1e9] * 8, 1)], SCHEMA))[0].collect()
