"""Source divergence against dense sums over all terms."""

import random
import re

import pytest

from windlass.llm import source_audit
from windlass.llm.source_audit import PatternTree, divergence, gaps, pieces

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top=10):
    docs = [(a or "", b or "", TERM.findall(fold(t or ""))) for _, t, a, b in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        terms = {t for d in own for t in d[2]}
        kept = sorted(t for t in terms if sum(t in d[2] for d in own) >= min_docs)

        def shares(part):
            n = [sum(d[2].count(t) for d in part) for t in kept]
            return n, [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n]

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        sources = sorted({d[1] for d in own})
        of = {s: shares([d for d in own if d[1] == s]) for s in sources}
        _, q = shares(own)
        for s in sources:
            items = [(-sum(map(f, of[s][1], of[o][1])), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", i[2], -i[0], k + 1) for k, i in enumerate(sorted(items))}
            items = [(-f(p, b), t.encode(), t) for t, c, p, b in zip(kept, *of[s], q) if c and p > b]
            out |= {(lang, s, "term", i[2], -i[0], k + 1)
                    for k, i in enumerate(sorted(items)[:top])}
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["Wind", "wind", "lee", "boje", "überholen", "ß", "naïve", "x1y", "İz", "日本"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(12)))
        rows.append((k, rng.choice([text, text, None]) if k % 7 else text + " " + text,
                     rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "B", "ç", None])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_divergence_equals_dense_sums(spark, seed):
    rows = random_rows(seed)
    got = rows_of(divergence(spark.createDataFrame(rows, SCHEMA), min_docs=4, top=3))
    assert got == brute(rows, 4, 3)


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = [(1, "a b c", "en", "x"), (2, None, "en", "y"), (3, "", "en", "z"), (4, "q", "fr", "x")]
    got = rows_of(divergence(spark.createDataFrame(rows, SCHEMA), min_docs=1))
    assert got == brute(rows, 1)
    none = rows_of(divergence(spark.createDataFrame(rows, SCHEMA), min_docs=2))
    assert none == brute(rows, 2) and {r[4] for r in none} == {0}


def test_one_source_has_no_pairs_and_empty_tables_no_rows(spark):
    rows = [(k, "alpha beta", "en", "only") for k in range(12)]
    assert rows_of(divergence(spark.createDataFrame(rows, SCHEMA))) == set()
    assert rows_of(divergence(spark.createDataFrame([], SCHEMA))) == set()


def test_repeated_rows_and_ids_are_documents(spark):
    rows = [(1, "rope", "en", "a")] * 6 + [(1, "rope sail sail", "en", "b")] * 5
    got = rows_of(divergence(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, 10)


def test_extra_columns_with_names_of_the_result(spark):
    rows = [(k, "rope sail"[k % 3:], "en", "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 as value", "2 as n", "3 as rank", "4 as item", "5 as part")
    assert rows_of(divergence(df)) == brute(rows, 10)


def test_long_texts_are_counted_in_pieces(monkeypatch, spark):
    text = "mast " * 300_000 + "boom"
    assert sum(map(len, pieces(text.encode()))) == 300_001
    assert [w for p in pieces(b"aa bb cc dd", 4) for w in p] == [b"aa", b"bb", b"cc", b"dd"]
    rows = [(1, text, "en", "a"), (2, "mast boom", "en", "b")]
    assert rows_of(divergence(spark.createDataFrame(rows, SCHEMA), min_docs=2)) == brute(rows, 2)


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_tree_settles_every_pair_of_a_row_once(monkeypatch, held):
    import numpy as np

    monkeypatch.setattr(source_audit, "FLUSH_PAIRS", held)
    rng = np.random.default_rng(held)
    rows = []
    for _ in range(40):
        own = np.flatnonzero(rng.random(7) < 0.6)
        n = rng.integers(1, 3, len(own))
        rows.append((np.stack([own, n, 100 + 37 * n + own, 50 + own]), int(rng.integers(1, 4))))
    rows.sort(key=lambda r: [tuple(c) for c in r[0].T.tolist()])
    tree, want = PatternTree(), {}
    for row, times in rows:
        tree.insert(row, times)
        _, _, p, z = row
        for i in range(row.shape[1]):
            for j in range(i):
                both = (gaps(p[i], p[j]) - gaps(p[i], z[j]) - gaps(z[i], p[j]) + gaps(z[i], z[j]))
                key = (int(row[0, i]) << 32) | int(row[0, j])
                want[key] = want.get(key, 0) + int(both) * times
    keys, values = tree.take()
    assert dict(zip(keys.tolist(), values.tolist())) == want
