"""The operators on small tables: nulls, empty and repeated rows, clashing
names, empty tables, and brute force where there is no SQL."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from windlass.llm import (
    byte_bpe, decontamination, jaccard_join, quality_rules, shard_shuffle, suffix_dedup,
    token_counts, toxicity, url_filters, warc,
)
from windlass.llm.common import ORACLES, prepare

CLASH = ("shard long, slot string, kept int, n_bytes int, uid int, class_id int, n_links int, "
         "score int, host int, verdict int, n_words int, ids int, block int, fp int, size int, "
         "runs int, set_fp int, first_uid int, all_spans int, span_uid int, key int, rep int, "
         "data int, bytes int")


@pytest.fixture(scope="module")
def session(spark):
    prepare(spark)
    return spark


def documents(session, rows, clash=CLASH):
    """Documents (doc_id, text) with a lot of other columns in front."""
    n = len(clash.split(","))
    schema = f"{clash}, doc_id long, text string"
    return session.createDataFrame([(None,) * n + tuple(r) for r in rows], schema)


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, nulls and blanks."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45 and (base := rng.choice(rows)[1]):
            own = base.split()
            if own:
                own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind < 0.6:
            text = f"{text} {passage} {text[:50]}"
        elif kind < 0.65:
            text = rng.choice([None, "", " \n\t", "one two", "one two"])
        rows.append((i, text))
    # A repeated row, a repeated id, and rows without one.
    return rows + [rows[5], (7, "another text under an id that is taken"), (None, rows[3][1]),
                   (None, None)]


def test_shards_are_exact_and_whole(session):
    rows = corpus()
    for bucket_rows, shards in ((10 ** 6, 8), (3, 4), (1, 1)):
        df = documents(session, rows).repartition(5)
        got = shard_shuffle.shuffle_into_shards(df, shards, bucket_rows=bucket_rows)
        assert got.columns[:len(df.columns)] == df.columns
        got = got.select("doc_id", "text", "_shard", "_slot").toPandas()
        sizes = got.groupby("_shard").size()
        assert sizes.sum() == len(rows) and sizes.max() - sizes.min() <= 1
        for _, own in got.groupby("_shard"):
            assert sorted(own["_slot"]) == list(range(len(own)))
        assert collections.Counter(map(str, got[["doc_id", "text"]].fillna("~").values.tolist())) \
            == collections.Counter(map(str, pd.DataFrame(
                rows, columns=["doc_id", "text"]).fillna("~").values.tolist()))
    empty = documents(session, rows).limit(0)
    assert shard_shuffle.shuffle_into_shards(empty).count() == 0


def test_hypergeometric_follows_its_law(session):
    draws = session.range(20000).select(shard_shuffle.hypergeometric(
        F.lit(50), F.lit(20), F.lit(12), shard_shuffle._uniform(F.lit(5), F.col("id"))).alias("k"))
    counts = {r["k"]: r["count"] for r in draws.groupBy("k").count().collect()}
    for k in range(13):
        want = 20000 * math.comb(20, k) * math.comb(30, 12 - k) / math.comb(50, 12)
        assert abs(counts.get(k, 0) - want) < 6 * math.sqrt(want + 1)


def test_every_row_reaches_every_shard(session):
    seen = collections.Counter()
    for seed in range(12):
        rows = session.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"))
        got = shard_shuffle.shuffle_into_shards(rows, 2, seed).collect()
        seen.update((r["doc_id"], r["shard"]) for r in got)
    first = sum(seen[i, 0] for i in range(20))
    assert 12 * 20 * 0.35 < first < 12 * 20 * 0.65


def jaccard_truth(rows):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            low = min([component[i], *(component[j] for j in own)])
            changed |= low != component[i]
            component[i] = low
    return links, component


def test_jaccard_prefixes_are_shuffled_once(session, monkeypatch):
    plans = {}
    write = jaccard_join.materialise

    def watched(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *rest)

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    # Tables of any size are shuffled alike, none is small enough to be sent along.
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{i}" for i in range(40)]
        near = [" ".join(words[:i] + ["x"] + words[i + 1:]) for i in (0, 39)]
        texts = [" ".join(words), *near, "a b c d e f g", "h i j k l m n", None]
        df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link_texts(df).collect()}
    finally:
        session.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0)}
    assert plans["join-prefix-members"].count("Exchange hashpartitioning") == 1


def test_jaccard_join(session):
    rows = corpus(1, 90)
    links, component = jaccard_truth(rows)
    for block in (10 ** 6, 150):
        df = documents(session, rows).repartition(3)
        got = jaccard_join.link_texts(df, block_shingles=block)
        assert got.columns[:len(df.columns)] == df.columns
        got = got.select("doc_id", "text", "_class_id", "_n_links", "is_first").collect()
        key = lambda d, t: (str(d), str(t))
        want, classes = collections.Counter(), {}
        for i, (d, t) in enumerate(rows):
            ids = [rows[j][0] for j in range(len(rows)) if component[j] == component[i]
                   and rows[j][0] is not None]
            want[(*key(d, t), min(ids, default=None), len(links[i]))] += 1
            classes[component[i]] = 1
        assert collections.Counter(
            (*key(r["doc_id"], r["text"]), r["_class_id"], r["_n_links"]) for r in got) == want
        assert sum(r["is_first"] for r in got) == len(classes)
    assert jaccard_join.link_texts(documents(session, rows).limit(0)).count() == 0


def repeats_truth(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = set()
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone |= set(range(s, s + length))
            seen.add(data[s:s + length])
        out[i] = bytes(c for k, c in enumerate(data) if k not in gone)
    return out


@pytest.mark.parametrize("hot, routes", [(200_000, 4096), (1e-9, 4096), (200_000, 3)])
def test_suffix_dedup(session, hot, routes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1.0)
    rows = corpus(2)
    want = repeats_truth(rows, 30)
    df = documents(session, rows).coalesce(1)
    got = suffix_dedup.remove_repeats(df, length=30, gram=8, hot_contexts=hot, routes=routes)
    assert got.columns[:len(df.columns)] == df.columns
    got = got.withColumn("whole", suffix_dedup.whole_characters(F.col("_kept"))).collect()
    key = lambda d, t, k: (str(d), str(t), bytes(k))
    assert collections.Counter(key(r["doc_id"], r["text"], r["_kept"]) for r in got) == \
        collections.Counter(key(d, t, want[i]) for i, (d, t) in enumerate(rows))
    assert all(r["whole"] == r["_kept"].decode("utf-8", "ignore") for r in got)
    assert suffix_dedup.remove_repeats(documents(session, rows).limit(0)).count() == 0


def test_decontamination(session):
    rows = corpus(3)
    long = [(i, t) for i, t in rows if t and len(t.split()) > 40 and i is not None]
    items = [(k, " ".join(t.split()[5:5 + 8 + k])) for k, (_, t) in enumerate(long[:6])]
    items += [(90, None), (None, "x y z a b c"), (91, "one two"), (1, items[0][1]),
              (92, items[0][1].upper() + "\n")]
    table = session.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for d, t in rows:
        have = (t or "").lower().split()
        for k, item in items:
            w = (item or "").lower().split()
            n = min(5, len(w))
            runs = {tuple(have[i:i + n]) for i in range(len(have) - n + 1)}
            shingles = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
            if n and len(shingles & runs) / len(shingles) >= 0.8:
                want[d, k, len(shingles & runs)] += 1
    got = decontamination.contained_items(documents(session, rows), table)
    assert collections.Counter((r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()) == want
    df = documents(session, rows)
    hit = {d for d, *_ in want}
    clean = decontamination.without_items(df, table)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} >= {d for d, _ in rows if d not in hit}
    assert decontamination.contained_items(df, table.limit(0)).count() == 0
    assert decontamination.without_items(df.limit(0), table).count() == 0


def test_per_text_operators_keep_rows_and_columns(session):
    rows = corpus(4) + [(99, "x" * 300_000)]
    df = documents(session, rows)
    vocabulary = byte_bpe.Vocabulary(session)
    coded = byte_bpe.decode_ids(
        byte_bpe.encode_texts(df, vocabulary, ids="_ids"), vocabulary, ids="_ids")
    for r in coded.select("text", "decoded").collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    outs = {
        "counts": token_counts.count_tokens(df, token_counts.load_pieces()),
        "quality": quality_rules.quality_rules(df),
        "score": toxicity.score_texts(df, {"ab": 1.0}, np.zeros(len(toxicity.FEATURES) + 1)),
        "coded": coded,
    }
    for out in outs.values():
        assert out.columns[:len(df.columns)] == df.columns
        assert out.count() == len(rows)
        assert out.limit(0).count() == 0
    words = {str((r["doc_id"], r["text"])): r["_n_words"] for r in outs["counts"].collect()}
    assert all(words[str((d, t))] == len((t or "").split()) for d, t in rows)
    for r in outs["quality"].collect():
        measured = quality_rules.measure([r["text"] or ""]).iloc[0]
        assert r["_n_words"] == measured.n_words and r["_kept"] == bool(measured.kept)


def test_url_filter_table(session):
    rows = [(None, None), (1, ""), (1, "HTTP://A.ORG/x"), (2, "https://m.a.example.com/x"),
            (2, "https://m.a.example.com/x")]
    df = session.createDataFrame([(5, *r) for r in rows], "rule int, page_id long, url string")
    got = url_filters.filter_urls(df)
    assert got.columns == ["rule", "page_id", "url", "host", "path", "_rule", "verdict"]
    assert sorted((str(r["url"]), r["verdict"]) for r in got.collect()) == [
        ("", "allow"), ("HTTP://A.ORG/x", "allow"), ("None", "allow"),
        ("https://m.a.example.com/x", "block"), ("https://m.a.example.com/x", "block")]
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def pages_truth(rows):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, page)
    used, out = set(), collections.Counter()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and data in used
        used.add(data)
        out[page, len(data), digest, "revisit" if again else "response",
            first[data] if again else None] += 1
    return out


def test_warc_round_trip(session, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" + "x" * 120
    rows = [(3, "http://a/ b\n", body), (1, None, body), (2, "http://a", ""), (None, "u", None),
            (4, "http://a", "short"), (5, "http://a", "short"), (3, "http://a", body),
            (None, "v", body), (6, "http://b", "WARC/1.1\r\n" * 20)]
    schema = "page_id long, url string, html string"
    session.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["op1_warc_transactions"](session, str(tmp_path)).collect()
    assert collections.Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in got) == pages_truth(rows)
    os.mkdir(tmp_path / "none")
    session.createDataFrame([], schema).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert entry.queries()["op1_warc_transactions"](session, str(tmp_path / "none")).count() == 0


def test_assembly_follows_identifiers(session):
    def row(record, kind, *to):
        return (record, kind, list(to), None, "u", "d", None, {}, bytearray(b"x"))

    records = session.createDataFrame([
        row("r1", "response"), row("q1", "request", "r1"), row("m1", "metadata", "q1"),
        row("r2", "response", "q2"), row("q2", "request"), row("m2", "metadata", "r2"),
        row("m3", "metadata", "gone"), row("q4", "request"),
        # Chains, also against the direction of their links.
        row("m4", "metadata", "m1"), row("m5", "metadata", "m4"), row("m6", "metadata", "m5"),
        row("q5", "request"), row("m7", "metadata", "q5", "r2"),
        row("m8", "metadata", "lost"), row("m9", "metadata", "m8"),
    ], warc.RECORD_SCHEMA)
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    ids = {k: ([x["record_id"] for x in r["requests"] or []],
               [x["record_id"] for x in r["metadata"] or []]) for k, r in got.items()}
    assert ids == {
        "r1": (["q1"], ["m1", "m4", "m5", "m6"]), "r2": (["q2", "q5"], ["m2", "m7"]),
        "gone": ([], ["m3"]), "q4": (["q4"], []), "lost": ([], ["m8", "m9"])}
    assert got["q4"]["response"] is None and got["r1"]["response"]["payload"] == b"x"


def test_toxicity_learns_from_the_training_fold(session):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(30)] = "zonkish" + rng.choice(["", "e", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    known = session.createDataFrame(
        labels + [(None, 1), (5, None), labels[7]], "doc_id long, toxic int")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    insults, weights = toxicity.fit(toxicity.training_rows(docs, known, held))
    assert any(s.startswith("zonk") for s in insults)
    got = toxicity.score_texts(docs, insults, weights).toPandas()
    assert ((got["score"] >= 0.5) == [t == 1 for _, t in labels]).mean() > 0.99
    insults, weights = toxicity.fit(toxicity.training_rows(docs, known.limit(0), held))
    blank = toxicity.score_texts(documents(session, [(1, None), (2, "")]), insults, weights)
    assert insults == {} and {r["_score"] for r in blank.collect()} == {0.5}


def test_pipeline_against_brute_force(session, tmp_path):
    rows = corpus(6, 40)
    item = " ".join(max((t or "" for _, t in rows), key=len).split()[3:23])
    docs = session.createDataFrame(
        [(d, t, "en", "s", len(t or "")) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    session.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    left = [r for r in rows if quality_rules.measure([r[1] or ""]).iloc[0].kept]
    _, component = jaccard_truth(left)
    order = sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0, i))
    heads = {}
    for i in order:
        heads.setdefault(component[i], left[i])
    left = list(heads.values())
    kept = repeats_truth(left, 100)
    left = [(d, kept[i].decode("utf-8", "ignore")) for i, (d, _) in enumerate(left)]
    shingles = {tuple(item.lower().split()[i:i + 5]) for i in range(16)}
    left = [(d, t) for d, t in left if len(shingles & {
        tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)}) < 0.8 * len(shingles)]
    got = entry.queries()["pipeline"](session, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted(
        (str(d), hashlib.sha256(t.encode()).hexdigest()) for d, t in left)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(session, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got = entry.queries()[name](session, DATA)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.select(", ".join(columns)).fetchall()
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == \
        collections.Counter(rows)
