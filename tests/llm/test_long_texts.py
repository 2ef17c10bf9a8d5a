"""Very long texts, urls and pages, and the pipeline on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from windlass.llm import decontamination, jaccard_join, shard_shuffle, suffix_dedup, url_filters
from windlass.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    prepare(spark)
    return spark


def long_text(seed, words=60_000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(words))


def test_long_documents_are_read_whole(session):
    text, other = long_text(1), long_text(2)
    near = text[:-9] + "otherwise"
    rows = [(1, text), (2, near), (3, other), (4, text), (5, "short one")]
    docs = session.createDataFrame(rows, "doc_id long, text string")
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.link_texts(docs).collect()}
    assert links == {1: (1, 2), 2: (1, 2), 4: (1, 2), 3: (3, 0), 5: (5, 0)}
    # The item is the document's very end.
    item = " ".join(text.split()[-30:])
    items = session.createDataFrame([(7, item)], "item_id long, text string")
    found = decontamination.contained_items(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7), (4, 7)}
    cut = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1] == text.encode() and cut[4] == b"" and len(cut[2]) < 20 and cut[3] == other.encode()
    placed = shard_shuffle.shuffle_into_shards(docs, 2).collect()
    assert sorted(len(r["text"]) for r in placed) == sorted(len(t) for _, t in rows)


def test_long_urls_and_pages(session, tmp_path):
    url = "http://example.org/en/" + "x/" * 100_000
    got = url_filters.filter_urls(session.createDataFrame([(1, url), (2, None)], "page_id long, url string"))
    assert got.count() == 2
    page = "<p>é</p>" * 300_000
    rows = [(1, url, page), (2, "http://a", page), (3, "http://b", "<p>")]
    session.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet"))
    read = {r["page_id"]: r for r in entry.queries()["op1_warc_transactions"](session, str(tmp_path)).collect()}
    assert read[1]["payload_bytes"] == len(page.encode()) and read[2]["refers_to"] == 1
    assert read[3]["record_type"] == "response"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_with_clashing_columns_and_without_rows(session, tmp_path, empty):
    text = " ".join(f"w{k}" for k in range(80)) + "."
    rows = [(1, text, "en", "a", 9, 1, "x", b"f", 0), (2, text, "en", "a", 9, 2, "y", b"g", 0),
            (None, None, None, None, None, None, None, None, None)]
    docs = session.createDataFrame(rows, (
        "doc_id long, text string, lang string, source string, n_chars long, kept int, uid string, "
        "fp binary, Class_id int"))
    (docs.limit(0) if empty else docs).write.parquet(str(tmp_path / "documents.parquet"))
    session.createDataFrame([], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    got = entry.queries()["pipeline"](session, str(tmp_path))
    assert [r["doc_id"] for r in got.collect()] == ([] if empty else [1])
