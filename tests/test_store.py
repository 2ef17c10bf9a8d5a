"""The committed document store and the page fetch."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windlass.sources.fetch import Request, Response, cached_first, fetch_pages
from windlass.sources.store import Conflict, DocumentStore

SCHEMA = (T.StructType().add("id", T.StringType()).add("name", T.StringType())
          .add("n", T.LongType()))


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"), SCHEMA, "id", buckets=4)


def rows(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def docs(spark, items, ddl="id string, name string, n long"):
    return spark.createDataFrame(items, ddl)


def test_merge_keeps_fields_that_a_batch_lacks(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    store.merge(docs(spark, [("a", "A", 1), ("b", "B", 2)]), "first")
    store.merge(docs(spark, [("b", 20), ("c", 30)], "id string, n long"), "second")
    assert rows(store.read()) == {"a": ("A", 1), "b": ("B", 20), "c": (None, 30)}
    assert rows(store.read(1)) == {"a": ("A", 1), "b": ("B", 2)}
    store.merge(docs(spark, [("b", 99)], "id string, n long"), "third", replace=True)
    assert rows(store.read())["b"] == (None, 99)


def test_a_repeated_batch_changes_nothing(spark, store):
    batch = docs(spark, [("a", "A", 1)])
    assert store.merge(batch, "x") and not store.merge(batch, "x")
    assert store.version() == 1


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    store.merge(docs(spark, [("a", "A", 1)]), "x")
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.merge(docs(spark, [("a", "lost", 2)]), "y")
    monkeypatch.undo()
    assert rows(store.read()) == {"a": ("A", 1)}
    assert store.merge(docs(spark, [("a", "again", 2)]), "y")
    assert rows(store.read()) == {"a": ("again", 2)}
    store.vacuum()
    assert rows(store.read()) == {"a": ("again", 2)}


def test_only_one_writer_gets_a_version(spark, store):
    store.merge(docs(spark, [("a", "A", 1)]), "x")
    manifest = store.manifest()
    store._commit(manifest, 1)
    with pytest.raises(Conflict):
        store._commit(manifest, 1)


def test_a_merge_that_lost_the_race_is_made_again_on_the_new_version(spark, store):
    other = DocumentStore(spark, store.root, SCHEMA, "id", buckets=4)
    change, done = store._written, []

    def slow(*args):
        if not done:
            done.append(other.merge(docs(spark, [("z", "Z", 26)]), "between"))
        return change(*args)

    store._written = slow
    assert store.merge(docs(spark, [("a", "A", 1)]), "mine")
    assert rows(store.read()) == {"a": ("A", 1), "z": ("Z", 26)}


def test_later_documents_win_whatever_order_batches_come_in(spark, store):
    store.merge(docs(spark, [("a", "new", 5), ("a", "older", 4)]), "1", order=["n"])
    store.merge(docs(spark, [("a", "late", 3), ("b", "B", 1)]), "2", order=["n"])
    store.merge(docs(spark, [("b", "tie", 1)]), "3", order=["n"])
    assert rows(store.read()) == {"a": ("new", 5), "b": ("tie", 1)}


def test_tree_is_deleted_by_pages_and_goes_on_after_a_stop(spark, store):
    paths = [f"team/{k:02d}" for k in range(10)] + ["team/03/races/1", "teams", "z"]
    store.merge(docs(spark, [(p, p, 0) for p in paths]), "1")
    assert not store.delete_tree("team/", page=4, max_pages=2)
    assert set(rows(store.read())) == {*paths[7:10], "teams", "z"}
    assert len(rows(store.read(1))) == 13
    # New documents in the deleted range stay.
    store.merge(docs(spark, [("team/01", "back", 1)]), "2")
    assert store.delete_tree("team/", page=4)
    assert set(rows(store.read())) == {"team/01", "teams", "z"}
    assert store.manifest()["cursor"] is None
    assert store.delete_tree("team/") and set(rows(store.read())) == {"teams", "z"}


def test_manifest_names_folders_of_all_buckets(spark, store):
    store.merge(docs(spark, [(str(k), "x", k) for k in range(40)]), "1")
    held = store.manifest()
    assert set(held["buckets"]) == {"0", "1", "2", "3"} and held["batches"] == ["1"]
    json.dumps(held)


def planted():
    """A fetcher with failures; nested, so that it travels to tasks by value."""

    def fetch(request: Request) -> Response:
        name = request.url.rsplit("/", 1)[-1]
        if name == "gone":
            return Response(404, None)
        if name.startswith("flaky") and request.attempt < int(name[5:]):
            raise TimeoutError("slow")
        if name == "dead":
            raise OSError("refused")
        return Response(200, f"<p>{name}</p>")

    return fetch


def test_fetch_retries_failures_and_keeps_errors(spark):
    urls = [(f"http://h.org/{n}",) for n in ("a", "flaky3", "flaky9", "gone", "dead")]
    df = spark.createDataFrame([*urls, urls[0], (None,), ("no host",)], "url string")
    got = {r["url"].rsplit("/", 1)[-1]: r for r in fetch_pages(df, planted(), 4, 0.001).collect()}
    assert len(got) == 6
    assert (got["a"]["html"], got["a"]["tries"], got["a"]["error"]) == ("<p>a</p>", 1, None)
    assert (got["flaky3"]["status"], got["flaky3"]["tries"]) == (200, 3)
    assert (got["flaky9"]["html"], got["flaky9"]["error"]) == (None, "TimeoutError: slow")
    assert (got["gone"]["status"], got["gone"]["tries"], got["gone"]["error"]) == (404, 1, "HTTP 404")
    assert got["dead"]["tries"] == 4 and got["dead"]["error"] == "OSError: refused"


def test_cached_pages_are_not_fetched(spark):
    df = spark.createDataFrame(
        [("http://h.org/dead", "stored"), ("http://h.org/b", None)], "url string, cached string")
    got = {r["url"]: r["html"] for r in fetch_pages(df, cached_first(planted()), 2, 0.001).collect()}
    assert got == {"http://h.org/dead": "stored", "http://h.org/b": "<p>b</p>"}


def test_a_host_is_dealt_over_its_slots(spark):
    df = spark.range(400).select(F.concat(F.lit("http://One.org/"), "id").alias("url"))
    got = fetch_pages(df, lambda r: Response(200, r.url), slots=4)
    used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert got.count() == 400 and used > 1
