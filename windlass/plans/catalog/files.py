"""File sources and sinks: written to the shared folder and read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from windlass import schemas
from windlass.operators.dedup import upsert
from windlass.plans import domain
from windlass.plans.domain import SAILORS_SQL, table
from windlass.plans.registry import query
from windlass.session import scratch_path
from windlass.sources import fetch, files, sinks
from windlass.sources.store import DocumentStore

SAILORS_WITH = "WITH " + SAILORS_SQL.strip()

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()),
])


@query(
    "json_snapshot_round_trip", "A01 B01 B04",
    "SELECT c_custkey, c_name, c_nationkey, '2001-08-01' AS snapshot_date FROM customer",
)
def json_snapshot_round_trip(spark, sf):
    path = scratch_path(spark, "snapshot")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    sinks.write_snapshot(rows, path, "2001-08-01")
    return files.read_json(spark, f"{path}/snapshot_date=2001-08-01", CUSTOMER).withColumn(
        "snapshot_date", F.lit("2001-08-01")
    )


@query(
    "column_json_import", "A01 I19 I21",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def column_json_import(spark, sf):
    """Orders as column-oriented documents of 64 rows, read back as rows."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    doc = F.shiftright("o_orderkey", 6)
    row_id = F.pmod("o_orderkey", F.lit(64)).cast("string")
    orders = table(spark, sf, "orders").select(*cols)
    cells = [
        F.map_from_entries(
            F.collect_list(F.struct(row_id.alias("k"), F.col(c).cast("string").alias("v")))
        ).alias(c)
        for c in cols
    ]
    docs = orders.groupBy(doc.alias("doc")).agg(*cells)
    path = scratch_path(spark, "column-json")
    docs.select("doc", F.to_json(F.struct(*cols)).alias("text")).write.parquet(path)
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
    ])
    return files.column_json_rows(files.read_parquet(spark, path), "doc", "text", schema).select(*cols)


@query(
    "parquet_scan", "A02",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'",
)
def parquet_scan(spark, sf):
    return table(spark, sf, "lineitem").filter(
        (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R")
    ).select("l_orderkey", "l_extendedprice")


@query(
    "csv_list_column", "A03 A04 B03 F08",
    """SELECT p_partkey, p_name, p_type AS second, 2 AS n_items, p_brand AS first FROM part""",
)
def csv_list_column(spark, sf):
    path = scratch_path(spark, "csv")
    text = F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    sinks.write_csv(
        table(spark, sf, "part").select("p_partkey", "p_name", text.alias("teams")), path
    )
    schema = T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
        T.StructField("teams", T.StringType()),
    ])
    return files.read_csv(spark, path, schema, ("teams",)).select(
        "p_partkey", "p_name", F.size("teams").alias("n_items"),
        F.col("teams")[0].alias("first"), F.col("teams")[1].alias("second"),
    )


@query(
    "page_cache", "A05 A06 B11",
    "SELECT page_id, url, md5(html) AS digest, length(html) AS size FROM pages",
)
def page_cache(spark, sf):
    path = scratch_path(spark, "pages")
    sinks.write_pages(table(spark, sf, "pages"), path)
    return files.read_parquet(spark, path).select(
        "page_id", "url", F.md5("html").alias("digest"), F.length("html").alias("size")
    )


_DRAW = "CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 12"


def _planted_failures(request):
    """The stored page, after failures planted by a digest of the url."""
    draw = int(hashlib.md5(request.url.encode()).hexdigest()[:8], 16) % 12
    if draw == 0:
        return fetch.Response(404, None)
    if draw == 1 or request.attempt <= draw - 8:
        raise TimeoutError("planted")
    return fetch.Response(200, request.cached)


@query(
    "page_fetch", "A05 A19",
    f"""SELECT url, CASE d WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END AS status,
      CASE WHEN d > 1 THEN md5(html) END AS digest, CASE WHEN d = 1 THEN 5 ELSE greatest(1, d - 7) END AS tries,
      CASE d WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'TimeoutError: planted' END AS error
    FROM (SELECT url, max(html) AS html, CAST({_DRAW} AS INTEGER) AS d FROM pages WHERE url IS NOT NULL GROUP BY url)""",
)
def page_fetch(spark, sf):
    """All urls fetched from the cached pages, with failures to retry."""
    urls = table(spark, sf, "pages").select("url", F.col("html").alias("cached"))
    got = fetch.fetch_pages(urls, _planted_failures, tries=5, wait=0.001)
    return got.select("url", F.coalesce("status", F.lit(0)).alias("status"),
                      F.md5("html").alias("digest"), "tries", "error")


@query(
    "delta_of_new_rows", "B02 C15 D05",
    """SELECT o_orderkey, o_orderstatus FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3)""",
)
def delta_of_new_rows(spark, sf):
    path = scratch_path(spark, "delta")
    seen = table(spark, sf, "lineitem").filter("l_linenumber >= 3").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    fresh = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(
        seen, "o_orderkey", "left_anti"
    )
    sinks.write_delta(fresh, path, "parquet")
    return files.read_parquet(spark, path)


@query(
    "missing_file_fallback", "A22 H01",
    SAILORS_WITH + " SELECT key, name, team, NULL::VARCHAR AS first_name FROM sailors",
)
def missing_file_fallback(spark, sf):
    old = files.read_or_empty(spark, scratch_path(spark, "absent"), schemas.SAILOR)
    new = domain.sailors(spark, sf).select("key", "name", "team")
    return old.unionByName(new, allowMissingColumns=True).select("key", "name", "team", "first_name")


@query(
    "document_merge", "B05 H02",
    """SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN c_name || '*' ELSE c_name END AS name,
      c_mktsegment AS segment FROM customer
    UNION ALL SELECT 10000000 + s_suppkey, s_name || '*', NULL FROM supplier""",
)
def document_merge(spark, sf):
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    changed = table(spark, sf, "customer").filter("c_acctbal > 5000").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("*")).alias("name")
    )
    added = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 10_000_000).alias("id"), F.concat("s_name", F.lit("*")).alias("name")
    )
    return sinks.merge_documents(stored, changed.unionByName(added), "id")


@query(
    "document_replace_by_slug", "B06 I03",
    """SELECT lower(replace(replace(n_name, ' ', '-'), '/', '-')) AS id,
      CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS version, n_name AS name FROM nation""",
)
def document_replace_by_slug(spark, sf):
    from windlass.functions.ids import slug

    docs = table(spark, sf, "nation").select(
        slug(F.col("n_name")).alias("id"), F.col("n_name").alias("name"), "n_regionkey"
    )
    stored = docs.select("id", "name", F.lit("old").alias("version"))
    batch = docs.filter("n_regionkey = 2").select("id", "name", F.lit("new").alias("version"))
    return upsert(stored, batch, ["id"])


@query(
    "array_union_append", "B09 I16",
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS xs FROM orders GROUP BY 1)
    SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(xs, []), [c_mktsegment]))), ',')
      AS tags FROM customer LEFT JOIN a ON c_custkey = o_custkey""",
)
def array_union_append(spark, sf):
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.collect_set("o_orderpriority").alias("tags")
    )
    batch = table(spark, sf, "customer").select("c_custkey", F.array("c_mktsegment").alias("tags"))
    return sinks.append_to_array(stored, batch, "c_custkey", "tags").select(
        "c_custkey", F.array_join(F.array_sort("tags"), ",").alias("tags")
    )


@query(
    "collection_truncate", "B10",
    "SELECT n_regionkey, count(*) AS before, 0::BIGINT AS after FROM nation GROUP BY 1",
)
def collection_truncate(spark, sf):
    path = scratch_path(spark, "collection")
    nation = table(spark, sf, "nation")
    nation.write.parquet(path)
    before = nation.groupBy("n_regionkey").agg(F.count("*").alias("before"))
    sinks.truncate(nation, path)
    after = spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("after"))
    return before.join(after, "n_regionkey", "left").select(
        "n_regionkey", "before", F.coalesce("after", F.lit(0)).alias("after")
    )


@query(
    "document_store", "B05 B06 H02",
    """SELECT 'c/' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN c_name || '*' ELSE c_name END AS name,
      CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer
    UNION ALL SELECT 's/' || s_suppkey, s_name, NULL FROM supplier""",
)
def document_store(spark, sf):
    """Three committed batches, one of them sent twice."""
    own = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "segment")])
    docs = DocumentStore(spark, scratch_path(spark, "documents"), own, "id", buckets=8)
    people = table(spark, sf, "customer").select(
        F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_acctbal", "c_custkey")
    docs.merge(people.select(*own.names), "customers")
    changed = people.filter("c_acctbal > 5000").select("id", F.concat("name", F.lit("*")).alias("name"))
    added = table(spark, sf, "supplier").select(
        F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    for _ in range(2):
        docs.merge(changed.unionByName(added), "changes")
    cleared = people.filter("c_custkey % 10 = 0").select("id", F.lit(None).cast("string").alias("segment"))
    docs.merge(cleared, "cleared")
    return docs.read()


@query(
    "document_tree_delete", "B10",
    """SELECT id FROM (SELECT r_name || '/' || n_name AS id, r_name AS top FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT r_name || '/' || n_name || '/' || c_custkey, r_name FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    WHERE NOT starts_with(id, 'ASIA/')""",
)
def document_tree_delete(spark, sf):
    """A region's documents and all below them, deleted by pages, with a stop in between."""
    own = T.StructType([T.StructField("id", T.StringType())])
    docs = DocumentStore(spark, scratch_path(spark, "tree"), own, "id", buckets=8)
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws("/", "r_name", "n_name")
    below = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    docs.merge(nation.select(path.alias("id")).unionByName(below.select(
        F.concat_ws("/", path, F.col("c_custkey").cast("string")).alias("id"))), "all")
    total = docs.read().count()
    docs.delete_tree("ASIA/", page=max(10, total // 8), max_pages=1)
    docs.delete_tree("ASIA/", page=max(10, total // 8))
    return docs.read()


@query(
    "limited_document_scan", "A20 G05",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def limited_document_scan(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(10)


@query(
    "static_region_table", "A21 D10 D15",
    SAILORS_WITH + """ SELECT key, team, region,
      CASE WHEN region = 'ASIA' THEN 'AMERICA' ELSE region END AS merged FROM sailors""",
)
def static_region_table(spark, sf):
    from windlass.operators.exposure import merge_regions

    people = domain.sailors(spark, sf).drop("region")
    regions = domain.team_regions(spark, sf)
    joined = people.join(regions, "team", "left").withColumn("merged", F.col("region"))
    return merge_regions(joined, domain.REGION_ALIAS, "merged").select(
        "key", "team", "region", "merged"
    )


@query(
    "stable_sample", "G09",
    """SELECT p_partkey, p_name FROM part
    WHERE CAST('0x' || substr(md5('42' || CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80""",
)
def stable_sample(spark, sf, fraction=0.8, seed=42):
    """A seeded 80% sample: by hash of the key, so a lost task redraws the same rows."""
    identity = F.concat(F.lit(str(seed)), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").filter(
        sinks.part_of(identity, F.lit(100)) < int(fraction * 100)
    ).select("p_partkey", "p_name")
