"""DuckDB forms of the queries that SQL can state."""

from __future__ import annotations

from windlass.llm import shingles

_SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def word_shingles(table: str, key: str, text: str, short: bool) -> str:
    """SELECT of the distinct (key, shingle); `short`: fewer words are one shingle."""
    width = shingles.WIDTH
    words = _SPLIT.format(text=f"coalesce({text}, '')")
    whole = f"""
      UNION ALL SELECT {key}, len(w) || ':' || array_to_string(w, ' ') FROM words
      WHERE len(w) BETWEEN 1 AND {width - 1}""" if short else ""
    return f"""SELECT DISTINCT {key}, g FROM (WITH words AS (SELECT {key}, {words} AS w FROM {table})
      SELECT {key}, unnest(list_transform(range(1, len(w) - {width - 2}),
        lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS g FROM words WHERE len(w) >= {width}{whole})"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  min(page_id) OVER (PARTITION BY body) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to,
  payload_digest AS declared_digest FROM h"""

# Items of fewer words than a shingle are runs of all their words: texts are
# cut into such runs too.
_RUNS = """SELECT DISTINCT doc_id, n || ':' || array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
      SELECT doc_id, %s AS w FROM documents), (SELECT DISTINCT len(%s) AS n FROM benchmark) WHERE n BETWEEN 1 AND %d)""" % (
    _SPLIT.format(text="lower(coalesce(text, ''))"), _SPLIT.format(text="coalesce(text, '')"), shingles.WIDTH - 1)

DECONTAMINATION = f"""
WITH d AS ({word_shingles("documents", "doc_id", "lower(text)", False)} UNION ALL {_RUNS}),
q AS ({word_shingles("benchmark", "item_id", "lower(text)", True)}),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, count(*) / any_value(n)::DOUBLE AS containment
FROM d JOIN q USING (g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n)"""

JACCARD = f"""
WITH RECURSIVE s AS MATERIALIZED ({word_shingles("documents", "doc_id", "text", True)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2
  HAVING count(*) >= 0.8 * (any_value(na.n) + any_value(nb.n) - count(*)) - 1e-6),
found(node, class_id) USING KEY (node) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT l.y, min(f.class_id) FROM found f JOIN links l ON f.node = l.x
    JOIN recurring.found r ON r.node = l.y WHERE f.class_id < r.class_id GROUP BY l.y)
SELECT doc_id, class_id, coalesce(c, 0) AS n_links FROM documents JOIN found ON node = doc_id
LEFT JOIN (SELECT x, count(*) AS c FROM links GROUP BY 1) ON x = doc_id"""

# Bytes as pairs of hexadecimal digits, so that strings can be cut anywhere.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1 AS late
  FROM (SELECT doc_id, unnest(range(0, len(b) // 2 - 99)) AS s,
    unnest(list_transform(range(0, len(b) // 2 - 99), lambda s: md5_number(substr(b, 2 * s + 1, 200)))) AS m FROM d)),
late AS (SELECT doc_id, s, s - coalesce(lag(s) OVER o, -1000) > 100 AS fresh FROM w WHERE late
  WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER
    (PARTITION BY doc_id ORDER BY s) AS run FROM late) GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail,
    string_agg(substr(b, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(b) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(b, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
uses AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  JOIN kept k USING (lang) LEFT JOIN uses USING (lang, source, term)),
p AS MATERIALIZED (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (total + 2)) //
  (sum(total) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
pairs AS (SELECT a.lang, a.source, b.source AS item, 'pair' AS part, coalesce(v, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b
    ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, term AS item, 'term' AS part, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, part, item, value FROM pairs UNION ALL BY NAME SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Lloyd rounds spelled out over components in long form."""
    nearest = f"""AS MATERIALIZED (SELECT r, p, min(d * {entries} + e) AS m FROM (
      SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM parts JOIN b{{k}} USING (p, i) GROUP BY ALL) GROUP BY ALL)"""
    steps = "".join(f""",
a{k + 1} {nearest.format(k=k)},
b{k + 1} AS MATERIALIZED (SELECT p, e, i, CASE WHEN c IS NULL THEN y ELSE (s - ((s % c) + c) % c) // c END AS y
  FROM b{k} LEFT JOIN (SELECT p, m % {entries} AS e, i, sum(x) AS s, count(*) AS c
    FROM parts JOIN a{k + 1} USING (r, p) GROUP BY ALL) USING (p, e, i))""" for k in range(rounds))
    return f"""
WITH base AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT r, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS i,
    CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, len(v) AS n, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM base)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, CAST(x AS HUGEINT) AS y FROM parts WHERE r <= {entries}){steps},
final {nearest.format(k=rounds)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(m % {entries} AS BIGINT)), '' ORDER BY p) AS code,
  CAST(sum(m // {entries}) AS BIGINT) AS error FROM final GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM base JOIN coded USING (r)"""
