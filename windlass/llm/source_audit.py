"""Divergence of sources from each other and of their terms from the language,
by a frequent-pattern tree of term rows.

A term's row lists the sources that use it with their counts, in source order.
Equal rows are one row with a multiplicity; rows are dealt out in row order, so
that a task inserts neighbours into its part of the tree and only ever holds
the path it is on. The divergence of two sources is a sum over all kept terms:
first as if neither used any (one number for a pair), then corrected for the
terms of one alone (a histogram of its shares), then for terms of both, which
is what the tree counts: a node with its multiplicity and an ancestor settle
one pair of sources for all terms that pass through the node.

All sums are whole numbers and exact. A task holds at most `FLUSH_TERMS` terms
while counting, and one path, of the length of a language's number of sources,
in the tree.

Defined cases: null text, lang and source are ''; a text without terms still
makes its group occur; every row is a document, repeated rows and ids too;
texts of any length are counted whole, piece by piece; ties of value rank by
UTF-8; a language without kept terms has pairs of value 0 and no terms; an
empty table gives no rows. The result has columns of its own, so names of other
columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windlass.llm import sql
from windlass.llm.common import materialise, query, table, text_or_empty

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
FLUSH_TERMS = 200_000
FLUSH_PAIRS = 1_000_000
PIECE = 1 << 20
PARTS = 64

# ASCII letters in lower case and all bytes of other characters; the rest parts terms.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()),
                     ("n", pa.int64()), ("docs", pa.int64())])
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()),
                    ("value", pa.int64())])


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about `size` bytes."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size) if at + size < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            terms = list(uses)
            yield pa.record_batch(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)),
                 pa.array(terms, pa.binary()), pa.array(list(uses.values()), pa.int64()),
                 pa.array([docs[t] for t in terms], pa.int64())], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in pieces(text):
                uses.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(uses) for uses, _ in held.values()) > FLUSH_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text)."""
    read = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    raw = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return (
        raw.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), null without terms."""
    wide = "cast({} as decimal(20, 0))"
    return F.expr(
        f"case when {terms} > 0 then 1 + ({wide.format(n)} + 2) * {SCALE} div "
        f"({wide.format(total)} + 2 * {wide.format(terms)}) end")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PatternTree:
    """The open path of the tree; closed nodes settle with their ancestors."""

    def __init__(self) -> None:
        self.path = np.zeros((4, 0), np.int64)  # source, count, share, share of count 0
        self.times = np.zeros(0, np.int64)
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def insert(self, row: np.ndarray, times: int) -> None:
        size = min(self.path.shape[1], row.shape[1])
        differs = (self.path[:2, :size] != row[:2, :size]).any(axis=0)
        shared = int(differs.argmax()) if differs.any() else size
        self.close(shared)
        self.times = np.concatenate(
            [self.times[:shared] + times, np.full(row.shape[1] - shared, times, np.int64)])
        self.path = row

    def close(self, depth: int) -> None:
        """Nodes at `depth` and below have all their rows: correct their pairs."""
        width = self.path.shape[1]
        source, _, p, zero = self.path
        step = max(1, FLUSH_PAIRS // max(width, 1))
        for first in range(max(depth, 1), width, step):
            node = np.arange(first, min(width, first + step))[:, None]
            row, ancestor = np.nonzero(np.arange(width)[None, :] < node)
            node = node[row, 0]
            a, a0, b, b0 = p[node], zero[node], p[ancestor], zero[ancestor]
            both = gaps(a, b) - gaps(a, b0) - gaps(a0, b) + gaps(a0, b0)
            self.keys.append(source[node] << 32 | source[ancestor])
            self.values.append(both * self.times[node])
            self.held += len(node)
            if self.held > FLUSH_PAIRS:
                self._sum()
        self.path, self.times = self.path[:, :depth], self.times[:depth]

    def _sum(self) -> None:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.values = [keys[first]], [np.add.reduceat(values, first)]
        self.held = 0  # pairs of sources, at most as many as the result has

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.close(0)
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._sum()
        keys, values = self.keys.pop(), self.values.pop()
        return keys, values


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, row, times) in order to corrections of pairs of sources."""
    tree, lang, names, codes = PatternTree(), None, [], {}

    def settled() -> pa.RecordBatch:
        keys, values = tree.take()
        return pa.record_batch(
            [pa.array([lang] * len(keys), pa.string()),
             pa.array([names[k] for k in keys >> 32], pa.string()),
             pa.array([names[k] for k in keys & 0xFFFFFFFF], pa.string()),
             pa.array(values, pa.int64())], schema=_PAIRS)

    for batch in batches:
        rows = batch.column(1)
        cells = rows.flatten()
        words = cells.field(0).dictionary_encode()
        for name in words.dictionary.to_pylist():
            if name not in codes:
                codes[name] = len(names)
                names.append(name)
        own = np.array([codes[n] for n in words.dictionary.to_pylist()], np.int64)
        flat = np.stack([own[words.indices.to_numpy()] if len(own) else np.zeros(0, np.int64),
                         *(cells.field(k).to_numpy() for k in (1, 2, 3))])
        ends = np.cumsum(rows.value_lengths().to_numpy())
        starts = ends - rows.value_lengths().to_numpy()
        for its, a, z, times in zip(
                batch.column(0).to_pylist(), starts, ends, batch.column(2).to_pylist()):
            if its != lang:
                if lang is not None:
                    yield settled()
                lang = its
            tree.insert(flat[:, a:z], times)
    if lang is not None:
        yield settled()


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` is the divergence from each
    other source of the language, `term` the `top` terms that the source uses
    more than its language."""
    own = docs.select(
        text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"),
        text_or_empty(text).alias("text"))
    kept = materialise(
        term_counts(own).groupBy("lang", "term").agg(
            F.sum("n").alias("total"), F.sum("docs").alias("docs"),
            F.collect_list(F.struct("source", "n")).alias("uses"))
        .filter(F.col("docs") >= min_docs).drop("docs"), "audit-terms")
    uses = kept.select("lang", "term", "total", F.inline("uses"))
    langs = kept.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("total").alias("lang_uses"))
    groups = materialise(
        own.select("lang", "source").distinct()
        .join(uses.groupBy("lang", "source").agg(F.sum("n").alias("uses")),
              ["lang", "source"], "left")
        .join(langs, "lang", "left").na.fill(0, ["uses", "terms", "lang_uses"])
        .withColumn("zero", share("0", "uses", "terms")), "audit-groups")
    cells = materialise(
        uses.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "zero", share("n", "uses", "terms").alias("p"),
            share("total", "lang_uses", "terms").alias("q")), "audit-cells")

    terms = cells.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        gap(F.col("p"), F.col("q")).alias("value"))
    terms = _ranked(terms).filter(F.col("rank") <= top)

    summed = _absent(groups).unionByName(_alone(cells, groups)).unionByName(_shared(cells))
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs.withColumn("part", F.lit("pair"))).unionByName(terms).select(
        "lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _others(groups: DataFrame) -> DataFrame:
    """Per language, its sources with their share of count 0."""
    return groups.groupBy("lang").agg(
        F.collect_list(F.struct(F.col("source").alias("item"), F.col("zero").alias("theirs")))
        .alias("others"))


def _absent(groups: DataFrame) -> DataFrame:
    """Every ordered pair as if no kept term occurred in either."""
    pairs = groups.join(_others(groups), "lang").select(
        "lang", "source", "terms", "zero", F.inline("others")).filter("source <> item")
    value = F.col("terms") * F.coalesce(gap(F.col("zero"), F.col("theirs")), F.lit(0))
    return pairs.select("lang", "source", "item", value.cast("long").alias("value"))


def _alone(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """What a source's own terms change against a source that has none of them."""
    shares = (
        cells.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times"))
        .groupBy("lang", "source", "zero", F.pmod("p", F.lit(PARTS)).alias("part"))
        .agg(F.collect_list(F.struct("p", "times")).alias("shares")))
    changed = F.transform("others", lambda o: F.struct(
        o["item"].alias("item"),
        F.aggregate("shares", F.lit(0).cast("long"), lambda held, s: held + s["times"] * (
            gap(s["p"], o["theirs"]) - gap(F.col("zero"), o["theirs"]))).alias("value")))
    one = (
        shares.join(_others(groups), "lang").select("lang", "source", F.inline(changed))
        .filter("source <> item"))
    return _both_ways(one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def _shared(cells: DataFrame) -> DataFrame:
    """What terms of both sources change, from the tree."""
    row = F.array_sort(F.collect_list(F.struct("source", "n", "p", "zero")))
    patterns = (
        cells.groupBy("lang", "term").agg(row.alias("row")).filter(F.size("row") > 1)
        .groupBy("lang", "row").agg(F.count("*").alias("times")))
    dealt = patterns.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    return _both_ways(dealt.mapInArrow(_grow, "lang string, source string, item string, value long"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


@query("op13_source_divergence", sql.SOURCE_DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
