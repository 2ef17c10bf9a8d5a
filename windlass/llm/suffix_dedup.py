"""Exact removal of repeated byte strings, by suffix arrays of what can repeat.

A byte goes if it lies in a string of `length` bytes that also starts earlier,
in a smaller document or further up in the same one. To find such strings
without bringing the corpus together:

* every string of `length` bytes has an anchor, the least hash of the `GRAM`
  byte strings in it; consecutive strings with the same anchor form a context.
  Equal strings have equal anchors at equal places, so only contexts with the
  same anchor have to meet. Contexts and anchors go out packed, sorted and
  without those that their own batch already has.
* Of equal contexts all but the first go. Anchors with several different
  contexts remain: these are cut to what another one can share, again without
  equals, and suffix arrays of the rest (`suffix_grouping`) give the runs of
  suffixes with a common prefix of `length` bytes, whose first alone stays.
* An anchor with more than `HOT_CONTEXTS` contexts, as estimated from a
  sample, is not met as a whole: its strings go out one by one under their
  own hash. The sample decides only that; both ways give the same strings.

Contexts count as equal if two 64-bit hashes are, one over the anchor's gram and
one over all bytes (for single strings: one over all bytes and one over grams
that cover them). Bytes are looked at where suffix arrays decide.

Documents are ordered by id (null last), then by input position.

Defined cases: a null text is empty; texts shorter than `length` keep all their
bytes, those of any length are cut whole; repeated rows are documents of their own, later ones lose what they
share; an empty table gives no rows; other columns stay, clashing names get
`_` in front.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import sql
from windlass.llm.common import free_name, held, materialise, materialise_by, query, table
from windlass.llm.suffix_grouping import suffix_array

LENGTH = 100
GRAM = 24
# Text bytes whose contexts one task meets on average.
BUCKET_BYTES = 12 << 20
# Packed anchors and contexts leave a task after so many bytes of text.
FLUSH_BYTES = 4 << 20
# Bytes sorted at once; a larger group of contexts is sorted alone.
SORT_BYTES = 64 << 10
# More buckets than this are reached in two steps, over so many routes.
ROUTES = 4096
# Packed contexts of a route that are parted again at once.
ROUTE_BYTES = 64 << 20
HOT_CONTEXTS = 200_000
SAMPLE = 0.01
# Text bytes in one bucket of the staged documents, while they are as few as
# this; Spark refuses more than 100,000.
FILE_BYTES = 64 << 20
MOST_FILES = 50_000

_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 23
_FACTORS = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
    0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_NO_ID = np.iinfo(np.int64).max

ANCHOR = np.dtype([
    ("anchor", "<u8"), ("content", "<u8"), ("id", "<i8"), ("uid", "<i8"),
    ("start", "<i4"), ("strings", "<i2"), ("offset", "<i2")])
CONTEXT = np.dtype([
    ("anchor", "<u8"), ("id", "<i8"), ("start", "<i4"), ("strings", "<i2"), ("offset", "<i2")])
SPAN = np.dtype([("start", "<i4"), ("strings", "<i4")])
SENT = "kind int, bucket long, uid long, data binary"


# ---- strings, anchors, contexts of one document ----

def _hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Hash of every string of each width (ascending)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]
    h ^= h >> np.uint64(31)
    size, level, out = 1, 1, []
    for width in widths:
        while size * 2 <= width:
            h = h[:-size] * _FACTORS[level % 7] + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
            level += 1
        rest = width - size
        own = h if not rest else h[:-rest] * _FACTORS[(level + 2) % 7] + h[rest:]
        own = (own ^ (own >> np.uint64(32))) * _FACTORS[5]
        out.append(own ^ (own >> np.uint64(29)))
    return out


def _least(values: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while size * 2 <= window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = window - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def contexts_of(
    data: np.ndarray, length: int = LENGTH, gram: int = GRAM,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts as ANCHOR rows without id and uid, string hashes)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, ANCHOR), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, strings = _hashes(data, gram, length)
    parts = []
    for low in range(0, n, _PIECE):
        high = min(n, low + _PIECE)
        own = grams[low:high + length - gram]
        packed = (own & ~_POSITION) | np.arange(len(own), dtype=np.uint64)
        at = (_least(packed, length - gram + 1) & _POSITION).astype(np.int64) + low
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        stop = np.append(start[1:], high - low)
        part = np.zeros(len(start), ANCHOR)
        part["anchor"] = grams[at[start]]
        part["start"], part["strings"] = start + low, stop - start
        part["offset"] = at[start] - start - low
        parts.append(part)
    out = np.concatenate(parts)
    # The first and the last string overlap and cover the whole context.
    first, last = out["start"], out["start"] + out["strings"] - 1
    mixed = strings[first] * _FACTORS[1] + strings[last]
    mixed ^= mixed >> np.uint64(31)
    mixed = (mixed + out["strings"].astype(np.uint64) * np.uint64(1009)
             + out["offset"].astype(np.uint64)) * _FACTORS[6]
    out["content"] = mixed ^ (mixed >> np.uint64(30))
    return out, strings, grams


def _split_hot(
    own: np.ndarray, strings: np.ndarray, grams: np.ndarray, hot: np.ndarray, length: int,
    gram: int,
) -> np.ndarray:
    """Contexts of hot anchors become one context for each of their strings, met
    under its own hash and told apart by the hashes of the grams that cover it."""
    if not len(hot):
        return own
    is_hot = np.isin(own["anchor"], hot)
    wide = own[is_hot]
    single = np.repeat(wide, wide["strings"])
    if not len(single):
        return own
    inner = np.arange(len(single)) - np.repeat(
        np.cumsum(wide["strings"], dtype=np.int64) - wide["strings"], wide["strings"])
    single["start"] += inner.astype(np.int32)
    single["offset"] -= inner.astype(np.int16)
    single["strings"] = 1
    value = strings[single["start"]]
    covering = np.zeros(len(single), np.uint64)
    for at in {*range(0, length - gram, gram), length - gram}:
        covering = (covering + grams[single["start"] + at]) * _FACTORS[4]
        covering ^= covering >> np.uint64(32)
    single["content"] = covering
    single["anchor"] = (value ^ np.uint64(0xA5A5A5A5)) * _FACTORS[3]
    return np.concatenate((own[~is_hot], single))


def _in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by (anchor, content, document, start), and which begin a content."""
    rows = rows[np.lexsort((rows["start"], rows["uid"], rows["id"], rows["content"],
                            rows["anchor"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (
        rows["content"][1:] != rows["content"][:-1])
    return rows, first


def _span_rows(uid: np.ndarray, start: np.ndarray, strings: np.ndarray) -> list[tuple]:
    """(uid, packed spans) for each document."""
    order = np.argsort(uid, kind="stable")
    uid = uid[order]
    spans = np.zeros(len(uid), SPAN)
    spans["start"], spans["strings"] = start[order], strings[order]
    cuts = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1]))) if len(uid) else []
    return [(int(uid[a]), spans[a:b].tobytes())
            for a, b in zip(cuts, [*cuts[1:], len(uid)])]


# ---- tasks ----

def _by_bucket(rows: np.ndarray, buckets: int, per_route: int = 1) -> list[tuple]:
    """Packed rows (1, bucket, -1, contexts) of contexts in any order; the cost
    does not depend on the number of buckets."""
    bucket = (rows["anchor"] >> np.uint64(20)) % np.uint64(buckets) // np.uint64(per_route)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(rows) else []
    return [(1, int(bucket[a]), -1, rows[a:z].tobytes())
            for a, z in zip(at, [*at[1:], len(rows)])]


def _route(buckets: int) -> Callable:
    """Contexts of a route to those of its buckets; spans pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            rows = _by_bucket(np.frombuffer(b"".join(held), ANCHOR), buckets)
            held.clear()
            return pd.DataFrame(rows, columns=["kind", "bucket", "uid", "data"])

        for batch in batches:
            yield batch[batch["kind"] == 0]
            for data in batch.loc[batch["kind"] == 1, "data"]:
                held.append(data)
                size += len(data)
                if size >= ROUTE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _send(buckets: int, hot: np.ndarray, length: int, gram: int, per_route: int = 1) -> Callable:
    """(uid, id, text) rows to packed contexts by bucket or route (kind 1) and
    spans of strings that their own batch has earlier (kind 0)."""

    def flush(parts: list[np.ndarray]) -> pd.DataFrame:
        rows, first = _in_order(np.concatenate(parts))
        late = rows[~first]
        out = [(0, uid % buckets, uid, data)
               for uid, data in _span_rows(late["uid"], late["start"], late["strings"])]
        out += _by_bucket(rows[first], buckets, per_route)
        return pd.DataFrame(out, columns=["kind", "bucket", "uid", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("contexts")
        parts, size = [], 0
        for batch in batches:
            for uid, doc, text in zip(batch["uid"], batch["id"], batch["text"]):
                data = np.frombuffer(text.encode("utf-8"), np.uint8)
                own, strings, grams = contexts_of(data, length, gram)
                if not len(own):
                    continue
                own = _split_hot(own, strings, grams, hot, length, gram)
                own["uid"], own["id"] = uid, doc
                parts.append(own)
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """All contexts of some anchors: spans of the later of equal contexts (kind
    0), and the first contexts of anchors that have several (kind 1)."""
    spans = group[group["kind"] == 0]
    out = list(zip(spans["kind"], spans["uid"], spans["data"]))
    packed = group.loc[group["kind"] == 1, "data"]
    if len(packed):
        rows, first = _in_order(np.frombuffer(b"".join(packed), ANCHOR))
        late = rows[~first]
        out += [(0, *r) for r in _span_rows(late["uid"], late["start"], late["strings"])]
        rows = rows[first]
        same = rows["anchor"][1:] == rows["anchor"][:-1]
        several = np.append(same, False) | np.concatenate(([False], same))
        rows = rows[several]
        rows = rows[np.argsort(rows["uid"], kind="stable")]
        kept = np.zeros(len(rows), CONTEXT)
        for name in CONTEXT.names:
            kept[name] = rows[name]
        uid = rows["uid"]
        cuts = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1]))) if len(uid) else []
        out += [(1, int(uid[a]), kept[a:b].tobytes())
                for a, b in zip(cuts, [*cuts[1:], len(uid)])]
    return pd.DataFrame(out, columns=["kind", "uid", "data"])


def _fetch(buckets: int, length: int) -> Callable:
    """Cut the bytes of a document's contexts out of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, text, packed in zip(batch["uid"], batch["text"], batch["contexts"]):
                data = text.encode("utf-8")
                for c in np.frombuffer(b"".join(packed), CONTEXT).tolist():
                    anchor, doc, start, strings, offset = c
                    out.append((
                        (anchor >> 20) % buckets, anchor - (1 << 63), doc, uid, start, offset,
                        data[start:start + strings - 1 + length]))
            yield pd.DataFrame(out, columns=FETCHED)

    return run


FETCHED = ["bucket", "anchor", "id", "uid", "start", "offset", "bytes"]
FETCHED_SCHEMA = "bucket long, anchor long, id long, uid long, start int, offset int, bytes binary"


def _longest_shared(group: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Longest common prefix of each text with another of its group."""
    width = max(map(len, texts))
    table_ = np.zeros((len(texts), width + 4), np.uint8)
    for k in range(4):  # the group in front, in digits without zero
        table_[:, k] = (group // 250 ** (3 - k)) % 250 + 1
    for i, t in enumerate(texts):
        table_[i, 4:4 + len(t)] = np.frombuffer(t, np.uint8)
    table_[:, 4:] += (np.arange(width)[None, :] < np.array([len(t) for t in texts])[:, None])
    order = np.argsort(np.ascontiguousarray(table_).view(f"S{width + 4}").ravel(), kind="stable")
    ranked = table_[order]
    differ = (ranked[1:] != ranked[:-1]) | (ranked[1:] == 0)
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 4) - 4
    common = np.maximum(common, 0)
    out = np.zeros(len(texts), np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def _resolve(length: int) -> Callable:
    """Spans of the strings of some anchors' contexts that start earlier."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "uid", "start"], kind="stable")
        anchors = np.unique(group["anchor"].to_numpy(), return_inverse=True)[1]
        # (group, place of the anchor in the bytes, bytes, uid, start)
        live = list(zip(anchors.tolist(), group["offset"], map(bytes, group["bytes"]),
                        group["uid"], group["start"]))
        found: list[tuple[int, int, int]] = []
        while len(live) > 1:
            own = np.array([c[0] for c in live])
            left = _longest_shared(own, [c[2][:c[1]][::-1] for c in live])
            right = _longest_shared(own, [c[2][c[1]:] for c in live])
            seen: set = set()
            kept = []
            for (g, at, data, uid, start), a, b in zip(live, left.tolist(), right.tolist()):
                if a + b < length:
                    continue
                cut = data[at - a:at + b]
                if (g, a, cut) in seen:
                    found.append((uid, start + at - a, a + b - length + 1))
                else:
                    seen.add((g, a, cut))
                    kept.append((g, a, cut, uid, start + at - a))
            shrunk = len(kept) < len(live) or any(
                len(x[2]) < len(y[2]) for x, y in zip(kept, live))
            live = kept
            if not shrunk:
                break
        live = sorted(live, key=lambda c: c[0]) if len(live) > 1 else []
        at = 0
        while at < len(live):
            stop, size = at, 0
            while stop < len(live) and (size < SORT_BYTES or live[stop][0] == live[stop - 1][0]):
                size += len(live[stop][2])
                stop += 1
            found += repeated_strings([c[1:] for c in live[at:stop]], length)
            at = stop
        if not found:
            return pd.DataFrame({"kind": [], "uid": [], "data": []}).astype(
                {"kind": "int32", "uid": "int64"})
        uid, start, strings = (np.array(x) for x in zip(*found))
        rows = _span_rows(uid, start, strings)
        return pd.DataFrame([(0, *r) for r in rows], columns=["kind", "uid", "data"])

    return run


def repeated_strings(
    pieces: list[tuple[int, bytes, int, int]], length: int,
) -> list[tuple[int, int, int]]:
    """(uid, start, 1) of each string of `length` bytes in the pieces (offset,
    bytes, uid, start), given in document order within their anchor, that
    another piece, or the same one, has earlier."""
    joined = bytearray()
    uid, start, order = [], [], []
    for k, (_, data, doc, first) in enumerate(pieces):
        n = len(data) - length + 1
        uid.append(np.full(len(data) + 1, doc))
        order.append(np.full(len(data) + 1, k))
        own = np.arange(len(data) + 1) + first
        own[n:] = -1
        start.append(own)
        # Zero ends a piece; UTF-8 has no byte 255.
        joined += bytes(map((1).__add__, data)) + b"\0"
    uid, start, order = map(np.concatenate, (uid, start, order))
    array = np.array(suffix_array(joined), np.int64)
    padded = np.frombuffer(bytes(joined) + bytes(length + 8), np.uint8).astype(np.uint64)
    word = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        word |= padded[k:len(padded) - 8 + k] << np.uint64(8 * k)
    low, high = array[:-1], array[1:]
    equal = np.ones(len(low), bool)
    if length >= 8:
        for k in {*range(0, length - 7, 8), length - 8}:
            equal &= word[low + k] == word[high + k]
    else:
        for k in range(length):
            equal &= padded[low + k] == padded[high + k]
    run = np.concatenate(([0], np.cumsum(~equal)))
    valid = start[array] >= 0
    array, run = array[valid], run[valid]
    array = array[np.lexsort((start[array], order[array], run))]
    run = np.sort(run)
    late = array[1:][run[1:] == run[:-1]]
    return list(zip(uid[late].tolist(), start[late].tolist(), [1] * len(late)))


def merged_spans(packed: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) that the strings of some spans cover."""
    if packed is None or not len(packed):
        return []
    spans = np.sort(np.frombuffer(b"".join(packed), SPAN), order="start")
    start = spans["start"].astype(np.int64)
    end = np.maximum.accumulate(start + spans["strings"] - 1 + length)
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return list(zip(start[fresh].tolist(), end[last].tolist()))


# ---- the operator ----

def _hot_anchors(source: DataFrame, length: int, gram: int, hot_contexts: int) -> np.ndarray:
    """Anchors with more than so many contexts, as a sample of the rows says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                own, *_ = contexts_of(np.frombuffer(text.encode("utf-8"), np.uint8), length, gram)
                yield pd.DataFrame({"anchor": own["anchor"].view(np.int64),
                                    "content": own["content"].view(np.int64)})

    seen = source.sample(SAMPLE, 7).select("text").mapInPandas(run, "anchor long, content long")
    many = (
        seen.distinct().groupBy("anchor").agg(F.count("*").alias("n"))
        .filter(F.col("n") > hot_contexts * SAMPLE).select("anchor"))
    return np.array([r[0] for r in many.collect()], np.int64).view(np.uint64)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT_CONTEXTS,
    routes: int = ROUTES,
) -> DataFrame:
    """All rows with `kept` (the remaining bytes), n_bytes and the removed
    `spans` (start, end)."""
    names = {n: free_name(docs, n) for n in (
        "uid", "kept", "n_bytes", "spans", "cut", "span_uid", "all_spans")}
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    tasks = 2 * spark.sparkContext.defaultParallelism
    buckets = max(tasks, -(-total // bucket_bytes))
    # Texts meet their contexts and their spans later: both joins are on the uid.
    files = min(MOST_FILES, max(tasks, -(-total // FILE_BYTES)))
    staged = materialise_by(
        docs.withColumn(names["uid"], F.monotonically_increasing_id()), "dedup-texts",
        names["uid"], files)
    source = staged.select(
        F.col(names["uid"]).alias("uid"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = _all_spans(source, buckets, files, length, gram, hot_contexts, routes)
    per_doc = spans.repartition(files, "uid").groupBy("uid").agg(
        F.collect_list("data").alias(names["all_spans"]))
    joined = staged.join(
        per_doc.withColumnRenamed("uid", names["span_uid"]),
        F.col(names["uid"]) == F.col(names["span_uid"]), "left")

    @F.pandas_udf("kept binary, n_bytes long, spans array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, packed: pd.Series) -> pd.DataFrame:
        out = []
        for t, p in zip(texts, packed):
            data = (t or "").encode("utf-8")
            runs = merged_spans(p, length)
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((kept, len(data), [{"start": a, "end": b} for a, b in runs]))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "spans"])

    done = joined.withColumn(names["cut"], cut(
        F.col(text).cast("string"), F.col(names["all_spans"])))
    return done.select(
        *[F.col(c) for c in docs.columns],
        *[F.col(f"{names['cut']}.{c}").alias(names[c]) for c in ("kept", "n_bytes", "spans")])


def whole_characters(kept: Column) -> Column:
    """The text of remaining bytes, without pieces of characters cut in two."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: b.decode("utf-8", "ignore"))

    return decode(kept)


def _all_spans(
    source: DataFrame, buckets: int, files: int, length: int, gram: int, hot_contexts: int,
    routes: int,
) -> DataFrame:
    """(uid, data): packed spans of the strings that start earlier."""
    hot = _hot_anchors(source, length, gram, hot_contexts)
    per_route = -(-buckets // routes)
    sent = source.mapInPandas(_send(buckets, hot, length, gram, per_route), SENT)
    if per_route > 1:
        sent = sent.repartition(routes, "bucket").mapInPandas(_route(buckets), SENT)
    met = materialise(
        sent.groupBy("bucket").applyInPandas(_meet, "kind int, uid long, data binary"),
        "dedup-met")
    contexts = met.filter("kind = 1").repartition(files, "uid").groupBy("uid").agg(F.collect_list("data").alias("contexts"))
    fetched = source.join(contexts, "uid").select("uid", "text", "contexts").mapInPandas(
        _fetch(buckets, length), FETCHED_SCHEMA)
    resolved = fetched.groupBy("bucket").applyInPandas(
        _resolve(length), "kind int, uid long, data binary")
    return met.filter("kind = 0").unionByName(resolved).select("uid", "data")


@query("op7_suffix_dedup", sql.SUFFIX_DEDUP)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        .alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
