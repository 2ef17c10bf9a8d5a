"""Byte-level BPE encoding and decoding with a two-tier lookup.

Each match of the split pattern is encoded separately. A minimal perfect hash
over the vocabulary resolves matches that are whole tokens; other matches are
merged with a heap over linked bytes, lowest rank first, leftmost on a tie,
in O(n log n) for a match of n bytes.

Defined cases: a null text encodes like an empty one, to no ids; ids of null
decode to no bytes; a match of any length is one merge, in texts of any length;
repeated rows are encoded alike; an empty table gives no rows; other columns pass through, clashing names get `_` in front.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, held, query, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# The pattern's \s is the Unicode White_Space property.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (
    public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}")
    .replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
)
# Matches remembered by a task in each of two generations, and the longest that is.
CACHE_ENTRIES = 250_000
CACHE_LENGTH = 48
# The vocabulary travels to every task: a parameter of checked size.
MAX_VOCABULARY = 2_000_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _slot(h: int, displacement: int, n: int) -> int:
    return (h ^ displacement * 0x9E3779B97F4A7C15) % n


def minimal_perfect_hash(keys: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(displacement by bucket, key index by slot): n keys in n slots.

    Buckets are placed from the largest down, each with the first displacement
    that puts all its keys in free slots. A bucket of one key stores its slot
    as a negative displacement.
    """
    n = len(keys)
    hashes = [xxhash.xxh3_64_intdigest(k, seed) for k in keys]
    buckets: dict[int, list[int]] = {}
    count = max(1, n // 4)
    for i, h in enumerate(hashes):
        buckets.setdefault((h >> 32) % count, []).append(i)
    displacement = np.zeros(count, np.int64)
    owner = np.full(n, -1, np.int64)
    order = sorted(buckets, key=lambda b: -len(buckets[b]))
    free = iter(())
    for at, b in enumerate(order):
        own = buckets[b]
        if len(own) == 1:
            free = iter(np.flatnonzero(owner < 0).tolist())
            for single in order[at:]:
                slot = next(free)
                owner[slot] = buckets[single][0]
                displacement[single] = -slot - 1
            break
        d = 0
        while True:
            slots = {_slot(hashes[i], d, n) for i in own}
            if len(slots) == len(own) and all(owner[s] < 0 for s in slots):
                break
            d += 1
        for i in own:
            owner[_slot(hashes[i], d, n)] = i
        displacement[b] = d
    return displacement, owner


class Encoder:
    """Per-task encoder; `tokens` in rank order, empty where a rank is unused."""

    def __init__(self, tokens: list[bytes], displacement: np.ndarray, owner: np.ndarray,
                 pattern: str) -> None:
        self.tokens = tokens
        self.keys = [t for t in tokens if t]
        self.key_rank = [r for r, t in enumerate(tokens) if t]
        self.displacement = displacement.tolist()
        self.owner = owner.tolist()
        # Ranks of the pairs a merge makes.
        self.rank = {t: r for r, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int:
        """Rank of a piece that is a token, else -1."""
        h = xxhash.xxh3_64_intdigest(piece)
        d = self.displacement[(h >> 32) % len(self.displacement)]
        key = self.owner[-d - 1 if d < 0 else _slot(h, d, len(self.owner))]
        return self.key_rank[key] if self.keys[key] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        n = len(piece)
        rank = self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # (rank, left start, right end): stale once either part has changed.
        heap = []
        for i in range(n - 1):
            r = rank(piece[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        # after[i] is where part i ends; 0 once part i is merged away.
        while heap:
            _, i, stop = pop(heap)
            j = after[i]
            if not j or j >= n or after[j] != stop:
                continue
            after[j] = 0
            after[i] = stop
            if stop < n:
                before[stop] = i
                r = rank(piece[i:after[stop]])
                if r is not None:
                    push(heap, (r, i, after[stop]))
            p = before[i]
            if p >= 0:
                r = rank(piece[p:stop])
                if r is not None:
                    push(heap, (r, p, stop))
        return [self.rank[piece[i:after[i]]] for i in range(n) if after[i]]

    def piece_ids(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            piece = match.encode("utf-8")
            rank = self.whole(piece)
            ids = [rank] if rank >= 0 else self.merge(piece)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[match] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, other = self.cache.get, self.piece_ids
        return b"".join([get(m) or other(m) for m in self.split(text or "")])

    def decode(self, ids: bytes | None) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def _encoder(vocabulary: Vocabulary, pattern: str) -> Encoder:
    return held((vocabulary.id_, pattern), lambda: Encoder(*vocabulary.tables.value, pattern))


class Vocabulary:
    """The vocabulary's tables as a broadcast value."""

    def __init__(self, spark: SparkSession, path: str = RANKS) -> None:
        tokens = load_ranks(path)
        if len(tokens) > MAX_VOCABULARY:
            raise ValueError(f"more than {MAX_VOCABULARY} tokens")
        self.id_ = xxhash.xxh3_64_intdigest(b"\0".join(tokens))
        keys = [t for t in tokens if t]
        self.tables = spark.sparkContext.broadcast((tokens, *minimal_perfect_hash(keys)))


def encode_texts(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
    pattern: str = PATTERN,
) -> DataFrame:
    """Adds the ids of each whole text, packed as little-endian 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = _encoder(vocabulary, pattern)
        return pd.Series([own.encode(t) for t in texts], dtype=object)

    return df.withColumn(free_name(df, ids), encode(F.col(text).cast("string")))


def decode_ids(
    df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded",
) -> DataFrame:
    """Adds the bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def decode(packed: pd.Series) -> pd.Series:
        own = _encoder(vocabulary, PATTERN)
        return pd.Series([own.decode(p) for p in packed], dtype=object)

    return df.withColumn(free_name(df, decoded), decode(F.col(ids)))


def encode_and_decode(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
    decoded: str = "decoded", pattern: str = PATTERN,
) -> DataFrame:
    """Adds both in one call. (Of two chained calls Spark would run the first twice.)"""

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = _encoder(vocabulary, pattern)
        packed = [own.encode(t) for t in texts]
        return pd.DataFrame({"ids": packed, "decoded": [own.decode(p) for p in packed]})

    made = free_name(df, "coded")
    return df.withColumn(made, both(F.col(text).cast("string"))).select(
        *[F.col(c) for c in df.columns], F.col(f"{made}.ids").alias(free_name(df, ids)),
        F.col(f"{made}.decoded").alias(free_name(df, decoded)))


def digests(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document's text."""
    vocabulary = Vocabulary(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    done = encode_and_decode(kept, vocabulary, "_text", "_ids", "_bytes")
    return done.select(
        *keep, F.floor(F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"),
    )


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
