"""Quality rules: word counts, repeated lines and windows, and repeated
substrings found in a suffix array.

Many texts are sorted together, each text's suffixes apart: prefix doubling
over ranks, in which only suffixes that are still equal to another are sorted
again. Ranks of every doubling give the common prefixes of neighbours. Each
suffix lies in a longest-common-prefix interval whose depth is the longest
substring it shares with another place of the text; the spans of those of at
least `min_repeat` bytes are united. A text is kept if the base rules pass, the
united spans cover at most `max_covered` of its bytes and no repeat is longer
than `max_repeat` bytes.

Defined cases: a null text counts as empty and fails (too few words); a text
of any length is sorted whole; overlapping repeats count; repeated rows are
judged alike; an empty table gives no rows; other columns pass through, clashing names get `_` in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, held, query, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_REPEAT = 50
MAX_COVERED = 0.4
MAX_REPEAT = 2_000
# Bytes of the texts that are sorted together; a longer text is sorted alone.
CHUNK_BYTES = 256 << 10
_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "covered_bytes": "long", "longest_repeat": "long",
    "base_failed": "boolean", "kept": "boolean",
}


def repeat_lengths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, text index) of every byte: the longest substring that starts
    there and also starts elsewhere in the same text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    if n == 0:
        return np.zeros(0, np.int64), owner
    ends = np.cumsum(sizes)[owner]
    # UTF-8 has no byte 255, so 0 marks the end of a text.
    raw = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
    key = np.zeros(n, np.uint64)
    left = ends - np.arange(n)
    for k in range(8):
        byte = np.zeros(n, np.uint64)
        byte[: max(n - k, 0)] = raw[k:]
        byte[left <= k] = 0
        key |= byte << np.uint64(8 * (7 - k))
    order = np.argsort(key)
    first = np.empty(n, np.int64)
    first[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
    pair = owner * n + first
    suffixes = np.argsort(pair)
    ranked = pair[suffixes]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[suffixes] = heads
    narrow = np.int32 if n < 1 << 31 else np.int64
    levels = [(8, rank.astype(narrow))]
    # Slots of the suffix array whose suffix equals a neighbour so far.
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    step = 8
    while len(tied):
        at = suffixes[tied]
        further = at + step
        inside = further < ends[at]
        second = np.zeros(len(at), np.int64)
        second[inside] = rank[further[inside]] + 1
        both = rank[at] * (n + 1) + second
        sort = np.argsort(both)
        at, both = at[sort], both[sort]
        suffixes[tied] = at
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2
        levels.append((step, rank.astype(narrow)))
        tied = tied[~(new & np.append(new[1:], True))]
    # Common prefixes of neighbours that share their first 8 bytes.
    base = levels[0][1]
    low, high = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(base[low] == base[high])
    i, j = low[near].copy(), high[near].copy()
    start = i.copy()
    for step, ranks in reversed(levels):
        inside = (i < n) & (j < n)
        a, b = np.minimum(i, n - 1), np.minimum(j, n - 1)
        same = inside & (ranks[a] == ranks[b]) & (owner[a] == owner[start]) & (
            owner[b] == owner[start])
        i += np.where(same, step, 0)
        j += np.where(same, step, 0)
    # Less than 8 bytes are left, or either has reached the end of the text.
    a, b = np.minimum(i, n - 1), np.minimum(j, n - 1)
    rest = key[a] ^ key[b]
    more = np.zeros(len(a), np.int64)
    for k in range(1, 8):
        more += (rest >> np.uint64(8 * (8 - k))) == 0
    length = i - start + more
    end = ends[start]
    length = np.minimum(length, end - np.maximum(low[near], high[near]))
    out = np.zeros(n, np.int64)
    np.maximum.at(out, low[near], length)
    np.maximum.at(out, high[near], length)
    return out, owner


def repeated_spans(texts: list[bytes], min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered bytes, longest repeat) of each text."""
    length, owner = repeat_lengths(texts)
    count = len(texts)
    hit = np.flatnonzero(length >= min_repeat)
    change = np.zeros(len(length) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + length[hit], -1)
    covered = np.cumsum(change[:-1]) > 0
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, owner, length)
    return np.bincount(owner[covered], minlength=count), longest


def repeat_words(words: list[list[str]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in the text."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    if n == 0:
        return np.zeros(len(words), np.int64)
    hashes = np.fromiter((hash(w) for own in words for w in own), np.int64, n).view(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.flatnonzero(np.cumsum(sizes)[owner] - np.arange(n) >= window)
    mixed = owner[starts].astype(np.uint64)
    for k in range(window):
        mixed = (mixed + hashes[starts + k]) * _BASE
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = starts[twice]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=len(words))


def _line_count(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk: list[str] = []
    size = 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def measure(
    texts: list[str], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> pd.DataFrame:
    """All measures and the verdict of some texts."""
    words = [_WORDS(t) for t in texts]
    data = [t.encode("utf-8") for t in texts]
    covered, longest = repeated_spans(data, min_repeat)
    n_bytes = np.array([len(d) for d in data], np.int64)
    n_words = np.array([len(w) for w in words], np.int64)
    repeated = repeat_words(words)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    return pd.DataFrame({
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, _BLANKS)) for t in texts],
        "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [_line_count(t) for t in texts],
        "n_repeat_words": repeated, "covered_bytes": covered, "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & (covered <= max_covered * n_bytes) & (longest <= max_repeat),
    })


def quality_rules(
    df: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Adds the measures of each whole text and whether it is kept."""

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
    def judge(texts: pd.Series) -> pd.DataFrame:
        held("quality rules")
        parts = [measure(chunk, min_repeat, max_covered, max_repeat)
                 for chunk in _chunks([t or "" for t in texts])]
        return pd.concat(parts, ignore_index=True) if parts else measure([])

    found = free_name(df, "measured")
    measured = df.withColumn(found, judge(F.col(text).cast("string")))
    fields = [F.col(f"{found}.{c}").alias(free_name(df, c)) for c in COLUMNS]
    return measured.select(*[F.col(c) for c in df.columns], *fields)


@query("op9_repetition_rules")
def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")
