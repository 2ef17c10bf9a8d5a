"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What speaks for either are shares of kinds of
characters, sizes, repeated words and repeated lines, of the line and of the
lines before and after it; an arc weight for each pair of labels ties a line to
the next. Forward-backward gives each line's chance of being good, and the
means of these chances, weighted by the lines' characters, are the document's
evidence; a logistic curve fitted on the training rows turns it into the chance
of label 1.

Only the training fold teaches: labelled rows whose crc32(doc_id) mod 4 is not
2, at most about `TRAIN_ROWS` of them, chosen by a hash; every line of such a
row has the row's label. Each step of the fit (L-BFGS) sums gradients of all
rows in Spark tasks and sends one row per task. Scores see the text and nothing
else.

Blank lines are no lines. A line of more than `LINE_BYTES` bytes is read as
several, and a text of more than `RUN_LINES` lines as several chains, so memory
is bounded and whole texts count.

Defined cases: null, empty and blank texts have no lines and get the share of
label 1 among the training rows; repeated label rows count once, the larger
label wins; null labels do not teach; without labels of both kinds every score
is that share (0.5 without any); repeated rows score alike; an empty table
gives no rows; other columns pass through, clashing names get `_` in front.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, materialise, query, table

TRAIN_ROWS = 8_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
LINE_BYTES = 1 << 16
RUN_LINES = 1 << 16
SLICE_BYTES = 1 << 20
RIDGE = 1.0
STEPS = 30

UPPER, LOWER, DIGIT, SPACE, MARK, EXCLAIM, SYMBOL, BEYOND, INNER = range(9)
_SPACES = b" \t\n\r\x0b\x0c"


def _kind(b: int) -> int:
    if b >= 0x80:
        return BEYOND if b >= 0xC0 else INNER
    c = chr(b)
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isdigit():
        return DIGIT
    if b in _SPACES:
        return SPACE
    return EXCLAIM if c == "!" else MARK if c in ".,;:?'\"()-" else SYMBOL


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
FEATURES = (
    "chars", "word_chars", "words", "letters", "upper", "digits", "spaces", "marks", "exclaims",
    "symbols", "repeated", "repeated_by_words", "twice", "ends", "begins", "line_again",
)
OWN = len(FEATURES)
# Own, previous and next line's features, whether there are such, and one.
WIDTH = 3 * OWN + 3


def lines_of(text: bytes | None) -> list[bytes]:
    out = []
    for line in (text or b"").split(b"\n"):
        while len(line) > LINE_BYTES:
            at = line.rfind(b" ", 1, LINE_BYTES) + 1 or LINE_BYTES
            out.append(line[:at])
            line = line[at:]
        out.append(line)
    return [line for line in out if line.strip()]


def line_features(lines: list[bytes], document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, characters) of lines; `document` numbers their documents."""
    joined = b"\n".join(lines) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    kinds = _KINDS[data]
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)], 1)
    counts[:, SPACE] -= 1
    chars = counts.sum(axis=1) - counts[:, INNER]
    letters = counts[:, UPPER] + counts[:, LOWER] + counts[:, BEYOND]
    space = kinds == SPACE
    begin = ~space
    begin[1:] &= space[:-1]
    words = np.add.reduceat(begin, starts, dtype=np.int64)
    hashes = np.fromiter(map(hash, joined.split()), np.int64, int(words.sum())).view(np.uint64)
    line = np.repeat(np.arange(len(lines)), words)
    spread = np.uint64(0x9E3779B97F4A7C15)
    keys = hashes ^ (line.astype(np.uint64) * spread)
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    repeated = np.bincount(line[order[again]], minlength=len(lines))
    side = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    twice = np.bincount(line[side], minlength=len(lines))
    whole = np.fromiter(map(hash, lines), np.int64, len(lines)).view(np.uint64)
    whole = whole ^ (document.astype(np.uint64) * spread)
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    inside = np.maximum(chars - counts[:, SPACE], 1)
    log_words = np.log1p(words)
    features = np.column_stack([
        np.log1p(chars), np.log(inside / np.maximum(words, 1)), log_words, letters / inside,
        counts[:, UPPER] / np.maximum(letters, 1), counts[:, DIGIT] / inside,
        counts[:, SPACE] / np.maximum(chars, 1), counts[:, MARK] / inside,
        counts[:, EXCLAIM] / inside, counts[:, SYMBOL] / inside, repeated / np.maximum(words, 1),
        repeated / np.maximum(words, 1) * log_words, twice / np.maximum(words, 1),
        np.isin(data[ends - 2], list(b".!?")), kinds[starts] == UPPER, times[back] > 1,
    ]).astype(np.float32)
    return features, chars


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of each line and its neighbours in chains of the given sizes."""
    first = np.zeros(len(own), bool)
    first[np.cumsum(sizes) - sizes] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.column_stack([own, before, after, ~first, ~last, np.ones(len(own))])


class Chains:
    """Forward-backward over many chains at once. Labels: 0 bad, 1 good."""

    def __init__(self, score: np.ndarray, arcs: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        longer = [int(np.searchsorted(-sizes, -t)) for t in range(int(sizes.max()))]
        half = np.clip(score / 2, -300, 300)
        shift = np.abs(half)
        own = np.exp(np.column_stack([-half, half]) - shift[:, None])
        step = np.exp(arcs - arcs.max())
        ahead, back = np.empty_like(own), np.ones_like(own)
        scale = np.zeros(len(own))
        both = np.zeros((2, 2))
        for t, many in enumerate(longer):
            at = starts[:many] + t
            value = (ahead[at - 1] @ step if t else 1.0) * own[at]
            scale[at] = value.sum(axis=1)
            ahead[at] = value / scale[at, None]
        for t in range(len(longer) - 1, 0, -1):
            at = starts[:longer[t]] + t
            value = own[at] * back[at]
            pair = ahead[at - 1][:, :, None] * step * value[:, None, :]
            both += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            value = value @ step.T
            back[at - 1] = value / value.sum(axis=1, keepdims=True)
        value = ahead * back
        self.marginals = value / value.sum(axis=1, keepdims=True)
        self.arcs = both  # expected number of arcs by labels
        steps = len(own) - len(sizes)
        self.log_total = float((np.log(scale) + shift).sum() + steps * arcs.max())
        self.half = half


def objective(model: np.ndarray, own: np.ndarray, sizes: np.ndarray, good: np.ndarray,
              ) -> tuple[float, np.ndarray]:
    """Negative log likelihood of chains labelled throughout, and its gradient.
    A model is the weights of a line's features, then the four arcs."""
    x = with_neighbours(own, sizes)
    arcs = model[WIDTH:].reshape(2, 2)
    chains = Chains(x @ model[:WIDTH], arcs, sizes)
    label = np.repeat(good, sizes)
    seen = np.diag([(sizes[~good] - 1).sum(), (sizes[good] - 1).sum()]).astype(float)
    likely = (np.where(label, chains.half, -chains.half)).sum() + (seen * arcs).sum()
    gradient = np.concatenate([
        x.T @ (chains.marginals[:, 1] - label), (chains.arcs - seen).ravel()])
    return chains.log_total - likely, gradient


def minimise(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray,
             steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    at, (value, slope) = start, fn(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, weights = slope.copy(), []
        for s, y in reversed(pairs):
            weights.append((s @ way) / (s @ y))
            way -= weights[-1] * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs \
            else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), w in zip(pairs, reversed(weights)):
            way += (w - (y @ way) / (s @ y)) * s
        size = 1.0
        while True:
            there = at - size * way
            new_value, new_slope = fn(there)
            if new_value <= value - 1e-4 * size * (slope @ way) or size < 1e-4:
                break
            size /= 2
        s, y = there - at, new_slope - slope
        done = value - new_value < 1e-5 * abs(value)
        if new_value < value:
            at, value, slope = there, new_value, new_slope
        if done:
            break
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
    return at


class Model:
    """Standardised features, chain weights, and the curve over the evidence."""

    def __init__(self, mean, spread, weights, curve, share) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights
        self.curve, self.share = curve, share

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        """Log odds of the weighted mean chances; NaN for texts without lines."""
        good, bad = np.zeros(len(texts)), np.zeros(len(texts))
        for lines, document, sizes in _slices(texts):
            own, chars = line_features(lines, document)
            x = with_neighbours((own - self.mean) / self.spread, sizes)
            chains = Chains(x @ self.weights[:WIDTH], self.weights[WIDTH:].reshape(2, 2), sizes)
            bad += np.bincount(document, chars * chains.marginals[:, 0], minlength=len(texts))
            good += np.bincount(document, chars * chains.marginals[:, 1], minlength=len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            odds = np.log(good) - np.log(bad)
        return np.where(good + bad > 0, np.clip(odds, -700, 700), np.nan)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        odds = self.evidence(texts)
        chance = 1 / (1 + np.exp(-np.clip(self.curve[0] * odds + self.curve[1], -700, 700)))
        return np.where(np.isnan(odds), self.share, chance)


def _slices(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(lines, number of their text, chain sizes), a bounded number of bytes each."""
    lines, document, sizes, held = [], [], [], 0
    for k, text in enumerate(texts):
        own = lines_of(text)
        at = 0
        while at < len(own):
            size = 0
            while at + size < len(own) and size < RUN_LINES and (
                    size < 1 or held < 4 * SLICE_BYTES):
                held += len(own[at + size]) + 1
                size += 1
            lines += own[at:at + size]
            document += [k] * size
            sizes.append(size)
            at += size
            if held >= SLICE_BYTES:
                yield lines, np.array(document), np.array(sizes)
                lines, document, sizes, held = [], [], [], 0
    if lines:
        yield lines, np.array(document), np.array(sizes)


def training_rows(
    docs: DataFrame, labels: DataFrame, held_out: Column, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(text, good) of at most about `train_rows` labelled rows outside the fold."""
    own = (
        labels.filter("quality is not null and doc_id is not null").filter(~held_out)
        .groupBy("doc_id").agg((F.max("quality") > 0).alias("good")))
    share = min(1.0, train_rows / max(1, own.count()))
    grain = 1 << 30
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < F.lit(int(share * grain)))
    # A bounded sample of narrow rows.
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "good")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts to chains of features, one row per chain."""
    for batch in batches:
        texts, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lines, document, sizes in _slices(texts):
            own, _ = line_features(lines, document)
            at = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.record_batch(
                [pa.array([own[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary()),
                 pa.array([good[document[a]] for a in at[:-1]])], names=["own", "good"])


def _summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
            size: int) -> np.ndarray:
    """Sum of fn(features, sizes, labels) over all chains, one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            cells = batch.column(0).to_pylist()
            if cells:
                own = np.frombuffer(b"".join(cells), np.float32).reshape(-1, OWN)
                sizes = np.array([len(c) // (4 * OWN) for c in cells])
                total += fn(own.astype(float), sizes, np.array(batch.column(1).to_pylist(), bool))
        yield pa.record_batch([pa.array([total.tolist()])], names=["total"])

    parts = rows.select("own", "good").mapInArrow(run, "total array<double>")
    summed = parts.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("v"))
    out = np.zeros(size)
    for r in summed.collect():
        out[r["pos"]] = r["v"]
    return out


def fit(rows: DataFrame) -> Model:
    """Model from training rows (text as bytes, good)."""
    chains = materialise(
        rows.mapInArrow(_read_rows, "own binary, good boolean"), "line-features")

    def moments(own, sizes, good):
        return np.concatenate([
            own.sum(axis=0), (own * own).sum(axis=0),
            [len(own), good.sum(), (~good).sum()]])

    found = _summed(chains, moments, 2 * OWN + 3)
    lines, good, bad = found[-3:]
    share = float(good / (good + bad)) if good + bad else 0.5
    if not good or not bad:
        return Model(np.zeros(OWN), np.ones(OWN), np.zeros(WIDTH + 4), (0.0, _odds(share)), share)
    mean = found[:OWN] / lines
    spread = np.sqrt(np.maximum(found[OWN:2 * OWN] / lines - mean**2, 1e-6))

    def whole(model: np.ndarray) -> tuple[float, np.ndarray]:
        def part(own, sizes, good):
            value, slope = objective(model, (own - mean) / spread, sizes, good)
            return np.concatenate([[value], slope])

        total = _summed(chains, part, WIDTH + 5)
        return total[0] + RIDGE / 2 * model @ model, total[1:] + RIDGE * model

    weights = minimise(whole, np.zeros(WIDTH + 4))
    return Model(mean, spread, weights, _curve(rows, mean, spread, weights), share)


def _odds(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _curve(rows: DataFrame, mean, spread, weights) -> tuple[float, float]:
    """Slope and intercept over the evidence of the training rows, by Newton's
    method on whole numbers of rows per tenth of log odds."""
    plain = Model(mean, spread, weights, (1.0, 0.0), 0.5)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(plain.evidence(list(texts)))

    cells = (
        rows.select(F.round(evidence("text"), 1).alias("x"), F.col("good").cast("double").alias("y"))
        .filter(~F.isnan("x")).groupBy("x", "y").count().collect())
    x, y, n = (np.array([r[k] for r in cells], float) for k in ("x", "y", "count"))
    a = np.column_stack([np.clip(x, -30, 30), np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (n * (y - p)) - 1e-2 * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), slope)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds the score of each whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return docs.withColumn(free_name(docs, "score"), score(F.col(text).cast("string").cast("binary")))


@query("op11_line_quality")
def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(
        F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(training_rows(docs, labels, held_out))
    return score_texts(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
