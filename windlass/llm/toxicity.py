"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into classes: insults (learned word beginnings, each with
the log odds of its training rows), threats, targets, negations and words of
reporting. Five transducers rewrite a clause's classes and weigh its arcs: the
insult and the threat transducer weigh each word of their kind, a repeated one
at half; the target transducer marks those near a target as aimed, the negation
transducer those in the scope of a negation as negated, and the one of reported
speech those of a clause with a word of reporting as reported. What stands
before a word and what follows it both count, so the grammar is a bimachine:
the transducers are composed into one that reads a clause forwards and one that
reads its output backwards.

A clause matches a pattern (insult, threat or both, with the marks of its
heaviest word) and its weight is the sum along its arcs. Final weights of the
patterns are fitted on training rows: a text's score is a logistic function of
its clauses' weights by pattern. `matched_clauses` returns the clauses.

Only the training fold teaches: labelled rows whose crc32(doc_id) mod 5 is not
0, at most about `TRAIN_ROWS` of them, chosen by a hash. Scores see the text
and nothing else.

Defined cases: null and empty texts have no evidence and get the score of that;
texts of any length are read whole; repeated label rows count once, the larger
label wins; null labels do not teach; without labels every score is the share
0.5 of an unfitted model; repeated rows score alike; an empty table gives no
rows; other columns pass through, clashing names get `_` in front.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, held, query, table

TRAIN_ROWS = 20_000
FOLDS = 5
# A word beginning is an insult if so many toxic training rows have it, and at
# most this share of all rows that have it is not toxic.
MIN_TOXIC_ROWS = 6
MAX_CLEAN_SHARE = 0.05
PREFIXES = range(4, 9)

THREATS = "kill hurt destroy burn shoot stab töten vernichten matar destruir tuer détruire"
TARGETS = ("you your he him she her they them people everyone du dich ihr euch sie er "
           "tu te vous il elle ils ustedes él ella ellos vosotros")
NEGATIONS = "not no never none without nicht kein keine nie ohne pas jamais sans nunca ni sin"
REPORTS = ("said says told wrote reported according claims sagte sagt schrieb laut dit écrit "
           "selon dijo escribió según")
SCOPE = 3
TARGET_SCOPE = 5

REPEATED_SHARE = 0.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
AIMED, NEGATED, REPORTED = 1, 2, 4
_WORD = re.compile(r"\w+|[,\"«»„“”:]")
_CLAUSE_END = re.compile(r"[.!?;\n]")


Symbol = tuple[int, int]


class Transducer:
    """Deterministic weighted transducer over (class, marks): a step gives the
    next state, what is written and the arc's weight. Weights of composed arcs
    multiply; along a path they are summed, each times its word's own weight."""

    def __init__(self, start, step) -> None:
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        """Feeds what this one writes to the other."""

        def step(state, symbol):
            mine, out, one = self.step(state[0], symbol)
            theirs, out, two = other.step(state[1], out)
            return (mine, theirs), out, one * two

        return Transducer((self.start, other.start), step)

    def table(self, symbols: Iterable[Symbol]) -> dict:
        """All reachable arcs: (state number, symbol) -> (state number, written, weight)."""
        symbols = list(symbols)
        number, queue, arcs = {self.start: 0}, [self.start], {}
        while queue:
            state = queue.pop()
            for symbol in symbols:
                to, out, weight = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                arcs[number[state], symbol] = (number[to], out, weight)
        return arcs


def weighing(kind: int, repeated: float = REPEATED_SHARE) -> Transducer:
    """Arcs of a kind of word: the clause's first one counts whole."""

    def step(seen, symbol):
        if symbol[0] != kind:
            return seen, symbol, 1.0
        return True, symbol, repeated if seen else 1.0

    return Transducer(False, step)


def marking(trigger: int, mark: int, scope: int | None) -> Transducer:
    """Marks insults and threats within `scope` words after the trigger, or in
    all of the rest of the clause."""

    def step(left, symbol):
        kind, marks = symbol
        if kind in (INSULT, THREAT) and left:
            marks |= mark
        if kind == trigger:
            return (scope or 1), symbol, 1.0
        return (max(0, left - 1) if scope else left), (kind, marks), 1.0

    return Transducer(0, step)


def grammar() -> tuple[dict, dict]:
    """The composed transducers of both directions, started anew for each clause."""
    target = marking(TARGET, AIMED, TARGET_SCOPE)
    report = marking(REPORT, REPORTED, None)
    ahead = (
        weighing(INSULT).compose(weighing(THREAT)).compose(marking(NEGATION, NEGATED, SCOPE))
        .compose(report).compose(target))
    back = report.compose(target)
    return (ahead.table((k, 0) for k in range(6)),
            back.table((k, m) for k in range(6) for m in range(8)))


PATTERNS = [(kind, marks) for kind in ("insult", "threat", "both") for marks in range(8)]
FEATURES = [f"{kind}_{marks}" for kind, marks in PATTERNS]


class Reader:
    """Per-process reader: texts to matched clauses."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.insults = insults
        self.ahead, self.back = grammar()
        self.classes = {w: k for k, words in (
            (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS),
        ) for w in words.split()}
        self.finder = ahocorasick.Automaton()
        for stem, weight in insults.items():
            self.finder.add_word(stem.rstrip("$"), (stem, weight))
        for word in THREATS.split():
            if not self.finder.exists(word):
                self.finder.add_word(word, (word + "$", 0.0))
        self.finder.make_automaton()

    def hits(self, text: str) -> dict[int, float]:
        """Starts of words that are insults (their weight) or threats (0)."""
        found: dict[int, float] = {}
        for end, (stem, weight) in self.finder.iter(text):
            size = len(stem) - stem.endswith("$")
            start = end - size + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            if stem.endswith("$") and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            found[start] = max(weight, found.get(start, 0.0))
        return found

    def read_clause(self, classes: list[int], weights: list[float]) -> tuple[int, float] | None:
        """(pattern, weight) of a clause's words, None if it matches none."""
        state, written, arcs = 0, [], []
        for kind in classes:
            state, out, arc = self.ahead[state, (kind, 0)]
            written.append(out)
            arcs.append(arc)
        state, total, heaviest, marks, kinds = 0, 0.0, -1.0, 0, set()
        for at in range(len(written) - 1, -1, -1):
            state, (kind, own), arc = self.back[state, written[at]]
            if kind not in (INSULT, THREAT):
                continue
            weight = arcs[at] * arc * weights[at]
            total += weight
            kinds.add(kind)
            # Of equal ones the clause's first.
            if weight >= heaviest:
                heaviest, marks = weight, own
        if not kinds:
            return None
        return 8 * (2 if len(kinds) > 1 else kinds.pop() - INSULT) + marks, total

    def clauses(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(start, end, pattern, weight) of all matched clauses, in order."""
        text = (text or "").lower()
        hits = self.hits(text) if text else {}
        out, done = [], 0
        for at in sorted(hits):
            if at < done:
                continue
            first = max(done, max(text.rfind(c, done, at) for c in ".!?;\n") + 1)
            stop = _CLAUSE_END.search(text, at)
            done = stop.start() if stop else len(text)
            kinds, weights = [], []
            for m in _WORD.finditer(text, first, done):
                weight = hits.get(m.start())
                kinds.append(INSULT if weight else self.classes.get(m.group(), OTHER))
                weights.append(weight or 1.0)
            found = self.read_clause(kinds, weights)
            if found:
                out.append((first, done, *found))
        return out

    def evidence(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        for _, _, pattern, weight in self.clauses(text):
            out[pattern] += weight
        return np.log1p(out)


def training_rows(
    docs: DataFrame, labels: DataFrame, held_out: Column, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(text, toxic) of at most about `train_rows` labelled rows outside the fold."""
    own = (
        labels.filter("toxic is not null and doc_id is not null").filter(~held_out)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, train_rows / max(1, own.count()))
    grain = 1 << 30
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < F.lit(int(share * grain)))
    # A bounded sample of narrow rows.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Word beginnings (with `$`: whole words) of toxic rows, and their log odds."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w"), F.monotonically_increasing_id()
        .alias("row"))
    stems = F.array_distinct(F.concat(F.array(F.concat("w", F.lit("$"))), F.filter(
        F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in PREFIXES]),
        lambda s: s.isNotNull())))
    counted = (
        words.select("row", "toxic", F.explode(stems).alias("stem")).distinct()
        .groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
        # As many as the bounded training rows have beginnings in common.
        .filter((F.col("bad") >= MIN_TOXIC_ROWS)
                & (F.col("all") - F.col("bad") <= MAX_CLEAN_SHARE * F.col("all"))))
    found = {r["stem"]: math.log((r["bad"] + 0.5) / (r["all"] - r["bad"] + 0.5))
             for r in counted.collect()}
    # A beginning that a shorter one covers adds nothing.
    return {s: w for s, w in found.items()
            if not any(s[:n] in found and s[:n] != s for n in PREFIXES)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _reader(name: str, insults: dict[str, float]) -> Reader:
    return held(("reader", name), lambda: Reader(insults))


def score_texts(
    docs: DataFrame, insults: dict[str, float], weights: np.ndarray, text: str = "text",
) -> DataFrame:
    """Adds the score of each whole text."""
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = _reader(name, insults)
        x = np.array([own.evidence(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return docs.withColumn(free_name(docs, "score"), score(F.col(text).cast("string")))


def matched_clauses(
    docs: DataFrame, insults: dict[str, float], weights: np.ndarray, text: str = "text",
) -> DataFrame:
    """Adds the matched clauses of each text: place in characters, pattern, weight
    along the arcs and the part of the text's log odds it would have alone."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<struct<start:long,end:long,pattern:string,weight:double,log_odds:double>>")
    def clauses(texts: pd.Series) -> pd.Series:
        own = _reader(name, insults)
        return pd.Series([[
            {"start": a, "end": z, "pattern": FEATURES[k], "weight": w,
             "log_odds": float(weights[k] * np.log1p(w))} for a, z, k, w in own.clauses(t)]
            for t in texts], dtype=object)

    return docs.withColumn(free_name(docs, "clauses"), clauses(F.col(text).cast("string")))


def fit(rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from training rows (text, toxic)."""
    insults = learn_insults(rows)
    name = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        own = _reader(name, insults)
        return pd.Series([own.evidence(t) for t in texts])

    got = rows.select(evidence("text").alias("x"), F.col("toxic").cast("double").alias("y"))
    data = got.groupBy("x", "y").count().collect()
    x = np.array([r["x"] for r in data], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in data], float)
    times = np.array([r["count"] for r in data], int)
    return insults, fit_logistic(np.repeat(x, times, axis=0), np.repeat(y, times))


@query("op2_toxic_clauses")
def op2_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(
        F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    insults, weights = fit(training_rows(docs, labels, held_out))
    return score_texts(docs, insults, weights).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
