"""Token counts by greedy longest match in linear time.

A word is matched from the left with the longest vocabulary piece, first with
pieces that start a word, then with pieces that continue one. The automaton is
a trie of both kinds with failure links: when a character has no edge, the
link names the state left after the pieces already decided are popped, and
their number was computed beforehand, so no piece is ever built and every
character is read once.

Words are runs between white space (str.split). A word with a part that no
piece covers is one unknown token.

Defined cases: null and empty texts have no words; a word of any length is
matched whole, in texts of any length; repeated rows are counted alike; an empty
table gives no rows; other columns pass through,
clashing names get `_` in front.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, held, query, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
# Words remembered by a task in each of two generations, and the longest that is.
CACHE_ENTRIES = 250_000
CACHE_LENGTH = 48
# The vocabulary travels to every task: a parameter of checked size.
MAX_VOCABULARY = 2_000_000


def load_pieces(path: str = MODEL) -> list[str]:
    """Ordinary pieces of a model; a leading mark says that it starts a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


class LongestMatch:
    """Trie with failure links and popped-token counts.

    State 0 is the start of a word, state 1 the start of a continuation. `link`
    is the state after the failure pops (-1: nothing matches), `pops` how many
    pieces they take off.
    """

    def __init__(self, pieces: Sequence[str]) -> None:
        edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in pieces:
            state, rest = (0, piece[1:]) if piece.startswith(START) else (1, piece)
            if not rest:
                continue
            for c in rest:
                nxt = edges[state].get(c)
                if nxt is None:
                    nxt = edges[state][c] = len(edges)
                    edges.append({})
                    final.append(False)
                state = nxt
            final[state] = True
        link, pops = [-1] * len(edges), [0] * len(edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, state in edges[parent].items():
                queue.append(state)
                if final[state]:
                    link[state], pops[state] = 1, 1
                    continue
                at, count = link[parent], pops[parent]
                while at >= 0 and c not in edges[at]:
                    count += pops[at]
                    at = link[at]
                if at >= 0:
                    link[state], pops[state] = edges[at][c], count
        self.edges, self.link, self.pops = edges, link, pops

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if some part has none."""
        edges, link, pops = self.edges, self.link, self.pops
        state = total = 0
        for c in word:
            nxt = edges[state].get(c)
            while nxt is None:
                total += pops[state]
                state = link[state]
                if state < 0:
                    return 0
                nxt = edges[state].get(c)
            state = nxt
        while state != 1:
            if state < 0:
                return 0
            total += pops[state]
            state = link[state]
        return total


class Counter:
    """Per-task counter of words, with a memory of those it has seen."""

    def __init__(self, automaton: LongestMatch) -> None:
        self.automaton = automaton
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        count = self.older.get(word)
        if count is None:
            count = self.automaton.count(word)
        if len(word) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[word] = count
        return count

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = (text or "").split()
        get, other = self.cache.get, self.word
        counts = [n if (n := get(w)) is not None else other(w) for w in words]
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


def count_tokens(
    df: DataFrame, pieces: Sequence[str], text: str = "text",
) -> DataFrame:
    """Adds n_words, n_tokens and n_unknown of each whole text."""
    if len(pieces) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} pieces")
    key = xxhash.xxh3_64_intdigest("\n".join(pieces))
    vocabulary = df.sparkSession.sparkContext.broadcast(list(pieces))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def count(texts: pd.Series) -> pd.DataFrame:
        own = held(key, lambda: Counter(LongestMatch(vocabulary.value)))
        return pd.DataFrame([own.text(t) for t in texts],
                            columns=["n_words", "n_tokens", "n_unknown"])

    found = free_name(df, "counted")
    counted = df.withColumn(found, count(F.col(text).cast("string")))
    fields = [F.col(f"{found}.{c}").alias(free_name(df, c))
              for c in ("n_words", "n_tokens", "n_unknown")]
    return counted.select(*[F.col(c) for c in df.columns], *fields)


@query("op4_wordpiece_counts")
def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load_pieces()).drop("text")
