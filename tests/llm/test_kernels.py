"""The operators' kernels against brute force, without Spark."""

import base64
import math
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from windlass.llm import (
    byte_bpe, decontamination, jaccard_join, quality_rules, suffix_dedup, token_counts, toxicity,
    url_filters, warc,
)
from windlass.llm.suffix_grouping import suffix_array

few = st.lists(st.integers(0, 2), max_size=30)


@settings(max_examples=300, deadline=None)
@given(few, st.integers(1, 3))
def test_suffix_array(symbols, times):
    symbols = symbols * times
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def longest_shared(text):
    out = [0] * len(text)
    for i in range(len(text)):
        for j in range(len(text)):
            k = 0
            while i != j and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab\0é", max_size=25), max_size=4), st.integers(1, 3))
def test_repeat_lengths(texts, times):
    data = [(t * times).encode() for t in texts]
    got, owner = quality_rules.repeat_lengths(data)
    want = [k for t in data for k in longest_shared(t)]
    # Below eight bytes nothing is looked for.
    assert [k if k >= 8 else 0 for k in got.tolist()] == [k if k >= 8 else 0 for k in want]
    assert owner.tolist() == [i for i, t in enumerate(data) for _ in t]


def test_quality_measures():
    text = "one two three four five six seven eight\n" * 3 + "# tail\n"
    row = quality_rules.measure([text, ""]).iloc[0]
    assert (row.n_words, row.n_symbols, row.n_dup_lines) == (26, 1, 2)
    assert row.n_repeat_words == 24 and row.base_failed and not row.kept
    empty = quality_rules.measure([text, ""]).iloc[1]
    assert empty.n_words == 0 and empty.base_failed
    assert quality_rules.measure([]).empty
    words = [f"w{i}" for i in range(40)]
    assert quality_rules.measure([" ".join(words)]).iloc[0].kept
    line = " ".join(words[:9])
    twice = " ".join(words + [line] + words[10:30] + [line])
    own = twice.split()
    windows = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    assert quality_rules.measure([twice]).iloc[0].n_repeat_words == len(covered)


def test_byte_bpe_equals_the_library():
    tokens = byte_bpe.load_ranks(byte_bpe.RANKS)
    keys = [t for t in tokens if t]
    displacement, owner = byte_bpe.minimal_perfect_hash(keys)
    assert sorted(owner.tolist()) == list(range(len(keys)))
    own = byte_bpe.Encoder(tokens, displacement, owner, byte_bpe.PATTERN)
    assert all(own.tokens[own.whole(k)] == k for k in random.Random(0).sample(keys, 2000))
    assert own.whole(b"no such token, surely") == -1
    with open(byte_bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = "aZé1٣ \t\n\x1c\x85\xa0　'sdll.,!漢字🎉́​\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "x" * 5000, "ab" * 3000, "Wörter, die länger sind.\n\n  und\tmehr"]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    assert own.encode(None) == b"" and own.decode(None) == b""


def greedy(word, pieces):
    at = count = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("▁" if at == 0 else "") + word[at:end] in pieces:
                break
        else:
            return 0
        at, count = end, count + 1
    return count


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.booleans(), st.text("abc", min_size=1, max_size=4)), max_size=12),
       st.lists(st.text("abc", min_size=1, max_size=12), max_size=8))
def test_longest_match(pieces, words):
    pieces = {("▁" if start else "") + p for start, p in pieces}
    automaton = token_counts.LongestMatch(sorted(pieces))
    assert [automaton.count(w) for w in words] == [greedy(w, pieces) for w in words]


def test_common_counts_and_depth():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    got = jaccard_join.common_counts(sets[:4], sets[4:])
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert got.tolist() == want
    depth = jaccard_join.prefix_depth(28, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** 28 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 28


def test_prefixes_are_shortened_until_the_recall_is_met():
    rng = np.random.default_rng(5)
    for listed in (0, 1, 7, 28):
        counts = np.sort(rng.integers(2, 500, (listed, 4)), axis=1)[:, ::-1]
        lengths = jaccard_join.shorten(counts, 5, 28)
        miss = (1 - 0.8 ** 5) ** (28 - listed) * np.prod(1 - 0.8 ** lengths.astype(float))
        assert miss <= 1e-4 * 1.001
        assert listed < 28 or miss > 1e-5 * 1.6  # no further than needed
    # Crowded nodes stay deep, those that cost nothing are opened first.
    counts = np.array([[900, 900, 900, 2]] * 5 + [[2, 2, 2, 2]] * 23)
    lengths = jaccard_join.shorten(counts, 5, 28)
    assert lengths[:5].tolist() == [8] * 5 and lengths[5:].mean() < 6
    assert jaccard_join.shorten(np.zeros((0, 4), int), 5, 28).size == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2 ** 30), st.sampled_from([0, 3]))
def test_contexts_find_repeats(seed, hot):
    """Sender, meeting and suffix arrays on one task's data, against a set."""
    rng = random.Random(seed)
    length, gram = 12, 4
    passages = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 40))) for _ in range(4)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.6 else
                     "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 9)))
                     for _ in range(rng.randint(0, 6))) for _ in range(7)]
    frame = pd.DataFrame({"uid": range(7), "id": range(7), "text": texts})
    own = [suffix_dedup.contexts_of(np.frombuffer(t.encode(), np.uint8), length, gram)[0]
           for t in texts]
    anchors = np.concatenate([o["anchor"] for o in own]) if own else np.zeros(0, np.uint64)
    send = suffix_dedup._send(3, anchors[:hot], length, gram)
    # Each document is a batch of its own: nothing is met before the buckets.
    sent = [b for i in range(7) for b in send(iter([frame.iloc[i:i + 1]]))]
    met = suffix_dedup._meet(pd.concat(sent)) if sent else pd.DataFrame(
        columns=["kind", "uid", "data"])
    spans = {i: list(met[(met.kind == 0) & (met.uid == i)].data) for i in range(7)}
    wanted = met[met.kind == 1].groupby("uid").data.agg(list).reset_index()
    batch = wanted.assign(text=[texts[i] for i in wanted.uid]).rename(columns={"data": "contexts"})
    fetched = pd.concat([pd.DataFrame(columns=suffix_dedup.FETCHED),
                         *suffix_dedup._fetch(1, length)(iter([batch]))])
    if len(fetched):
        for _, uid, data in suffix_dedup._resolve(length)(fetched).itertuples(index=False):
            spans[uid].append(data)
    seen = set()
    for i, text in enumerate(texts):
        data, gone = text.encode(), set()
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone |= set(range(s, s + length))
            seen.add(data[s:s + length])
        got = {k for a, b in suffix_dedup.merged_spans(spans[i], length) for k in range(a, b)}
        assert got == gone


def test_shared_shingles_are_exact():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for _ in range(150):
        own = rng.choice(items).split()
        cut = own[:max(1, int(len(own) * rng.choice([0.5, 0.85, 1])))]
        noise = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        doc = " ".join([*noise, *cut, *noise[:50]]).upper()
        have = doc.lower().split()
        for item, got in zip(items, decontamination.shared_shingles(doc, items)):
            w = item.split()
            n = min(5, len(w))
            shingles = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
            shared = len(shingles & {tuple(have[i:i + n]) for i in range(len(have) - n + 1)})
            assert got == (shared, shared / len(shingles))


@pytest.mark.parametrize("n_item, n_doc", [(1, 300), (2, 5000), (10, 64), (33, 1100), (40, 20_000)])
def test_signatures_meet_with_the_recall_they_were_cut_for(n_item, n_doc):
    """Items that share just enough with random documents, among many trials."""
    rng = np.random.default_rng(n_item)
    shift = decontamination.bin_shift(decontamination.item_class(n_item), 0.8, 0.99)
    shared = int(np.ceil(0.8 * n_item))
    found, trials, kept = 0, 300, 0
    for _ in range(trials):
        doc = np.unique(rng.integers(0, 2**64, n_doc, np.uint64))
        item = rng.choice(doc, shared, replace=False)
        own = decontamination.signature(doc, shift)
        kept += len(own) / len(doc) / trials
        found += bool(np.isin(own, item).any())
    assert found >= 0.97 * trials
    assert n_item < 30 or kept < 0.5  # long items need a sketch only
    assert decontamination.signature(np.zeros(0, np.uint64), 3).size == 0


def test_longer_items_take_fewer_bins():
    shifts = [decontamination.bin_shift(bits) for bits in range(10)]
    assert shifts == sorted(shifts) and shifts[0] < 0 < shifts[6]


@pytest.mark.parametrize("rule, hit, miss", [
    ("||ads.*/banner/", "https://x.ads.net/banner/1", "https://x.net/ads./banner"),
    ("^casino^", "http://a.org/casino?x", "http://a.org/casinos"),
    ("|ftp://", "ftp://a.org", "http://a.org/?u=ftp://b"),
    (".exe|", "http://a.org/X.EXE", "http://a.org/x.exe?y"),
])
def test_pattern_rules(rule, hit, miss):
    rules = [url_filters.parse_rule(rule)]
    index = url_filters.token_index(rules, {})
    judge = url_filters._Judge([], index)
    assert judge.pattern_verdict(hit) == "block" and judge.pattern_verdict(miss) == "allow"


def test_rarest_token_and_host_rules():
    rule = url_filters.parse_rule("^common^rare^")
    assert list(url_filters.token_index([rule], {"common": 9, "rare": 1})) == ["rare"]
    assert url_filters.parse_rule("*part*").tokens == ()
    judge = url_filters._Judge(url_filters.HOST_RULES, {})
    assert judge("https://A.Example.ORG/es/1")[:3] == ("a.example.org", "/es/1", "example.org/es/")
    assert judge("https://example.org/en/19")[2:] == ("example.org/en/1", "block")
    assert judge("https://notexample.org/es/")[2] == "org/"
    assert judge("https://x.org")[2] is None and judge(None) == ("", "", None, "allow")
    assert judge("no scheme") == ("", "", None, "allow")


def test_grammar_marks():
    reader = toxicity.Reader({"idiot": 2.0, "scum$": 1.0})
    features = dict(zip(toxicity.FEATURES, range(99)))

    def marks(text):
        found = reader.evidence(text)
        return {k: round(math.expm1(found[i]), 6) for k, i in features.items() if found[i]}

    assert marks("What an idiot.") == {"insult_0": 2.0}
    assert marks("You are an idiot") == {"insult_1": 2.0}
    assert marks("He is not an idiot!") == {"insult_3": 2.0}
    assert marks("They said he is scum") == {"insult_5": 1.0}
    assert marks("not so. Idiots") == {"insult_0": 2.0}
    # A target, or a word of reporting, may follow as well.
    assert marks("kill them") == {"threat_1": 1.0}
    assert marks("idiot, that is what you are") == {"insult_1": 2.0}
    assert marks("i will kill you, he said") == {"threat_5": 1.0}
    # A clause has one pattern: its heaviest word's marks; repeats count half.
    assert marks("idiot or not a scum") == {"insult_0": 2.5}
    assert marks("idiot, kill it; idiot idiot") == {"both_0": 3.0, "insult_0": 3.0}
    assert marks("scummy oidiot") == {} == marks(None) == marks("")


def test_logistic_orders_rows():
    x = np.array([[0.0], [0.1], [2.0], [3.0]] * 10)
    w = toxicity.fit_logistic(x, np.array([0, 0, 1, 1] * 10))
    score = x[:4] @ w[:-1] + w[-1]
    assert score[0] < 0 < score[3]
    assert toxicity.fit_logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


def test_warc_parser_reads_continued_fields():
    record = (b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\n"
              b"WARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\n"
              b"Content-Type: application/warc-fields\r\nContent-Length: 17\r\n\r\n"
              b"id: 4\r\nnote: x\r\n \r\n\r\n")
    rows = list(warc.parse_records(record))
    assert rows[0][0] == "<a>" and rows[0][2] == ["<b>", "<c>"] and rows[0][7]["id"] == "4"
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-20]))


def test_composed_transducers_mark_what_the_rules_say():
    """All rules by their definition, over random clauses."""
    rng = random.Random(8)
    reader = toxicity.Reader({"idiot": 2.0})
    t = toxicity
    for _ in range(3000):
        n = rng.randrange(1, 14)
        kinds = [rng.choice([t.OTHER, t.OTHER, t.OTHER, t.INSULT, t.THREAT, t.TARGET, t.NEGATION,
                             t.REPORT]) for _ in range(n)]
        weights = [rng.choice([0.5, 1.0, 2.5]) for _ in range(n)]
        found, seen = [], set()
        for i, kind in enumerate(kinds):
            if kind not in (t.INSULT, t.THREAT):
                continue
            near = [kinds[j] for j in range(n) if j != i and abs(i - j) <= t.TARGET_SCOPE]
            marks = (t.AIMED * (t.TARGET in near)
                     | t.NEGATED * (t.NEGATION in kinds[max(0, i - t.SCOPE):i])
                     | t.REPORTED * (t.REPORT in kinds))
            found.append((weights[i] * (0.5 if kind in seen else 1), -i, kind, marks))
            seen.add(kind)
        got = reader.read_clause(kinds, weights)
        if not found:
            assert got is None
            continue
        kind = 2 if len({f[2] for f in found}) > 1 else found[0][2] - t.INSULT
        assert got == (8 * kind + max(found)[3], pytest.approx(sum(f[0] for f in found)))


def test_held_objects_give_way_to_each_other():
    from windlass.llm import common

    common._HELD.clear()
    for key in "abcd":
        common.held(key, lambda: key)
        common.held("a", lambda: "a")
    assert list(common._HELD) == ["c", "d", "a"]
    common.held("needs memory")
    assert list(common._HELD) == ["needs memory"]
    common._HELD.clear()
