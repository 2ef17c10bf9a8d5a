"""URL filters: host/path rules by longest match, pattern rules by a token index.

A pattern rule is written as in public filter lists: literal text, `*` for any
text, `^` for a separator or the end, `||` for the start of the host or of one
of its labels, `|` for the start or end of the url, `@@` in front for an
exception. Every rule sits in the index under one of its literal tokens, the
one that the fewest urls have; a rule without a whole token is tried on every
url. The tokens of a url fetch candidate rules and only these run their
regular expression.

Defined cases: a null or schemeless url has an empty host and path, and a null
url is allowed; case is folded for A-Z only; ties between host/path rules of
equal length go to the first in the list; urls of any length are judged whole;
repeated rows each get a verdict; an empty table gives no rows;
other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm.common import free_name, query, table

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
_HOST_START = r"^[a-z0-9+.-]*://(?:[^/?#]*\.)?"

# (verdict, host, path)
HOST_RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
PATTERN_RULES = (
    "^utm_source=feed^", "&ref=x^", "||m.*.example.com^", "||www.*.example.net/es/",
    "||ads.*/banner/", "/cgi-bin/*login", "^casino^", "^viagra^", "||tracker.*^click^",
    "/wp-admin/", "^sessionid=", "|ftp://", ".exe|", "/calendar/*/day/",
    "@@||example.net/en/", "@@||blog.*^utm_source=feed^",
)
# The rule set travels to every task: its size is a parameter and checked.
MAX_RULES = 200_000


@dataclass(frozen=True)
class PatternRule:
    regex: str
    verdict: str
    tokens: tuple[str, ...]


def parse_rule(text: str) -> PatternRule:
    """Regular expression and whole literal tokens of one pattern rule."""
    verdict, body = BLOCK, text.translate(_FOLD)
    if body.startswith("@@"):
        verdict, body = ALLOW, body[2:]
    start = end = ""
    open_start = open_end = True
    if body.startswith("||"):
        start, body, open_start = _HOST_START, body[2:], False
    elif body.startswith("|"):
        start, body, open_start = "^", body[1:], False
    if body.endswith("|"):
        end, body, open_end = "$", body[:-1], False
    middle = "".join(
        ".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in body
    )
    tokens = []
    for m in _TOKEN.finditer(body):
        left = body[m.start() - 1] if m.start() else ("*" if open_start else "^")
        right = body[m.end()] if m.end() < len(body) else ("*" if open_end else "^")
        if "*" not in (left, right):
            tokens.append(m.group())
    return PatternRule(start + middle + end, verdict, tuple(dict.fromkeys(tokens)))


def token_counts(urls: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the given tokens occurs; counts all urls."""
    if not tokens:
        return {}
    folded = F.translate(F.col(url), UPPER, LOWER)
    found = (
        urls.select(F.explode(F.array_distinct(F.split(folded, "[^a-z0-9]+"))).alias("token"))
        .filter(F.col("token").isin(*tokens))
        .groupBy("token").count()
    )
    return {r["token"]: r["count"] for r in found.collect()}


def token_index(
    rules: Sequence[PatternRule], counts: dict[str, int],
) -> dict[str, list[PatternRule]]:
    """Rules under their rarest token; '' holds those tried on every url."""
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(key, []).append(rule)
    return index


class _Judge:
    """Per-task form of both rule sets."""

    def __init__(self, host_rules, index) -> None:
        self.hosts: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in host_rules:
            self.hosts.setdefault(host, []).append((path, verdict, host + path))
        for own in self.hosts.values():
            own.sort(key=lambda r: -len(r[0]))
        self.depth = max((h.count(".") + 1 for h in self.hosts), default=0)
        self.index = {
            t: [(re.compile(r.regex, re.DOTALL), r.verdict) for r in rules]
            for t, rules in index.items()
        }

    def split(self, url: str | None) -> tuple[str, str]:
        head, found, rest = (url or "").partition("://")
        if not found:
            return "", ""
        rest = re.split(r"[?#]", rest, maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        return host.translate(_FOLD), slash + path

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        labels = host.rsplit(".", self.depth)[-self.depth:] if self.depth else []
        suffixes = [".".join(labels[k:]) for k in range(len(labels))]
        if host not in suffixes:
            suffixes.append(host)
        for suffix in suffixes:
            for start, verdict, name in self.hosts.get(suffix, ()):
                if path.startswith(start) and (best is None or len(name) > len(best[0])):
                    best = (name, verdict)
        return best

    def pattern_verdict(self, url: str | None) -> str:
        if url is None:
            return ALLOW
        folded = url.translate(_FOLD)
        blocked = False
        for token in ("", *set(_TOKEN.findall(folded))):
            for regex, verdict in self.index.get(token, ()):
                if (verdict == ALLOW or not blocked) and regex.search(folded):
                    if verdict == ALLOW:
                        return ALLOW
                    blocked = True
        return BLOCK if blocked else ALLOW

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = self.split(url)
        rule = self.host_rule(host, path)
        if rule:
            return host, path, rule[0], rule[1]
        return host, path, None, self.pattern_verdict(url)


def filter_urls(
    pages: DataFrame, url: str = "url",
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    patterns: Sequence[str] = PATTERN_RULES,
) -> DataFrame:
    """Adds host, path, rule and verdict (in front of a clashing name: `_`)."""
    if len(host_rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rules = [parse_rule(p) for p in patterns]
    counts = token_counts(pages, url, sorted({t for r in rules for t in r.tokens}))
    index = token_index(rules, counts)
    own_rules = list(host_rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        judged = _Judge(own_rules, index)
        rows = [judged(u) for u in urls]
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    found = free_name(pages, "judged")
    out = pages.withColumn(found, judge(F.col(url).cast("string")))
    fields = [F.col(f"{found}.{c}").alias(free_name(pages, c))
              for c in ("host", "path", "rule", "verdict")]
    return out.select(*[F.col(c) for c in pages.columns], *fields)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    rules = [parse_rule(p) for p in PATTERN_RULES]

    def any_of(verdict: str) -> str:
        return " OR ".join(
            f"regexp_matches(folded, {_quoted('(?s)' + r.regex)})"
            for r in rules if r.verdict == verdict
        )

    fits = [
        (host + path, verdict,
         f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')")
        for verdict, host, path in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = " ".join(f"WHEN {cond} THEN '{name}'" for name, _, cond in fits)
    verdict = " ".join(f"WHEN {cond} THEN '{v}'" for _, v, cond in fits)
    return f"""
    WITH a AS (
      SELECT page_id, url, translate(url, '{UPPER}', '{LOWER}') AS folded,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                  ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, folded,
             translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(regexp_extract(rest, '^[^?#]*'), '(?s)/.*') AS path FROM a)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
           CASE {verdict} WHEN folded IS NULL THEN 'allow' WHEN {any_of(ALLOW)} THEN 'allow'
                WHEN {any_of(BLOCK)} THEN 'block' ELSE 'allow' END AS verdict FROM b
    """


@query("op8_url_filters", _oracle())
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
