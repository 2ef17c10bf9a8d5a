"""Page fetch: bounded parallel reads per host, retries with back-off.

Urls are dealt out by host, a few slots for each, so a host never sees more
than `slots * threads` requests at a time and a host with most of the urls does
not wait in one task. A request that fails is made again after a doubling wait;
an HTTP error is an answer and is not. Every url gets a row: what failed for
good has an `error` and no page.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, status int, html string, tries int, error string"


@dataclass(frozen=True)
class Request:
    url: str
    # The stored page, if there is one.
    cached: str | None
    # 1 for the first try.
    attempt: int


@dataclass(frozen=True)
class Response:
    status: int
    html: str | None


Fetcher = Callable[[Request], Response]


def http_fetcher(timeout: float = 30.0) -> Fetcher:
    def fetch(request: Request) -> Response:
        try:
            with urllib.request.urlopen(request.url, timeout=timeout) as answer:
                text = answer.read().decode(
                    answer.headers.get_content_charset() or "utf-8", "replace")
                return Response(answer.status, text)
        except urllib.error.HTTPError as e:
            return Response(e.code, None)

    return fetch


def cached_first(fetch: Fetcher) -> Fetcher:
    """The stored page where there is one."""

    def own(request: Request) -> Response:
        if request.cached is not None:
            return Response(200, request.cached)
        return fetch(request)

    return own


def _with_retries(fetch: Fetcher, url: str, cached: str | None, tries: int, wait: float,
                  longest: float) -> tuple:
    error = None
    for attempt in range(1, tries + 1):
        try:
            got = fetch(Request(url, cached, attempt))
        except Exception as e:  # whatever a fetcher raises is a failed request
            error = f"{type(e).__name__}: {e}"
            if attempt < tries:
                time.sleep(min(longest, wait * 2 ** (attempt - 1)))
            continue
        failed = None if 200 <= got.status < 300 else f"HTTP {got.status}"
        return url, got.status, got.html if failed is None else None, attempt, failed
    return url, None, None, tries, error


def fetch_pages(
    urls: DataFrame, fetch: Fetcher, tries: int = 10, wait: float = 1.0, longest: float = 60.0,
    slots: int = 4, threads: int = 25, tasks: int | None = None,
) -> DataFrame:
    """urls: url and optionally cached -> url, status, html, tries, error; each
    url once. Null urls are left out."""
    cached = F.col("cached") if "cached" in urls.columns else F.lit(None)
    wanted = urls.filter("url is not null").groupBy("url").agg(
        F.max(cached.cast("string")).alias("cached"))
    # Hosts are read without url functions, which refuse broken urls.
    host = F.regexp_extract("url", r"^[^:/]*://([^/?#]*)", 1)
    slot = F.pmod(F.xxhash64("url"), F.lit(slots))
    # A number of its own: requests are slow however few bytes they are.
    tasks = tasks or 4 * urls.sparkSession.sparkContext.defaultParallelism
    dealt = wanted.repartition(tasks, F.lower(host), slot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                stored = batch["cached"].astype(object).where(batch["cached"].notna(), None)
                rows = list(pool.map(
                    lambda r: _with_retries(fetch, r[0], r[1], tries, wait, longest),
                    zip(batch["url"], stored)))
                out = pd.DataFrame(rows, columns=["url", "status", "html", "tries", "error"])
                yield out.astype({"status": "Int32"})

    return dealt.mapInPandas(run, SCHEMA)
