"""WARC archives: writing captures and assembling them back.

A capture is three records: a request, a response (or a revisit of an equal
payload) and a metadata record, the first and last tied to the response by
WARC-Concurrent-To. Archives are gzip text files written by Spark's own
writer: a record is one value whose last byte is the writer's line end.

`read_archives` streams the records out of each file; `assemble` joins request,
response and metadata records through their concurrent-to identifiers, in
either direction and over any number of records in between, and emits one nested
row per capture.

Defined cases: a null payload is an empty one; equal payloads below
`min_revisit` bytes are all responses; of equal payloads, that with the
smallest (id, input position) is the response, a null id last; repeated rows
are separate captures; a payload of any size below an archive's is written whole; control characters and blanks in a url are
percent-escaped; request and metadata records that no response
is linked to give captures whose response is null, one for each linked group; an empty table gives no captures; columns
other than those named do not enter the archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import sql
from windlass.llm.common import materialise, query, table
from windlass.operators.graph import connected_components
from windlass.session import scratch_path

MIN_REVISIT = 100
RECORDS_PER_ARCHIVE = 30_000
# Payload digests with copies that are broadcast, at about 100 bytes each.
BROADCAST_HEADS = 100_000
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"
_PRIMARY = ("response", "revisit", "resource")
_BATCH_BYTES = 4 << 20

RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, "
    "uri string, date string, digest string, fields map<string,string>, payload binary"
)


def _record_id(seed: str, uid: Column, role: str) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(seed), F.lit(role), uid.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One WARC record without its last line feed. Null headers are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))
             for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                      F.lit(_CRLF + _CRLF))
    return F.concat(F.lit("WARC/1.1" + _CRLF), *lines, length, block, F.lit(_CRLF + "\r"))


def stage_captures(
    df: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """(uid, id, url, payload, digest, head_uid): head_uid names the response
    that a revisit refers to, null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    staged = materialise(df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    ), "warc-captures")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    heads = materialise(
        staged.filter(F.col("bytes") >= min_revisit).groupBy("digest")
        .agg(F.min(order).alias("head"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", F.col("head.uid").alias("head")),
        "warc-heads",
    )
    # Few heads travel to all tasks; many meet the captures in a shuffle, where a
    # digest with many copies can be split, as both sides are stored tables.
    if heads.count() <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    return staged.join(heads, "digest", "left").select(
        "uid", "id", "url", "payload", "digest",
        F.when(F.col("head") != F.col("uid"), F.col("head")).alias("head_uid"),
    )


def write_archives(staged: DataFrame, path: str, date: str = DATE) -> None:
    """Write the captures of `stage_captures` as archives in a new folder."""
    seed = path.rsplit("/", 1)[-1]
    uid = F.col("uid")
    response_id, request_id = _record_id(seed, uid, "response"), _record_id(seed, uid, "request")
    escaped = F.col("url")
    for code in (*range(0x21), 0x7F):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), escaped).otherwise(F.col("url"))
    first = F.col("head_uid").isNull()
    body = F.when(first, F.col("payload")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(_CRLF + _CRLF))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", request_id), *common,
        ("WARC-Concurrent-To", response_id),
        ("Content-Type", F.lit("application/http;msgtype=request")),
    ], F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record([
        ("WARC-Type", F.when(first, "response").otherwise("revisit")),
        ("WARC-Record-ID", response_id), *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(~first, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(~first, _record_id(seed, F.col("head_uid"), "response"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.concat(head, body))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id(seed, uid, "metadata")),
        *common, ("WARC-Concurrent-To", response_id),
        ("Content-Type", F.lit("application/warc-fields")),
    ], F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit(_CRLF)), F.lit("")))
    (staged.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("compression", "gzip").option("lineSep", "\n")
     .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path))


def _fields(lines: list[bytes]) -> dict[str, list[str]]:
    """Header fields by lower-case name; a line that starts with a blank continues."""
    out: dict[str, list[str]] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last is not None:
            last[-1] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = out.setdefault(name.strip().lower(), [])
        last.append(value.strip())
    return out


def _header(stream) -> dict[str, list[str]] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {line[:40]!r}")
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line.rstrip(b"\r\n"))
    return _fields(lines)


def parse_records(content: bytes) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA from one archive, gzip or plain."""
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    while (header := _header(stream)) is not None:
        one = lambda name: header.get(name, [None])[0]
        length = int(one("content-length") or 0)
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("archive ends inside a record")
        kind = (one("content-type") or "").lower()
        fields: dict[str, list[str]] = {}
        payload = block
        if kind.startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            fields = _fields(head.split(b"\r\n")[1:])
        elif kind.startswith("application/warc-fields"):
            fields, payload = _fields(block.splitlines()), b""
        digest = one("warc-payload-digest")
        yield (
            one("warc-record-id"), one("warc-type"), header.get("warc-concurrent-to", []),
            one("warc-refers-to"), one("warc-target-uri"), one("warc-date"),
            digest, {k: v[0] for k, v in fields.items()}, payload,
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, one row each."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for row in parse_records(bytes(content)):
                    rows.append(row)
                    held += len(row[-1]) + 500
                    if held >= _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, RECORD_SCHEMA)


RESPONSE_FIELDS = ("type", "refers_to", "digest", "fields", "payload")


def assemble(
    records: DataFrame, response_fields: Sequence[str] = RESPONSE_FIELDS,
) -> DataFrame:
    """One row per capture: (capture_id, uri, date, response, requests, metadata).

    `records` is read several times: store it first, without payloads if the
    captures are not to carry them.
    """
    primary = F.col("type").isin(*_PRIMARY)
    links = records.select("record_id", "type", "concurrent_to")
    targets = links.select("record_id", "type", F.explode("concurrent_to").alias("target"))
    # Record ids that name a capture: its response, and what the response names.
    named = links.filter(primary).select(
        F.col("record_id").alias("key"), F.col("record_id").alias("capture")
    ).unionByName(targets.filter(primary).select(
        F.col("target").alias("key"), F.col("record_id").alias("capture")))
    rest = targets.filter(~primary).select("record_id", "target").unionByName(
        links.filter(~primary).select("record_id", F.col("record_id").alias("target")))
    direct = (
        rest.join(named, rest.target == named.key, "left")
        .groupBy("record_id").agg(F.min("capture").alias("capture"))
    )
    direct = materialise(direct, "warc-direct")
    capture = _followed(direct, rest)
    side = records.filter(~primary).join(capture, "record_id")
    entry = F.struct("record_id", "uri", "date", "fields")
    sides = side.groupBy("capture").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", entry)),
                     lambda a, b: _by_id(a, b)).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", entry)),
                     lambda a, b: _by_id(a, b)).alias("metadata"),
    )
    response = records.filter(primary).select(
        "record_id", "uri", "date",
        F.struct(*response_fields).alias("response"))
    joined = response.join(sides, response.record_id == sides.capture, "full_outer")
    return joined.select(
        F.coalesce("record_id", "capture").alias("capture_id"), "uri", "date", "response",
        "requests", "metadata",
    )


def _followed(direct: DataFrame, rest: DataFrame) -> DataFrame:
    """(record_id, capture) of all records, through any number of records in
    between, either way round. Records that no response is linked to are captures
    of their own, one for each group of linked ones, named by its least id."""
    found = direct.filter("capture is not null")
    left = direct.filter("capture is null").select("record_id")
    if left.isEmpty():
        return found
    links = rest.filter("record_id <> target")
    links = materialise(links.unionByName(links.select(
        F.col("target").alias("record_id"), F.col("record_id").alias("target"))), "warc-links")
    fresh = found
    while not left.isEmpty():
        via = fresh.select(F.col("record_id").alias("target"), "capture")
        fresh = materialise(
            left.join(links, "record_id").join(via, "target").groupBy("record_id")
            .agg(F.min("capture").alias("capture")), "warc-step")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        left = materialise(left.join(fresh, "record_id", "left_anti"), "warc-left")
    alone = links.join(left, "record_id").select(
        F.col("record_id").alias("a"), F.col("target").alias("b"))
    groups = connected_components(alone).select(
        F.col("node").alias("record_id"), F.col("component").alias("capture"))
    own = left.join(groups, "record_id", "left").select(
        "record_id", F.coalesce("capture", "record_id").alias("capture"))
    return found.unionByName(own)


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["record_id"] < b["record_id"], -1).when(
        a["record_id"] > b["record_id"], 1).otherwise(0)


@query("op1_warc_transactions", sql.WARC)
def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write_archives(stage_captures(pages, "page_id", "url", "html"), path)
    records = materialise(
        read_archives(spark, path)
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload"), "warc-records")
    fields = ("type", "refers_to", "digest", "payload_bytes", "payload_sha256")
    captures = assemble(records, fields).select(
        "capture_id", F.col("response.type").alias("record_type"),
        F.col("metadata")[0]["fields"]["id"].cast("long").alias("page_id"),
        F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.payload_sha256").alias("own_digest"),
        F.substring_index("response.digest", ":", -1).alias("declared_digest"),
    )
    captures = materialise(captures, "warc-read")
    heads = captures.filter("record_type = 'response'").select(
        F.col("capture_id").alias("head_id"), F.col("page_id").alias("refers_to"),
        F.col("own_bytes").alias("head_bytes"), F.col("own_digest").alias("head_digest"))
    again = F.col("record_type") == "revisit"
    return captures.join(heads, F.col("target") == F.col("head_id"), "left").select(
        "page_id",
        F.when(again, F.col("head_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(again, F.col("head_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type", F.when(again, F.col("refers_to")).alias("refers_to"), "declared_digest",
    )
