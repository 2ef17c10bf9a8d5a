"""Benchmark decontamination: short test items inside long documents.

Containment search with size-partitioned MinHash sketches. A document's size
class is the power of two above its number of distinct word shingles, and all
documents of a class have signatures of the same size: the hash range is cut
into bins, and the smallest hash of each is kept. Items are partitioned by size
too. For an item class the bins are as few as its smallest items allow: an item
at the threshold shares so many shingles with a document that one of them is
the smallest of its bin with a chance of `RECALL` (`bin_shift`). Long items are
found with a signature of a tenth of the document, items of one shingle need
nearly all of it.

Signatures meet item shingles in a join on (item class, hash); what meets is a
candidate. Texts are named by a digest, so copies are one candidate, and only
texts with candidates are read again: exact shingles must then reach the
threshold. Items never travel to the driver, nor to all tasks unless Spark
finds their table small.

Defined cases: words are lower-cased; an item of one to four words is one
shingle of all its words, looked for as such a run; items without words are
never found, null texts have none; items with a null id or equal texts are
items like others; a document row that is repeated is reported each time; texts
of any length are searched whole; a table without rows gives none, and without
items all documents stay. Columns other than the id and the text do not enter;
`without_items` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import sql
from windlass.llm.common import free_name, materialise, query, table
from windlass.llm.shingles import WIDTH, WORDS, shingle_hashes

THRESHOLD = 0.8
RECALL = 0.9999
# Items whose exact shingles are compared with a text at a time.
VERIFY_ITEMS = 500


def item_class(shingles: int) -> int:
    """Power of two at or below a number of shingles."""
    return max(shingles, 1).bit_length() - 1


def bin_shift(item_bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Bins of a document class for an item class, as a power of two below the
    class's size (negative: above it). A shingle is the smallest of its bin with
    chance r (1 - exp(-1/r)) at r bins a shingle; one of those that the smallest
    item of the class must share has to be, with chance `recall`."""
    shared = max(1, int(np.ceil(threshold * (1 << item_bits) - 1e-9)))
    for shift in range(8, -12, -1):
        r = 2.0 ** -shift
        if (1 - r * (1 - np.exp(-1 / r))) ** shared <= 1 - recall:
            return shift
    return -12


def signature(hashes: np.ndarray, shift: int) -> np.ndarray:
    """The smallest of ascending hashes in each bin of their size class."""
    if not len(hashes):
        return hashes
    bits = min(63, max(4, (len(hashes) - 1).bit_length() - shift))
    bins = hashes >> np.uint64(64 - bits)
    return hashes[np.concatenate(([True], bins[1:] != bins[:-1]))]


def _signed(kinds: list[tuple[int, int, int]]) -> Callable:
    """(fp, text) to (fp, kind, hash): signatures for each kind of item, which
    is a width of shingles and a shift of the bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, texts = batch.column(0), batch.column(1).to_pylist()
            rows, of, values = [], [], []
            for at, text in enumerate(texts):
                words = WORDS((text or "").lower())
                own: dict[int, np.ndarray] = {}
                for kind, width, shift in kinds:
                    if width not in own:
                        own[width] = np.unique(shingle_hashes(words, width))
                    kept = signature(own[width], shift)
                    values.append(kept)
                    rows.append(np.full(len(kept), at))
                    of.append(np.full(len(kept), kind, np.int32))
            if not values:
                continue
            at = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.record_batch(
                [fps.take(at), pa.array(np.concatenate(of).astype(np.int32)),
                 pa.array(np.concatenate(values).astype(np.uint64).view(np.int64))],
                names=["fp", "kind", "hash"])

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_fp, text) to (item_fp, width, bits, hash), all of an item's shingles."""
    for batch in batches:
        fps, rows, values, widths, bits = batch.column(0), [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            words = WORDS((text or "").lower())
            if not words:
                continue
            width = min(WIDTH, len(words))
            own = np.unique(shingle_hashes(words, width))
            rows.append(np.full(len(own), at))
            widths.append(np.full(len(own), width))
            bits.append(np.full(len(own), item_class(len(own))))
            values.append(own)
        if values:
            yield pa.record_batch(
                [fps.take(pa.array(np.concatenate(rows).astype(np.int64))),
                 pa.array(np.concatenate(widths).astype(np.int32)),
                 pa.array(np.concatenate(bits).astype(np.int32)),
                 pa.array(np.concatenate(values).view(np.int64))],
                names=["item_fp", "width", "bits", "hash"])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256))


def shared_shingles(text: str, items: list[str]) -> list[tuple[int, float]]:
    """(number of an item's shingles that the text has, their share) per item."""
    words = WORDS(text.lower())
    own: dict[int, set] = {}
    out = []
    for item in items:
        need = WORDS(item.lower())
        width = min(WIDTH, len(need))
        if width not in own:
            own[width] = set(zip(*(words[k:] for k in range(width))))
        wanted = set(zip(*(need[k:] for k in range(width))))
        shared = len(wanted & own[width])
        out.append((shared, shared / len(wanted)))
    return out


def item_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """(fp, item_fp, shared, containment): texts and items by digest, each once."""
    listed = items.select(F.col(item_text).cast("string").alias("text")).filter(
        "text is not null").distinct().select(_digest(F.col("text")).alias("item_fp"), "text")
    listed = materialise(listed, "items")
    shingles = materialise(
        listed.mapInArrow(_item_shingles, "item_fp binary, width int, bits int, hash long"),
        "item-shingles")
    # Size classes: at most WIDTH times the bits of a number.
    kinds = {(r["width"], r["bits"]) for r in shingles.select("width", "bits").distinct().collect()}
    shifts = [(width * 64 + bits, width, bin_shift(bits, threshold, recall))
              for width, bits in sorted(kinds)]
    read = docs.select(_digest(F.col(text)).alias("fp"), F.col(text).cast("string").alias("text"))
    signed = read.mapInArrow(_signed(shifts), "fp binary, kind int, hash long")
    wanted = shingles.select(
        "item_fp", (F.col("width") * 64 + F.col("bits")).alias("kind"), "hash")
    candidates = materialise(
        signed.join(wanted, ["kind", "hash"]).select("fp", "item_fp").distinct(),
        "item-candidates")
    sizes = candidates.groupBy("fp").agg(F.ceil(F.count("*") / VERIFY_ITEMS).alias("parts"))
    parted = (
        candidates.join(sizes, "fp").join(listed, "item_fp")
        .groupBy("fp", F.pmod(F.xxhash64("item_fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("item_fp", F.col("text").alias("item"))).alias("items")))
    met = read.join(parted, "fp").dropDuplicates(["fp", "part"])

    @F.pandas_udf("array<struct<shared:bigint,containment:double>>")
    def verify(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([
            [{"shared": n, "containment": share} for n, share in shared_shingles(t, list(own))]
            for t, own in zip(texts, wanted)], dtype=object)

    found = met.select(
        "fp", F.inline(F.arrays_zip("items", verify("text", F.col("items.item")).alias("v"))))
    return materialise(
        found.select("fp", "items.item_fp", "v.shared", "v.containment")
        .filter(F.col("containment") >= threshold), "item-hits")


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, item_id, shared, containment) of every item found in a document."""
    hits = item_hits(docs, items, text, "text", threshold, recall)
    ids = items.filter("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), _digest(F.col("text")).alias("item_fp"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest(F.col(text)).alias("fp"))
    return rows.join(hits, "fp").join(ids, "item_fp").select(
        F.col("doc_id").alias(doc_id), "item_id", "shared", "containment")


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    fp = free_name(docs, "fp")
    found = item_hits(docs, items, text, "text", threshold).select(F.col("fp").alias(fp)).distinct()
    return docs.withColumn(fp, _digest(F.col(text))).join(found, fp, "left_anti").select(*docs.columns)


@query("op10_decontamination", sql.DECONTAMINATION)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
