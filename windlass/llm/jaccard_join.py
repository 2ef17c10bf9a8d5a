"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles. Rows with equal sets are copies: one of
them stands for all. Each of `TREES` trees orders the sets by a label, a
sequence of `LABEL` minimum hashes; the sets below a node of its prefix trie
share a prefix. A set starts with its full label in every tree and its prefixes
are shortened one step at a time, always where the next node adds the fewest
sets for the chance gained, until a text at the threshold shares one of them
with the chance `RECALL`. A prefix so short that it reaches the chance in all
trees alike (`prefix_depth`) is as far as any goes; where its node has
`SMALL_NODE` sets at most it goes there at once. What is below one of a set's
nodes is a candidate for it.

Candidates are then compared exactly without a row for each pair: a set's home
is the least set in two steps over shared nodes, homes are cut into blocks of bounded
size, and every two blocks that share a node meet in one task, which counts
common shingles of all their pairs in a matrix and returns, for each set, how
many rows it is linked to and the least set it is connected to. Each two sets
meet in one pair of blocks at most, so links are counted once. Classes are the
connected components of the links.

Defined cases: a null text, or one without words, has no shingle, no link and
a class of its own; a text of one to four words is one shingle of all its
words, and texts of any length are compared whole; repeated rows are copies and linked; a class takes the smallest id of
its rows, null only if all are null, and its first row is the one with that
id, on a tie the earlier input row; an empty table gives no rows; other columns
stay, clashing names get `_` in front.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlass.llm import sql
from windlass.llm.common import free_name, held, materialise, query, table
from windlass.llm.shingles import WORDS, text_shingles
from windlass.operators.graph import connected_components

THRESHOLD = 0.8
TREES = 28
LABEL = 8
RECALL = 0.9999
# A node of the shortest prefix with so few sets is taken as it is: to look
# further down would cost more than it saves.
SMALL_NODE = 64
# Shingles in a block: bounds what one verification task holds and multiplies.
BLOCK_SHINGLES = 20_000
# Candidate sets and block pairs up to which their ids travel to every task;
# more of them meet the texts in a shuffle.
BROADCAST_ROWS = 300_000
_SEED = 0x5EED


def prefix_depth(
    trees: int = TREES, label: int = LABEL, threshold: float = THRESHOLD, recall: float = RECALL,
) -> int:
    """Longest prefix that a pair at the threshold shares in some tree with
    chance `recall`, found by shortening the full label."""
    depth = label
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shorten(
    counts: np.ndarray, depth: int, trees: int, threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> np.ndarray:
    """Prefix lengths of one set. counts[k, d] is the number of sets that share
    its prefix of length depth + d in a tree; in the trees not listed few or
    none share the one of length `depth`, which costs next to nothing there."""
    miss = np.log1p(-threshold ** np.arange(depth, depth + counts.shape[1]))
    left = (trees - len(counts)) * miss[0] + len(counts) * miss[-1] - np.log1p(-recall)
    last = counts.shape[1] - 1
    lengths = np.full(len(counts), last)

    def step(k: int) -> tuple[float, int]:
        d = lengths[k]
        return ((counts[k, d - 1] - counts[k, d]) / (miss[d] - miss[d - 1]), k)

    todo = [step(k) for k in range(len(counts))] if last else []
    heapq.heapify(todo)
    while left > 1e-9 and todo:
        _, k = heapq.heappop(todo)
        left -= miss[lengths[k]] - miss[lengths[k] - 1]
        lengths[k] -= 1
        if lengths[k]:
            heapq.heappush(todo, step(k))
    return depth + lengths


class Sketcher:
    """Fingerprint of a shingle set, its size, its shortest prefix in every tree
    and what follows it in the label, a byte a hash."""

    def __init__(self, trees: int, depth: int, label: int) -> None:
        rng = np.random.default_rng(_SEED)
        self.trees, self.depth, self.label = trees, depth, label
        self.factor = (rng.integers(1, 1 << 32, trees * label, np.uint64) | np.uint64(1)
                       ).astype(np.uint32)[:, None]
        self.shift = rng.integers(0, 1 << 32, trees * label, np.uint64).astype(np.uint32)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        high = shingles.astype(np.uint32)
        out = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 2048):
            mixed = low[at:at + 2048] * self.factor
            mixed ^= high[at:at + 2048] + self.shift
            mixed *= np.uint32(0x85EBCA6B)
            np.minimum(out, mixed.min(axis=1), out=out)
        return out

    def __call__(self, text: str | None) -> tuple[bytes | None, int, list[int], bytes | None]:
        shingles = text_shingles(WORDS(text or ""))
        if not len(shingles):
            return None, 0, [], None
        labels = self.minima(shingles).reshape(self.trees, self.label)
        keys = [xxhash.xxh3_64_intdigest(labels[k, :self.depth].tobytes(), k) - (1 << 63)
                for k in range(self.trees)]
        rest = labels[:, self.depth:].astype(np.uint8).tobytes()
        return xxhash.xxh3_128_digest(shingles.tobytes()), len(shingles), keys, rest


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every left and right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    values = np.concatenate(left + right)
    rows = np.repeat(np.arange(len(left) + len(right)),
                     [len(s) for s in left] + [len(s) for s in right])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(fresh) - 1
    # Values of one set only are common to no pair.
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    if not len(rows):
        return out
    column = np.cumsum(np.concatenate(([0], np.diff(column) != 0)))
    width = max(256, (4 << 20) // (len(left) + len(right)))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a == b:
            continue
        part = np.zeros((len(left) + len(right), width), np.float32)
        part[rows[a:b], column[a:b] - k * width] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


def verify_blocks(group: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links between the sets of two blocks, or within one: for each linked
    set, the rows it is linked to and the least set connected to it here."""
    first, second = group["low"].iat[0], group["high"].iat[0]
    sets = [text_shingles(WORDS(t)) for t in group["text"]]
    sizes = np.array([len(s) for s in sets])
    ids, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
    left = np.flatnonzero(group["block"].to_numpy() == first)
    right = left if first == second else np.flatnonzero(group["block"].to_numpy() == second)
    common = common_counts([sets[i] for i in left], [sets[i] for i in right])
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * union - 1e-6
    if first == second:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    np.add.at(links, left, linked @ copies[right])
    if first != second:
        np.add.at(links, right, linked.T @ copies[left])
    a, b = np.nonzero(linked)
    root = _least_connected(ids, left[a], right[b])
    hit = np.flatnonzero(links)
    return pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": root[hit]})


def _least_connected(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least id connected to each position by the edges (a, b)."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, new[a])
        if (new == root).all():
            return root
        root = new


def link_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    trees: int = TREES, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """All rows with class_id, n_links and is_first (the class's first row)."""
    depth = prefix_depth(trees, LABEL, threshold, recall)
    names = {n: free_name(docs, n) for n in
             ("uid", "fp", "size", "keys", "rest", "sketch", "class_id", "n_links", "is_first",
              "set_fp", "set_class", "first_uid", "set_links")}
    set_fp, set_class, first_uid, set_links = (
        F.col(names[n]) for n in ("set_fp", "set_class", "first_uid", "set_links"))

    @F.pandas_udf("fp binary, size long, keys array<bigint>, rest binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        own = held(("sketcher", trees, depth), lambda: Sketcher(trees, depth, LABEL))
        return pd.DataFrame([own(t) for t in texts], columns=["fp", "size", "keys", "rest"])

    made = docs.withColumn(names["uid"], F.monotonically_increasing_id()).withColumn(
        names["sketch"], sketch(F.col(text).cast("string")))
    staged = materialise(made.select(
        *docs.columns, names["uid"],
        *[F.col(f"{names['sketch']}.{c}").alias(names[c]) for c in ("fp", "size", "keys", "rest")],
    ), "join-texts")
    narrow = staged.select(
        F.col(names["uid"]).alias("uid"), F.col(doc_id).cast("long").alias("id"),
        F.col(names["fp"]).alias("fp"), F.col(names["size"]).alias("size"),
        F.col(names["keys"]).alias("keys"), F.col(names["rest"]).alias("rest"))
    head = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    copies = materialise(
        narrow.filter("fp is not null").groupBy("fp")
        # Copies have the same size and keys.
        .agg(F.min(head).alias("head"), F.count("*").alias("copies"),
             F.first("size").alias("size"), F.first("keys").alias("keys"),
             F.first("rest").alias("rest"))
        .withColumn("rep", F.col("head.uid")), "join-copies")
    sets = _forest(copies, depth, trees, threshold, recall)
    links = materialise(_verified(sets, copies, staged, names["uid"], text, threshold,
                                  block_shingles), "join-links")
    per_set = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(links.filter("rep <> root").select(
        F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    labelled = (
        copies.drop("size", "keys", "rest").join(classes, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep")).join(per_set, "rep", "left"))
    labelled = materialise(labelled, "join-sets")
    heads = materialise(
        labelled.groupBy("component").agg(F.min("head").alias("first")), "join-classes")
    found = materialise(labelled.join(heads, "component").select(
        F.col("fp").alias(names["set_fp"]), F.col("first.id").alias(names["set_class"]),
        F.col("first.uid").alias(names["first_uid"]),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias(names["set_links"])),
        "join-found")
    out = staged.join(found, F.col(names["fp"]) == set_fp, "left")
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.when(set_fp.isNull(), F.col(doc_id).cast("long"))
        .otherwise(set_class).alias(names["class_id"]),
        F.coalesce(set_links, F.lit(0)).cast("long").alias(names["n_links"]),
        F.coalesce(first_uid == F.col(names["uid"]), F.lit(True))
        .alias(names["is_first"]),
    )


def _forest(
    copies: DataFrame, depth: int, trees: int, threshold: float, recall: float,
) -> DataFrame:
    """(rep, key) of the sets below every node that one of them goes up to."""
    # One shuffle by key, whatever the table's size: rows of a key are counted in place.
    prefixes = copies.select("rep", F.posexplode("keys").alias("tree", "key")).withColumn(
        "tree", F.col("tree").cast("byte"))
    counted = prefixes.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    members = materialise(counted.filter("n > 1"), "join-prefix-members")
    few = members.filter(F.col("n") <= SMALL_NODE).select("rep", "key")
    width = LABEL - depth
    own = F.substring("rest", F.col("tree") * width + 1, F.lit(width))
    # The node of each length from the shortest prefix (0) to the full label.
    levels = range(width + 1)
    nodes = [F.col("key").alias("node0"), *[
        F.xxhash64("key", F.substring(own, F.lit(1), F.lit(d))).alias(f"node{d}")
        for d in levels[1:]]]
    paths = materialise(
        members.filter(F.col("n") > SMALL_NODE).join(copies.select("rep", "rest"), "rep")
        .select("rep", "tree", F.col("n").alias("n0"), *nodes), "join-paths")
    counted = paths
    for d in levels[1:]:
        sizes = paths.groupBy(f"node{d}").agg(F.count("*").alias(f"n{d}"))
        counted = counted.join(sizes, f"node{d}")
    entry = F.struct("tree", F.array(*[f"n{d}" for d in levels]).alias("n"),
                     F.array(*[f"node{d}" for d in levels]).alias("nodes"))
    per_set = counted.groupBy("rep").agg(F.collect_list(entry).alias("at"))

    @F.pandas_udf("array<bigint>")
    def chosen(counts: pd.Series) -> pd.Series:
        return pd.Series([
            shorten(np.array([list(x) for x in c], np.int64).reshape(-1, width + 1),
                    depth, trees, threshold, recall) - depth for c in counts])

    # One node per tree: the one its prefix was shortened to.
    up_to = F.arrays_zip("at.nodes", chosen("at.n").alias("d"))
    active = materialise(
        per_set.select(F.inline(up_to)).select(
            "d", F.get("nodes", F.col("d").cast("int")).alias("node")).distinct(), "join-active")
    out = few
    for d in levels:
        open_ = active.filter(F.col("d") == d).select("node")
        below = paths.select("rep", F.col(f"node{d}").alias("node"))
        out = out.unionByName(
            below.join(open_, "node", "left_semi").select("rep", F.col("node").alias("key")))
    return out


def _verified(
    sets: DataFrame, copies: DataFrame, staged: DataFrame, uid: str, text: str,
    threshold: float, block_shingles: int,
) -> DataFrame:
    """(rep, links, root) from every two blocks that share a trie node."""
    nodes = materialise(
        sets.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n"))
        .filter("n > 1").select("key", "leader"), "join-nodes")
    members = materialise(sets.join(nodes, "key"), "join-members")
    nearest = members.groupBy("rep").agg(F.min("leader").alias("home"))
    # Once more, to the least home of its nodes: fewer and fuller blocks.
    lower = members.select("key", "rep").join(nearest, "rep").groupBy("key").agg(
        F.min("home").alias("home"))
    lower = materialise(lower, "join-lower")
    homes = members.select("key", "rep").join(lower, "key").groupBy("rep").agg(
        F.min("home").alias("home"))
    homes = materialise(homes.join(copies.select("rep", "size"), "rep"), "join-homes")
    weights = materialise(homes.groupBy("home").agg(
        F.ceil(F.sum("size") / block_shingles).alias("parts")), "join-weights")
    blocks = materialise(homes.join(weights, "home").select("rep", F.xxhash64(
        "home", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")), "join-blocks")
    at_node = materialise(
        members.select("key", "rep").join(blocks, "rep").select("key", "block").distinct(),
        "join-node-blocks")
    several = at_node.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    several = at_node.join(several, "key")
    other = several.select("key", F.col("block").alias("high"))
    cross = (
        several.withColumnRenamed("block", "low").join(other, "key").filter("low < high")
        .select("low", "high"))
    own = blocks.select(F.col("block").alias("low"), F.col("block").alias("high"))
    pairs = materialise(cross.unionByName(own).distinct(), "join-pairs")
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high")))
                         .alias("block"))
    candidates = blocks.join(copies.select("rep", "copies"), "rep")
    if blocks.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    if pairs.count() <= BROADCAST_ROWS:
        sides = F.broadcast(sides)
    texts = staged.select(F.col(uid).alias("rep"), F.col(text).cast("string").alias("text"))
    met = texts.join(candidates, "rep").join(sides, "block")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        return verify_blocks(group, threshold)

    return met.groupBy("low", "high").applyInPandas(verify, "rep long, links long, root long")


@query("op5_ngram_jaccard_join", sql.JACCARD)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_texts(docs).select("doc_id", "class_id", "n_links")
