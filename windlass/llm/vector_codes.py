"""Product codes of vectors by dual-tree Lloyd rounds.

Components become integers; a vector is cut into equal parts, and each part is
coded by the nearest entry of its position's codebook. Vectors are gathered in
chunks, and every chunk is stored once with a tree over the parts of each
position: boxes, counts and sums of its nodes. A round builds a tree over the
entries too and descends both. Of a pair of nodes, the entries go if their
least distance from the parts' box is above another pair's greatest, or if one
entry is nearer than they are all over the box. A node left with one entry is
assigned whole by its cached sum; leaves that are left with several compare
their integer parts. All comparisons are exact, so the codes are those of a
plain comparison of all parts with all entries.

A round sends one row per entry and component from a task; the driver sees the
codebooks alone (16 entries), never vectors.

Defined cases: null vectors and those with a null, NaN or infinite component
are dropped; repeated ids and rows are coded each, the smallest ids and then
components start the codebook, null ids last; fewer than 16 vectors give fewer
entries; of equal entries the first is used; vectors of another length than the
first one get null codes and errors; a length that is no multiple of the parts,
or an integer of 2**24 and more, is an error; an empty table gives no rows.
Other columns pass through (the vector is replaced by its code), clashing names
get `_` in front. Texts are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windlass.llm import sql
from windlass.llm.common import free_name, materialise, query, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LEAF = 16
CHUNK = 4096
LARGEST = 1 << 24
_STORED = "chunk binary, rest binary, rows long"


class Tree:
    """Complete binary tree over integer points, each node's box, sum and count.
    Node i has the children 2i+1 and 2i+2. `order` lists the points leaf by leaf;
    the index `len(points)` fills up the last places and does not count."""

    def __init__(self, order, lo, hi, sums, counts) -> None:
        self.order, self.lo, self.hi, self.sums, self.counts = order, lo, hi, sums, counts
        self.leaves = order.shape[0]
        self.depth = self.leaves.bit_length() - 1

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth = max(0, (-(-n // leaf) - 1).bit_length())
        leaves = 1 << depth
        size = -(-n // leaves)
        order = np.minimum(np.arange(leaves * size), n)
        padded = np.vstack([points, points[-1:]])
        for level in range(depth):
            nodes = order.reshape(1 << level, -1)
            own = padded[nodes]
            widest = (own.max(axis=1) - own.min(axis=1)).argmax(axis=1)
            keys = np.take_along_axis(own, widest[:, None, None], axis=2)[:, :, 0]
            halves = np.argpartition(keys, keys.shape[1] // 2, axis=1)
            order = np.take_along_axis(nodes, halves, axis=1)
        order = order.reshape(leaves, size)
        own, real = padded[order], (order < n)
        lo, hi = [own.min(axis=1)], [own.max(axis=1)]
        sums, counts = [(own * real[:, :, None]).sum(axis=1)], [real.sum(axis=1)]
        for _ in range(depth):
            lo.append(np.minimum(lo[-1][::2], lo[-1][1::2]))
            hi.append(np.maximum(hi[-1][::2], hi[-1][1::2]))
            sums.append(sums[-1][::2] + sums[-1][1::2])
            counts.append(counts[-1][::2] + counts[-1][1::2])
        return cls(order, *(np.concatenate(x[::-1]) for x in (lo, hi, sums, counts)))

    def arrays(self) -> list[np.ndarray]:
        return [self.order.astype(np.int32), self.lo.astype(np.int32), self.hi.astype(np.int32),
                self.sums, self.counts]


def _children(nodes: np.ndarray) -> np.ndarray:
    return np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1)


class Assignment:
    """Nearest entries of all points of a tree: nodes assigned whole, and labels
    of the points of the leaves that were not."""

    def __init__(self, tree: Tree, points: np.ndarray, entries: np.ndarray) -> None:
        self.tree, self.points, self.entries = tree, points, entries
        first = np.unique(entries, axis=0, return_index=True)[1]
        self.distinct = np.sort(first)  # an equal entry further on is never nearest
        self.book = Tree.build(entries[self.distinct], 1)
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []
        self._descend()

    def _descend(self) -> None:
        tree, book = self.tree, self.book
        node, own = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(max(tree.depth, book.depth) + 1):
            node, own = self._prune(node, own, level >= book.depth)
            if level < book.depth:
                pairs = _children(own)
                real = book.counts[pairs] > 0
                node, own = np.repeat(node[:, None], 2, axis=1)[real], pairs[real]
            if level < tree.depth:
                pairs = _children(node)
                real = tree.counts[pairs] > 0
                node, own = pairs[real], np.repeat(own[:, None], 2, axis=1)[real]
            order = np.lexsort((own, node))
            node, own = node[order], own[order]
        self._leaves(node, own)

    def _prune(self, node: np.ndarray, own: np.ndarray, single: bool) -> tuple:
        if not len(node):
            return node, own
        tree, book = self.tree, self.book
        lo, hi = tree.lo[node].astype(np.int64), tree.hi[node].astype(np.int64)
        low, high = book.lo[own], book.hi[own]
        least = (np.maximum(0, np.maximum(low - hi, lo - high)) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(hi - low), np.abs(high - lo)) ** 2).sum(axis=1)
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(start, len(node)))
        keep = least <= np.repeat(np.minimum.reduceat(most, start), size)
        if single:
            # Farther than the entry of least `most` at every corner of the box.
            order = np.lexsort((most, node))
            best = np.repeat(low[order[start]], size, axis=0)
            corner = np.where(low > best, hi, lo)
            keep &= ((corner - best) ** 2 - (corner - low) ** 2).sum(axis=1) >= 0
        node, own = node[keep], own[keep]
        if single:
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            alone = np.repeat(np.diff(np.append(start, len(node))), np.diff(
                np.append(start, len(node)))) == 1
            self.whole.append((node[alone], self._entry(own[alone])))
            node, own = node[~alone], own[~alone]
        return node, own

    def _entry(self, own: np.ndarray) -> np.ndarray:
        return self.distinct[self.book.order[own - (self.book.leaves - 1), 0]]

    def _leaves(self, node: np.ndarray, own: np.ndarray) -> None:
        tree = self.tree
        first = tree.leaves - 1
        self.open, at = np.unique(node - first, return_inverse=True)
        padded = np.vstack([self.points, self.points[-1:]])
        self.open_points = padded[tree.order[self.open]]
        far = np.iinfo(np.int64).max
        distance = np.full((len(self.open), tree.order.shape[1], len(self.entries)), far)
        entry = self._entry(own)
        distance[at, :, entry] = (
            (self.open_points[at] - self.entries[entry][:, None, :]) ** 2).sum(axis=2)
        self.labels = distance.argmin(axis=2)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of each entry."""
        sums = np.zeros(self.entries.shape, np.int64)
        counts = np.zeros(len(self.entries), np.int64)
        for node, entry in self.whole:
            np.add.at(sums, entry, self.tree.sums[node])
            np.add.at(counts, entry, self.tree.counts[node])
        real = self.tree.order[self.open] < len(self.points)
        np.add.at(sums, self.labels[real], self.open_points[real])
        np.add.at(counts, self.labels[real], 1)
        return sums, counts

    def codes(self) -> np.ndarray:
        """The entry of each point."""
        tree = self.tree
        placed = np.zeros(tree.order.shape, np.int64)
        for node, entry in self.whole:
            level = np.frexp(node + 1)[1] - 1
            width = tree.leaves >> level
            leaf = (node + 1 - (1 << level)) * width
            for a, w, e in zip(leaf, width, entry):
                placed[a:a + w] = e
        placed[self.open] = self.labels
        out = np.zeros(len(self.points) + 1, np.int64)
        out[tree.order] = placed
        return out[:-1]


def pack(points: np.ndarray) -> bytes:
    """A chunk's points with the trees of all positions."""
    out = io.BytesIO()
    arrays = {"points": points.astype(np.int32)}
    for part, own in enumerate(np.split(points, PARTS, axis=1)):
        for k, a in enumerate(Tree.build(own, LEAF).arrays()):
            arrays[f"{part}_{k}"] = a
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> list[tuple[Tree, np.ndarray]]:
    held = np.load(io.BytesIO(data))
    points = np.split(held["points"].astype(np.int64), PARTS, axis=1)
    return [(Tree(*(held[f"{p}_{k}"] for k in range(5))), points[p]) for p in range(PARTS)]


def _ipc(data: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


def _gather(vector: str, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            data = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lengths = pc.list_value_length(data[vector]).to_numpy()
            for fits in (True, False):
                own = data.filter(pa.array((lengths == dims) == fits))
                if not own.num_rows:
                    continue
                chunk = None
                if fits:
                    flat = own[vector].combine_chunks().flatten().to_numpy()
                    points = np.floor(flat.astype(np.float64) * SCALE)
                    if len(points) and np.abs(points).max() >= LARGEST:
                        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
                    chunk = pack(points.astype(np.int64).reshape(-1, dims))
                rest = _ipc(own.drop_columns([vector]))
                yield pa.record_batch(
                    [pa.array([chunk], pa.binary()), pa.array([rest], pa.binary()),
                     pa.array([own.num_rows], pa.int64())], names=["chunk", "rest", "rows"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from flush()
        if held:
            yield from flush()

    return run


def _round(books: np.ndarray) -> Callable:
    """Chunks to one row (part, entry, at, n, total) per entry and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for chunk in batch.column(0):
                if not chunk.is_valid:
                    continue
                for part, (tree, points) in enumerate(unpack(chunk.as_py())):
                    own = Assignment(tree, points, books[part]).totals()
                    sums[part] += own[0]
                    counts[part] += own[1]
        part, entry, at = (x.ravel() for x in np.indices(books.shape))
        yield pa.record_batch(
            [pa.array(x) for x in (part, entry, at, counts[part, entry], sums.ravel())],
            names=["part", "entry", "at", "n", "total"])

    return run


def _code(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rest in zip(batch.column(0), batch.column(1)):
                data = pa.ipc.open_stream(rest.as_py()).read_all().combine_chunks()
                if chunk.is_valid:
                    codes, error = [], 0
                    for part, (tree, points) in enumerate(unpack(chunk.as_py())):
                        own = Assignment(tree, points, books[part]).codes()
                        error = error + ((points - books[part][own]) ** 2).sum(axis=1)
                        codes.append(own)
                    digits = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
                    added = [pa.array(digits), pa.array(error, pa.int64())]
                else:
                    added = [pa.nulls(len(data), t) for t in (pa.string(), pa.int64())]
                columns = [c.combine_chunks() for c in data.columns] + added
                yield pa.record_batch(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def seeds(kept: DataFrame, id_column: str, vector: str, entries: int) -> np.ndarray:
    """Integer vectors of the smallest ids, of the first one's length."""
    order = [F.col(id_column).asc_nulls_last(), F.col(vector).asc()]
    rows = [r[0] for r in kept.orderBy(*order).limit(entries).select(vector).collect()]
    if rows and any(len(r) != len(rows[0]) for r in rows):
        same = kept.filter(F.size(vector) == len(rows[0]))
        rows = [r[0] for r in same.orderBy(*order).limit(entries).select(vector).collect()]
    values = np.array(rows, np.float64).reshape(len(rows), len(rows[0]) if rows else 0)
    return np.floor(values * SCALE).astype(np.int64)


def compress(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """The table with `code` (two hex digits a part) and `error` in the vector's
    place, and the codebooks by part, entry and component. At most 256 entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = df.filter(F.col(vector).isNotNull() & finite)
    start = seeds(kept.select(id_column, vector), id_column, vector, entries)
    dims = start.shape[1]
    if dims % PARTS:
        raise ValueError(f"{dims} components cannot be cut into {PARTS} equal parts")
    rest = [f for f in df.schema.fields if f.name != vector]
    names = [free_name(df.drop(vector), n) for n in ("code", "error")]
    # Positions stand for names, which may clash in other cases.
    numbered = [F.col(f.name).alias(f"c{k}") for k, f in enumerate(rest)]
    schema = T.StructType(
        [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(rest)]
        + [T.StructField(f"c{len(rest)}", T.StringType()),
           T.StructField(f"c{len(rest) + 1}", T.LongType())])
    final = [F.col(f"c{k}").alias(n) for k, n in enumerate([f.name for f in rest] + names)]
    chunks = materialise(
        kept.select(*numbered, F.col(vector).alias("v")).mapInArrow(_gather("v", dims), _STORED),
        "vector-chunks", row_check=1)
    books = np.stack(np.split(start, PARTS, axis=1))
    for _ in range(rounds if len(start) else 0):
        rows = (
            chunks.select("chunk").mapInArrow(
                _round(books), "part long, entry long, at long, n long, total long")
            .groupBy("part", "entry", "at").agg(
                F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
            .filter("n > 0").collect())
        for r in rows:
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    coded = chunks.select("chunk", "rest").mapInArrow(_code(books), schema)
    return coded.select(*final), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@query("op12_vector_codes", sql.vector_codes(PARTS, ENTRIES, ROUNDS, SCALE))
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = compress(vectors)
    coded = materialise(coded, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
