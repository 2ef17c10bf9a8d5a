"""Uniform shuffle into shards of exact size, by a communication matrix.

Rows are permuted inside their input blocks, the counts that go from each
block to each bucket are drawn from the multivariate hypergeometric law that a
uniform permutation has, row ranges of the permuted blocks are exchanged by
those counts, and each bucket is permuted again. A shard is a run of buckets,
so a large shard is never one task. Shard sizes differ by one row at most
(law `rows`).

Everything is a DataFrame expression. The matrix is drawn by halving the
bucket range: each step splits a node's per-block counts in two with one
hypergeometric draw per block, by inversion from the mode outwards.

Defined cases: null texts count as empty and have CRC 0; repeated and equal
rows are separate rows; a text of any length is one row and is not looked into;
an empty table gives no rows; other columns stay,
and clashing names get `_` in front.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlass.llm.common import free_name, materialise, query, table, text_or_empty

SHARDS = 8
SEED = 20_240_607
# Rows one task permutes at the end; more rows make more buckets.
BUCKET_ROWS = 1_000_000
# Blocks of the matrix. Input partitions above this are merged without a shuffle.
MAX_BLOCKS = 2_048
# Above this many matrix cells, rows meet their block's runs in a shuffle join.
BROADCAST_CELLS = 500_000


def _uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0 ** -53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Good items among `draws` out of `total`, of which `good` are good.

    Inversion of `u` along the probabilities around the mode, in units of the
    probability at the mode, out to ten standard deviations (the rest weighs
    less than 1e-20).
    """
    t, k, n = (c.cast("double") for c in (total, good, draws))
    low = F.greatest(F.lit(0.0), n + k - t)
    high = F.least(n, k)
    mode = F.greatest(low, F.least(high, F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")))
    safe = F.greatest(t, F.lit(2.0))
    spread = F.sqrt(n * (k / safe) * (1 - k / safe) * (safe - n) / (safe - 1))
    width = F.ceil(spread * 10 + 20).cast("int")

    def up(x: Column) -> Column:
        return (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))

    def down(x: Column) -> Column:
        return x * (t - k - n + x) / ((k - x + 1) * (n - x + 1))

    def ratio(inside: Column, value: Column) -> Column:
        return F.when(inside, value).otherwise(F.lit(0.0))

    steps = F.sequence(F.lit(1), width)
    mass = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct(
            (s["a"] * ratio(mode + i <= high, up(mode + i - 1))).alias("a"),
            (s["b"] * ratio(mode - i >= low, down(mode - i + 1))).alias("b"),
            (s["sum"] + s["a"] * ratio(mode + i <= high, up(mode + i - 1))
             + s["b"] * ratio(mode - i >= low, down(mode - i + 1))).alias("sum"),
        ),
        lambda s: s["sum"],
    )

    def step(s: Column, i: Column) -> Column:
        a = s["a"] * ratio(mode + i <= high, up(mode + i - 1))
        b = s["b"] * ratio(mode - i >= low, down(mode - i + 1))
        left = s["left"]
        return F.struct(
            a.alias("a"), b.alias("b"), (left - a - b).alias("left"),
            F.when(left <= 0, s["at"]).when((left <= a), mode + i)
            .when((left <= a + b), mode - i).otherwise(s["at"]).alias("at"),
        )

    drawn = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"),
                 (u * mass - 1.0).alias("left"), mode.alias("at")),
        step, lambda s: s["at"],
    )
    return drawn.cast("long")


def _split(counts: Column, left_size: Column, node: Column, seed: int) -> Column:
    """Per-block counts that go to the left half, which holds `left_size` rows."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)

    def step(s: Column, i: Column) -> Column:
        have = F.element_at(counts, i + 1)
        u = _uniform(F.lit(seed), node, i)
        take = hypergeometric(s["rest"], s["want"], have, u)
        return F.struct(
            (s["rest"] - have).alias("rest"), (s["want"] - take).alias("want"),
            F.concat(s["out"], F.array(take)).alias("out"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(counts) - 1),
        F.struct(total.alias("rest"), left_size.cast("long").alias("want"),
                 F.array().cast("array<bigint>").alias("out")),
        step, lambda s: s["out"],
    )


def communication_matrix(
    blocks: DataFrame, shards: int, rows: int, per_shard: int, seed: int = SEED,
) -> DataFrame:
    """(bucket, shard, size, counts by block), from one row per (block, n).

    Bucket b of a shard has floor or ceiling of its even share of that shard.
    """
    buckets = shards * per_shard
    listed = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("l"))
    counts = F.transform("l", lambda x: x["n"].cast("long"))

    def rows_before(b: Column) -> Column:
        """Rows in the buckets before b."""
        shard, inner = F.floor(b / per_shard), b % per_shard
        here = F.floor((F.lit(rows) + F.lit(shards) - 1 - shard) / shards)
        before = shard * F.floor(F.lit(rows) / shards) + F.least(shard, F.lit(rows % shards))
        return before + F.floor(inner * here / per_shard)

    nodes = listed.select(
        F.lit(0).cast("long").alias("low"), F.lit(buckets).cast("long").alias("high"),
        counts.alias("counts"),
    )
    for level in range((buckets - 1).bit_length()):
        mid = F.floor((F.col("low") + F.col("high")) / 2)
        single = F.col("high") - F.col("low") == 1
        size = F.when(single, rows_before(F.col("high")) - rows_before(F.col("low"))).otherwise(
            rows_before(mid) - rows_before(F.col("low")))
        node = F.col("low") * (buckets + 1) + F.col("high")
        parts = nodes.withColumn("mid", mid).withColumn(
            "left", F.when(single, F.col("counts")).otherwise(
                _split(F.col("counts"), size, node, seed)))
        left = F.struct("low", F.when(single, F.col("high")).otherwise(F.col("mid")).alias("high"),
                        F.col("left").alias("counts"))
        right = F.struct(F.col("mid").alias("low"), "high", F.zip_with(
            "counts", "left", lambda a, b: a - b).alias("counts"))
        nodes = parts.select(F.explode(
            F.when(single, F.array(left)).otherwise(F.array(left, right))).alias("x")
        ).select("x.low", "x.high", "x.counts")
        if level in (3, 7):  # more nodes than a task should draw
            nodes = nodes.repartition("low")
    return nodes.select(
        F.col("low").alias("bucket"), F.floor(F.col("low") / per_shard).alias("shard"),
        (rows_before(F.col("high")) - rows_before(F.col("low"))).alias("size"), "counts",
    )


def shuffle_into_shards(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All rows of `df` in uniform order: adds `shard` and `slot` (0, 1, ...
    in each shard). The order depends on the seed and the input partitions."""
    names = {n: free_name(df, n) for n in ("shard", "slot", "block", "place", "bucket", "first",
                                          "key1", "runs")}
    block, place, bucket = (F.col(names[n]) for n in ("block", "place", "bucket"))
    pieces = df.coalesce(MAX_BLOCKS)
    stamped = pieces.withColumn(names["block"], F.spark_partition_id()).withColumn(
        names["place"], F.monotonically_increasing_id())
    # Permute locally: sorting inside the partition moves nothing between tasks.
    local = (
        stamped.withColumn(names["key1"], F.xxhash64(F.lit(seed), place))
        .sortWithinPartitions(names["key1"], names["place"])
        .withColumn(names["place"], F.monotonically_increasing_id()
                    .bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(names["key1"])
    )
    local = materialise(local, "shard-blocks")
    blocks = local.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    rows, block_count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not rows:
        return local.drop(names["block"], names["place"]).withColumns(
            {names["shard"]: F.lit(0), names["slot"]: F.lit(0).cast("long")})
    per_shard = max(1, -(-rows // (shards * bucket_rows)))
    cells = block_count * shards * per_shard
    matrix = materialise(
        communication_matrix(blocks, shards, rows, per_shard, seed)
        .select("bucket", "shard", "size", F.posexplode("counts").alias("rank", "count")),
        "shard-matrix",
    )
    ranks = blocks.agg(F.sort_array(F.collect_list("block")).alias("l")).select(
        F.posexplode("l").alias("rank", "block"))
    # Where each bucket's run starts in the permuted block; at most MAX_BLOCKS ranks.
    runs = matrix.join(F.broadcast(ranks), "rank").withColumn(
        "start", F.sum("count").over(Window.partitionBy("block").orderBy("bucket")) - F.col("count"))
    # In chunks, so that a row's bucket is found in two short scans.
    chunk = math.isqrt(shards * per_shard - 1) + 1
    listed = F.sort_array(F.collect_list(F.struct("bucket", "start")))
    per_block = runs.groupBy("block").agg(listed.alias("all")).select(
        F.col("block").alias(names["first"]),
        F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / chunk).cast("int")),
                    lambda c: F.slice("all", c * chunk + 1, chunk)).alias(names["runs"]),
    )
    if cells <= BROADCAST_CELLS:
        per_block = F.broadcast(per_block)
    placed = local.join(per_block, block == F.col(names["first"])).drop(names["first"])

    def last_started(runs: Column, start: Callable[[Column], Column]) -> Column:
        """Index of the last run that starts at or before the row's place."""
        return F.aggregate(
            runs, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")),
            lambda s, r: F.struct((s["i"] + 1).alias("i"), F.when(
                start(r) <= place, s["i"] + 1).otherwise(s["at"]).alias("at")),
            lambda s: s["at"],
        )

    own_runs = F.col(names["runs"])
    outer = F.element_at(own_runs, last_started(own_runs, lambda c: c[0]["start"]))
    found = F.element_at(outer, last_started(outer, lambda r: r["start"]))["bucket"]
    return _permute_buckets(placed.withColumn(names["bucket"], found).drop(names["runs"]),
                            names, bucket, place, block, rows, shards, per_shard, seed)


def _permute_buckets(placed, names, bucket, place, block, rows, shards, per_shard, seed):
    order = Window.partitionBy(bucket).orderBy(
        F.xxhash64(F.lit(seed + 1), block, place), block, place)
    shard = F.floor(bucket / per_shard)
    here = F.floor((F.lit(rows) + F.lit(shards) - 1 - shard) / shards)
    offset = F.floor((bucket % per_shard) * here / per_shard)
    return (
        placed.withColumn(names["slot"], (F.row_number().over(order) - 1 + offset).cast("long"))
        .withColumn(names["shard"], shard.cast("int"))
        .drop(names["block"], names["place"], names["bucket"])
    )


@query("op3_shuffle_shards")
def op3_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty()
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shuffle_into_shards(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
