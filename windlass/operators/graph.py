"""Connected components and PageRank as iterated joins with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step (Kiveris et al., SoCC 2014)."""
    both = (
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if large
        else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
    ).filter(F.col("a") != F.col("b")).distinct()
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low")
    )
    joined = both.join(lowest, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a, b) -> (node, component); component is the least node in it."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(
        edges.select(F.col("b").alias("node"))
    ).distinct()
    current = cut_lineage(
        edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct()
    )
    previous = None
    for _ in range(max_rounds):
        current = cut_lineage(_star(_star(current, large=True), large=False))
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def page_rank(
    edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100,
    cut_every: int = 5,
) -> DataFrame:
    """edges (src, dst, weight) -> (node, rank), ranks summing to 1.

    A node without out-edges spreads its rank evenly, as the usual definition
    asks. Each round is one join and one combinable aggregate. Rounds go on
    until the ranks change by less than `tolerance` a node in sum, looked at
    every `cut_every` rounds; it is an error if they do not settle.
    """
    totals = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = cut_lineage(
        edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        .join(totals, "src")
        .select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    )
    nodes = links.select(F.col("src").alias("node")).unionByName(
        links.select(F.col("dst").alias("node"))
    ).distinct()
    sources = links.select(F.col("src").alias("node")).distinct().withColumn(
        "linked", F.lit(True)
    )
    nodes = cut_lineage(nodes.join(sources, "node", "left").select(
        "node", F.coalesce("linked", F.lit(False)).alias("linked")
    ))
    count, linked = nodes.agg(F.count("*"), F.count_if("linked")).first()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(count, 1)))
    if not count:
        return ranks.select("node", "rank")
    for i in range(max_rounds):
        before = ranks
        incoming = (
            links.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        )
        loose = F.lit(0.0)
        if linked < count:
            loose = ranks.filter(~F.col("linked")).agg(F.sum("rank")).scalar()
        base = (1.0 - alpha) / count
        ranks = nodes.join(incoming, "node", "left").select(
            "node", "linked",
            (F.lit(base) + alpha * (
                F.coalesce("inflow", F.lit(0.0)) + loose / F.lit(float(count))
            )).alias("rank"),
        )
        # With loose ends each round reads the ranks twice, so it is cut every time.
        look = (i + 1) % cut_every == 0
        if look or linked < count:
            ranks = cut_lineage(ranks)
        if look:
            change = ranks.join(before.select("node", F.col("rank").alias("old")), "node").agg(
                F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < tolerance * count:
                return ranks.select("node", "rank")
    raise RuntimeError("the ranks did not settle")
