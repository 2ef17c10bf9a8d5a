"""Races and wins of sailors against everyone they met, by season.

For chosen sailors only pairs (chosen sailor, rival) are formed, never all pairs of a race: the
work is (chosen sailors in a race) x (its field). The field of a large race
is spread over `parts` salted groups, and counts combine before the shuffle.
For all sailors (`fleet_everyone`, `match_everyone`) blocks of races count
their pairs themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators.groups import hot_groups
from windlass.session import cut_lineage

FIELD_PART_ROWS = 100_000


def _met(
    own: DataFrame, field: DataFrame, race_keys: list[str], part_rows: int
) -> DataFrame:
    if hot_groups(field.select(*race_keys), race_keys, part_rows) is None:
        return own.join(field, race_keys)
    parts = field.groupBy(*race_keys).agg(
        F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")
    )
    salted = field.join(parts, race_keys).withColumn(
        "_part", F.pmod(F.xxhash64("rival"), F.col("_parts"))
    ).drop("_parts")
    spread = own.join(parts, race_keys).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1).cast("array<bigint>"))
    ).drop("_parts")
    return spread.join(salted, [*race_keys, "_part"])


def _totals(pairs: DataFrame, won: Column) -> DataFrame:
    return pairs.groupBy("key", "pos", "rival", "season").agg(
        F.count("*").alias("races"), F.count_if(won).alias("wins")
    )


def fleet_head_to_head(
    entries: DataFrame, focus: DataFrame, race_keys: Sequence[str],
    part_rows: int = FIELD_PART_ROWS,
) -> DataFrame:
    """entries: race_keys.., pos, season, key, score. focus: key."""
    race_keys = list(race_keys)
    own = entries.join(focus.select("key").distinct(), "key", "left_semi").select(
        *race_keys, "season", "key", "score"
    )
    field = entries.select(
        *race_keys, F.col("key").alias("rival"), F.col("score").alias("rival_score")
    )
    pairs = _met(own, field, race_keys, part_rows).filter(F.col("rival") != F.col("key"))
    return _totals(pairs, F.col("rival_score") > F.col("score"))


def match_head_to_head(
    members: DataFrame, focus: DataFrame, match_keys: Sequence[str],
    part_rows: int = FIELD_PART_ROWS,
) -> DataFrame:
    """members: match_keys.., pos, season, key, side ('A'/'B'), outcome."""
    match_keys = list(match_keys)
    other = F.when(F.col("side") == "A", "B").otherwise("A")
    own = members.join(focus.select("key").distinct(), "key", "left_semi").select(
        *match_keys, other.alias("side"), "season", "key", "outcome"
    )
    field = members.select(*match_keys, "side", F.col("key").alias("rival"))
    pairs = _met(own, field, [*match_keys, "side"], part_rows)
    return _totals(pairs, F.col("outcome") == "win")


def win_ratios(totals: DataFrame) -> DataFrame:
    """Season totals summed per rival, with the share of races won."""
    summed = totals.groupBy("key", "pos", "rival").agg(
        F.sum("races").alias("races"), F.sum("wins").alias("wins")
    )
    return summed.withColumn(
        "win_ratio", F.try_divide(F.col("wins").cast("double"), F.col("races"))
    )


# Rows of a task of the full count, and of one side of a race within it.
BLOCK_ROWS = 50_000
SIDE_ROWS = 2_000
_PAIRS_HELD = 2_000_000


def _pair_counts(rows: pd.DataFrame, by_score: bool) -> pd.DataFrame:
    """Counts of all (key, rival) of the races of one block: sailors of the
    block's first part of a race meet those of its second."""
    names, keys = pd.factorize(rows["key"])
    rows = rows.assign(who=names).sort_values("race_no", kind="stable")
    race = rows["race_no"].to_numpy()
    who, value = rows["who"].to_numpy().astype(np.int64), rows["value"].to_numpy(dtype=float)
    side, part = rows["side_no"].to_numpy(), rows["part"].to_numpy()
    low, high = rows["low"].iat[0], rows["high"].iat[0]
    found: list[np.ndarray] = []
    held = 0

    def combine() -> None:
        pair, races, wins = np.concatenate(found, axis=1)
        if not len(pair):
            return
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        found[:] = [np.stack([pair[first], np.add.reduceat(races[order], first),
                              np.add.reduceat(wins[order], first)])]

    starts = np.flatnonzero(np.r_[True, race[1:] != race[:-1]])
    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(race)].tolist()):
        own = np.arange(lo, hi)
        a, b = own[part[lo:hi] == low], own[part[lo:hi] == high]
        x, y = (m.ravel() for m in np.meshgrid(a, b, indexing="ij"))
        apart = (who[x] != who[y]) & ((side[x] != side[y]) if not by_score else True)
        x, y = x[apart], y[apart]
        ways = [(x, y)] if low == high else [(x, y), (y, x)]
        for one, other in ways:
            wins = value[other] > value[one] if by_score else value[one] > 0
            found.append(np.stack([who[one] << 32 | who[other], np.ones(len(one), np.int64),
                                   wins.astype(np.int64)]))
            held += len(one)
        if held > _PAIRS_HELD:
            combine()
            held = 0
    combine()
    pair, races, wins = found[0]
    return pd.DataFrame({
        "key": keys[pair >> 32], "pos": rows["pos"].iat[0], "rival": keys[pair & 0xFFFFFFFF],
        "season": rows["season"].iat[0], "races": races, "wins": wins})


def _everyone(
    rows: DataFrame, race_keys: list[str], regatta: str, by_score: bool,
    block_rows: int, side_rows: int,
) -> DataFrame:
    """Season totals of everybody against everybody they met.

    The sailor-by-race table is cut in two directions: races into blocks (a
    regatta's races together, as the same people meet in them again) and the
    field of a large race into parts, every two of which meet in one task. A
    task sums its pairs before they are shuffled and returns those that met.
    """
    race_no = F.xxhash64(*race_keys)
    # Bounded blocks of a regatta, bounded parts of a race. Few races have parts: these
    # are stored, so that the rows need not be shuffled to learn of theirs.
    blocks = cut_lineage(rows.groupBy(regatta).agg(
        F.ceil(F.count("*") / block_rows).alias("_blocks")))
    fields = hot_groups(rows, race_keys, side_rows)
    named = rows.filter(" and ".join(f"{k} is not null" for k in race_keys))
    if fields is None:
        sized = named.withColumn("_parts", F.lit(1).cast("bigint"))
    else:
        fields = cut_lineage(fields.select(
            *race_keys, F.ceil(F.col("_n") / side_rows).alias("_many")))
        sized = named.join(fields, race_keys, "left").withColumn(
            "_parts", F.coalesce("_many", F.lit(1).cast("bigint"))).drop("_many")
    placed = sized.join(blocks, regatta).select(
        "pos", "season", "key", "value", "side_no", race_no.alias("race_no"),
        F.xxhash64(regatta, F.pmod(race_no, F.col("_blocks"))).alias("block"),
        F.pmod(F.xxhash64("key"), F.col("_parts")).alias("part"), "_parts")
    met = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(
        F.least("part", j).alias("low"), F.greatest("part", j).alias("high")))
    spread = placed.select("*", F.inline(met)).drop("_parts")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return _pair_counts(group, by_score)

    return (
        spread.groupBy("block", "pos", "season", "low", "high")
        .applyInPandas(count, "key string, pos string, rival string, season string, "
                              "races bigint, wins bigint")
        .groupBy("key", "pos", "rival", "season")
        .agg(F.sum("races").alias("races"), F.sum("wins").alias("wins")))


def fleet_everyone(
    entries: DataFrame, race_keys: Sequence[str], regatta: str = "regatta",
    block_rows: int = BLOCK_ROWS, side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """entries: race_keys.., regatta, pos, season, key, score -> key, pos, rival,
    season, races, wins. The lower score wins."""
    rows = entries.filter("score is not null and key is not null").withColumns(
        {"value": F.col("score").cast("double"), "side_no": F.lit(0)})
    return _everyone(rows, list(race_keys), regatta, True, block_rows, side_rows)


def match_everyone(
    members: DataFrame, match_keys: Sequence[str], regatta: str = "regatta",
    block_rows: int = BLOCK_ROWS, side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """members: match_keys.., regatta, pos, season, key, side, outcome -> the same
    of the other side's sailors."""
    won = F.when(F.col("outcome") == "win", 1.0).otherwise(0.0)
    rows = members.filter("key is not null").withColumns(
        {"value": won, "side_no": (F.col("side") == "A").cast("int")})
    return _everyone(rows, list(match_keys), regatta, False, block_rows, side_rows)
