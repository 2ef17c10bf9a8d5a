"""The rating run: order, pools, fold, and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.operators.ordering import race_order
from windlass.operators.rating_fold import (
    final_state, fold_ratings, rateable, skip_seen,
)
from windlass.operators.rating_kernel import FoldOptions
from windlass.plans.unify import match_women, pool_name, womens_regattas
from windlass.session import cut_alone, cut_lineage


# What the run reads of a fleet entry and of a team race member.
FLEET_COLUMNS = ["regatta", "race", "date", "race_no", "div", "pos", "key", "gender", "score"]
MEMBER_COLUMNS = ["regatta", "race", "date", "race_no", "side", "pos", "key", "gender", "outcome"]


def ordered_log(fleet: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(regatta, race, seq, regatta_seq) over fleet races and matches together."""
    cols = ["regatta", "race", "date", "race_no", "div"]
    log = fleet.select(*cols)
    if members is not None:
        log = log.unionByName(
            members.select(*cols[:-1]).withColumn("div", F.lit(None).cast("string"))
        )
    return race_order(log)


def fleet_rows(fleet: DataFrame, order: DataFrame) -> DataFrame:
    """Fleet entries as fold input; rows without a score are left out."""
    placed = fleet.join(order.select("regatta", "race", "seq"), ["regatta", "race"]).join(
        womens_regattas(fleet), "regatta"
    )
    return rateable(placed, pool_name(F.col("womens"), False, F.col("pos")), F.col("score"))


def match_rows(members: DataFrame, order: DataFrame) -> DataFrame:
    """Team race members as fold input: rank 1 for a win, else 2, so any
    outcome pair other than win/lose is a tie."""
    placed = members.join(order.select("regatta", "race", "seq"), ["regatta", "race"]).join(
        cut_lineage(match_women(members).select("regatta", "womens")), "regatta"
    )
    return rateable(
        placed, pool_name(F.col("womens"), True, F.col("pos")),
        F.when(F.col("outcome") == "win", 1).otherwise(2),
        team=F.when(F.col("side") == "A", 1).otherwise(2),
    )


def rate_log(
    fleet: DataFrame, members: DataFrame | None = None, order: DataFrame | None = None,
    options: FoldOptions | None = None, state: DataFrame | None = None,
    already: DataFrame | None = None, stored: bool = False,
) -> DataFrame:
    """Rated rows of fleet and team races in all eight pools, as a table if `stored`.

    For an incremental run give the stored `state` and the `already` rated
    rows: races seen before are skipped, so a repeated run changes nothing.
    """
    if order is None:
        order = cut_alone(fleet.sparkSession, lambda: ordered_log(fleet, members))
    rows = fleet_rows(fleet, order)
    if members is not None:
        rows = rows.unionByName(match_rows(members, order))
    if already is not None:
        rows = skip_seen(rows, already)
    return fold_ratings(rows, options, state, stored=stored)


__all__ = ["final_state", "fleet_rows", "match_rows", "ordered_log", "rate_log"]
