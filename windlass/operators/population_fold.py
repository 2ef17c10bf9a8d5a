"""The ordered rating with weights from the population's running mean.

A race counts by the mean rating of its racers over the mean of everybody before
it, so every race depends on all earlier ones, also of people who never meet.
Rating one race at a time would be one task. Instead the means are found by
iteration: with the means before all races given, the races are folded in
parallel as usual; what they change, summed along the order in two levels, gives
new means. A mean moves little by one race and a race little by the mean, so
each round shrinks the error by orders; rounds go on until no mean changes by
more than `tolerance`. The order is taken in stretches, each from the state and
the mean after the last one; a stretch that does not settle in `max_rounds` is
halved, and one race needs no iteration. The result is the one of rating race
after race.

Each sailor's own spread grows inside the fold with the weeks since the last
race (`FoldOptions.weekly`).
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.operators.groups import attach
from windlass.operators.rating_fold import (
    RACE, ROW, FoldSpec, _rate_large_race, final_state, fold_ratings, plackett_luce,
)
from windlass.operators.rating_kernel import FoldOptions, fold_group
from windlass.session import cut_lineage

# Races per chunk of a running sum.
CHUNK = 100_000


def running_sum(df: DataFrame, order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Sum of `value` over all rows before this one along a dense number `order`:
    inside chunks, and over the chunks before."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    totals = rows.groupBy("_chunk").agg(F.sum(value).alias("_total"))
    # One row per chunk.
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_carry"))
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    return rows.withColumn("_own", own).join(carried, "_chunk").withColumn(
        name, F.col("_own") + F.col("_carry")).drop("_chunk", "_own", "_carry")


def population_spec(options: FoldOptions) -> FoldSpec:
    """Rows of `rateable` with mean and day; the state has each sailor's last day."""
    plain = plackett_luce(options)
    return FoldSpec(
        kernel=partial(fold_group, options=options), inputs=(*ROW, "weight", "mean", "day"),
        output=plain.output + ", day1 double",
        state={**plain.state, "last_day": (None, "day1")},
        large_race=partial(_large_race, options=options),
    )


def _large_race(rows: DataFrame, chunk_rows: int, options: FoldOptions) -> DataFrame:
    p = options.params
    weeks = F.greatest(F.floor((F.col("day") - F.col("last_day")) / 7) - 1, F.lit(0))
    grown = F.least(F.lit(p.sigma), F.col("sigma") + F.coalesce(weeks, F.lit(0)) * options.weekly * p.sigma)
    wide = rows.withColumn(
        "sigma", F.when(F.col("sigma") < p.sigma, grown).otherwise(F.col("sigma")))
    weighed = attach(wide, RACE, F.avg("mu").alias("_race_mean")).withColumn(
        "weight", F.col("_race_mean") / F.col("mean"))
    weighed = cut_lineage(weighed)
    rated = _rate_large_race(weighed, chunk_rows, options)
    return rated.join(
        weighed.select(*RACE, "line", F.col("day").alias("day1")), [*RACE, "line"])


def fold_with_population(
    rows: DataFrame, day: Column, people: DataFrame, options: FoldOptions | None = None,
    weekly: float = 0.1, tolerance: float = 1e-9, max_rounds: int = 12,
    stretch: int = 100_000, **how: int,
) -> DataFrame:
    """rows: of `rateable`, with `step`, the dense number of each race along the
    order of the whole population. people: pool, key of everybody in it."""
    options = replace(options or FoldOptions(), population=True, weekly=weekly)
    spec = population_spec(options)
    count = people.distinct().count()
    if not count:
        raise ValueError("a population without people has no mean")
    own = cut_lineage(rows.withColumn("day", day.cast("double")))
    total = (own.agg(F.max("step")).first()[0] or 0) + 1
    low, size, mean, state, parts = 0, stretch, float(options.params.mu), None, []
    while low < total:
        block = own.filter(F.col("step").between(low, low + size - 1))
        found = _settled(block, mean, count, spec, state, tolerance, max_rounds, how)
        if found is None:
            size = max(1, size // 2)
            continue
        rated, gain = found
        parts.append(rated)
        state = cut_lineage(final_state(rated, state, spec))
        mean += gain / count
        low, size = low + size, min(2 * size, stretch)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _settled(
    block: DataFrame, mean: float, count: int, spec: FoldSpec, state: DataFrame | None,
    tolerance: float, max_rounds: int, how: dict[str, int],
) -> tuple[DataFrame, float] | None:
    """(rated rows, sum of all changes) of a stretch, None if its means do not settle."""
    steps = cut_lineage(block.groupBy("step", *RACE).agg(F.count("*").alias("n")))
    means = steps.select("step", F.lit(mean).alias("mean")).distinct()
    columns = [*ROW, "weight", "mean", "day"]
    for _ in range(max_rounds):
        rated = cut_lineage(
            fold_ratings(block.join(means, "step").select(*columns), spec, state, **how))
        gains = steps.join(
            rated.groupBy(*RACE).agg(F.sum(F.col("mu1") - F.col("mu0")).alias("gain")), RACE, "left")
        summed = running_sum(
            gains.groupBy("step").agg(F.sum("gain").alias("gain")).na.fill(0.0, ["gain"]),
            "step", "gain", "sum")
        new = cut_lineage(summed.select(
            "step", "gain", (F.lit(mean) + F.col("sum") / count).alias("mean")))
        moved, gain = new.join(means.withColumnRenamed("mean", "old"), "step").agg(
            F.max(F.abs(F.col("mean") - F.col("old"))), F.sum("gain")).first()
        if moved is None:
            return rated, 0.0
        if math.isnan(moved) or math.isinf(moved):
            return None
        if moved <= tolerance:
            return rated, gain
        means = new.select("step", "mean")
    return None
