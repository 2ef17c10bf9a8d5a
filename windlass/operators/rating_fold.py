"""Ordered rating over the whole log, distributed.

Pools are independent. Small logs are one lazy plan with a group per pool.
Larger logs go by waves: a race's wave is one more than the latest wave of its
sailors, so the races of a wave never touch each other, however linked the log
is. Waves are assigned in stretches of the log side by side, one job for all.
Then a wide wave is one step over all tasks, dealt out race by race, with the
state joined to it by sailor; narrow waves go together, a task for each group
of sailors that meet. Step results and, now and then, the state are tables in
the shared folder, so nothing whole sits in one task or the driver and lost
executors only repeat their tasks. A race larger than a group is a step of its
own, rated by distributed prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.operators.classic_kernel import (
    ClassicOptions, classic_finish, classic_group, classic_partial,
)
from windlass.operators.groups import attach, hot_groups, rank_in_group
from windlass.operators.large_field import rival_sums
from windlass.operators.one_race import rate_races
from windlass.operators.rating_kernel import (
    CHANCE_DIGITS, FoldOptions, chance_partial, fold_group, waves_and_groups,
)
from windlass.session import cut_lineage, drop_scratch, scratch_path

MAX_GROUP_ROWS = 1_000_000
BUCKETS = 4096
# Rows whose waves one task assigns; it holds two numbers for each.
LEVEL_ROWS = 4_000_000
# Rows a core should get for a wave to be worth a step of its own.
WIDE_TASK_ROWS = 20_000
# A step's linked groups share tasks where none can hold more than this part of the
# largest task.
SMALL_PART = 16
# Steps after which the state is written anew.
FOLD_IN_EVERY = 8
# Files of all steps that tasks may write where they are; above it rows are dealt out
# to a few files a step first.
STEP_FILES = 5_000

ROW = ["pool", "seq", "race", "team", "line", "rank", "key"]


@dataclass(frozen=True)
class FoldSpec:
    """A rating rule: what it reads per row, keeps per sailor, and computes."""

    kernel: Callable[[pd.DataFrame], pd.DataFrame]
    inputs: tuple[str, ...]
    output: str
    # State column -> (value of a new sailor, output column that replaces it).
    state: dict[str, tuple[float | None, str]]
    # Rates one race that is larger than a group, in chunks of the given rows.
    large_race: Callable[[DataFrame, int], DataFrame]


def plackett_luce(options: FoldOptions) -> FoldSpec:
    p = options.params
    return FoldSpec(
        kernel=partial(fold_group, options=options), inputs=(*ROW, "weight"),
        output=(
            "pool string, seq bigint, race string, team bigint, line bigint, rank double, "
            "key string, mu0 double, sigma0 double, mu1 double, sigma1 double, predicted bigint"
        ),
        state={"mu": (p.mu, "mu1"), "sigma": (p.sigma, "sigma1")},
        large_race=partial(_rate_large_race, options=options),
    )


def classic(options: ClassicOptions) -> FoldSpec:
    """Elo forms and Glicko-2; rows come from `classic_rows`."""
    return FoldSpec(
        kernel=partial(classic_group, options=options),
        inputs=("pool", "seq", "race", "line", "key", "partner", "score", "result", "period"),
        output=(
            "pool string, seq bigint, race string, line bigint, key string, rating0 double, "
            "rating1 double, rd1 double, vol1 double, period1 double"
        ),
        state={
            "rating": (options.initial, "rating1"), "rd": (options.rd, "rd1"),
            "vol": (options.vol, "vol1"), "last_period": (None, "period1"),
        },
        large_race=partial(_classic_large_race, options=options),
    )


def rateable(
    entries: DataFrame, pool: Column, rank: Column, team: Column | None = None,
    line: Column | None = None, weight: Column | None = None,
) -> DataFrame:
    """Standard fold input: ranked rows. Races with a single team stay
    unrated, which the rating rule itself sees to.

    Needs columns seq, race, key. Without `team` every row is its own team.
    """
    line = F.xxhash64("key") if line is None else line
    return entries.select(
        pool.alias("pool"), "seq", "race",
        (F.xxhash64("key", line) if team is None else team.cast("bigint")).alias("team"),
        line.cast("bigint").alias("line"), rank.cast("double").alias("rank"), "key",
        (F.lit(1.0) if weight is None else weight).alias("weight"),
    ).filter("rank is not null and key is not null")


def _with_state(rows: DataFrame, state: DataFrame | None, spec: FoldSpec) -> DataFrame:
    first = {c: F.lit(v).cast("double") for c, (v, _) in spec.state.items()}
    if state is None:
        return rows.withColumns(first)
    joined = rows.join(state.select("pool", "key", *spec.state), ["pool", "key"], "left")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in first.items()})


def _rate(rows: DataFrame, groups: list[str], spec: FoldSpec, mark: bool = False) -> DataFrame:
    """`mark` adds `last`: whether a row is its sailor's latest in the group."""
    keys = [F.col(g).alias(f"_g_{g}") for g in groups]
    grouped = rows.select(*keys, *spec.inputs, *spec.state).groupBy(*[f"_g_{g}" for g in groups])
    kernel = spec.kernel

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        return out.assign(last=last_rows(out)) if mark else out

    return grouped.applyInPandas(rate, _marked(spec) if mark else spec.output)


def _marked(spec: FoldSpec) -> str:
    return f"{spec.output}, last boolean"


def last_rows(rated: pd.DataFrame) -> np.ndarray:
    """Whether each row of a pool is its sailor's latest by (seq, line)."""
    sailor, names = pd.factorize(rated["key"])
    order = np.lexsort((rated["line"].to_numpy(), rated["seq"].to_numpy()))
    latest = np.empty(len(names), dtype=np.int64)
    latest[sailor[order]] = order
    out = np.zeros(len(rated), dtype=bool)
    out[latest] = True
    return out


def final_state(
    rated: DataFrame, state: DataFrame | None = None, spec: FoldSpec | None = None
) -> DataFrame:
    """Latest rating per (pool, key); `seen` is the last race's seq."""
    spec = spec or plackett_luce(FoldOptions())
    after = rated.groupBy("pool", "key").agg(
        F.max_by(
            F.struct(*[F.col(o).alias(c) for c, (_, o) in spec.state.items()]),
            F.struct("seq", "line"),
        ).alias("_s"),
        F.max("seq").alias("seen"),
    ).select("pool", "key", "_s.*", "seen")
    if state is None:
        return after
    kept = state.join(after, ["pool", "key"], "left_anti")
    return kept.select(*after.columns).unionByName(after)


def fold_ratings(
    rows: DataFrame, options: FoldOptions | FoldSpec | None = None,
    state: DataFrame | None = None, max_group_rows: int = MAX_GROUP_ROWS, stored: bool = False,
) -> DataFrame:
    """Rate `rows` in seq order; the default rule is Plackett-Luce on rows of
    `rateable`, adding mu0, sigma0, mu1, sigma1 and the predicted place. With `stored`
    the result is a table, as that of a large log always is."""
    spec = options if isinstance(options, FoldSpec) else plackett_luce(options or FoldOptions())
    spark = rows.sparkSession
    path, schema = _stored(rows, "cut"), rows.schema
    rows = spark.read.schema(schema).parquet(path)
    biggest = rows.groupBy("pool").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest <= max_group_rows:
        rated = _rate(_with_state(rows, state, spec), ["pool"], spec)
        return cut_lineage(rated) if stored else rated
    return _fold_in_steps(rows, spec, state, max_group_rows, log_path=path)


def _bucket_counts(rows: DataFrame, low: int, high: int) -> list[tuple[int, int, int]]:
    """(first seq, last seq, rows) of at most BUCKETS equal seq ranges."""
    width = max(1, -(-(high - low + 1) // BUCKETS))
    counts = (
        rows.filter(F.col("seq").between(low, high))
        .groupBy(F.floor((F.col("seq") - low) / width).alias("b")).agg(F.count("*").alias("n"))
        .orderBy("b").collect()
    )
    return [(low + r.b * width, min(low + (r.b + 1) * width - 1, high), r.n) for r in counts]


def _stretches(
    log: DataFrame, max_group_rows: int, level_rows: int
) -> list[tuple[int, int, int]]:
    """(first seq, last seq, rows) of consecutive stretches of at most
    `level_rows`; one seq of more than `max_group_rows` is a stretch of its own."""
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    todo = _bucket_counts(log, low, high)[::-1]
    out: list[tuple[int, int, int]] = []
    closed = True
    while todo:
        first, last, size = todo.pop()
        if size > max_group_rows and last > first:
            todo.extend(_bucket_counts(log, first, last)[::-1])
            continue
        alone = size > max_group_rows
        if out and not closed and not alone and out[-1][2] + size <= level_rows:
            out[-1] = (out[-1][0], last, out[-1][2] + size)
        else:
            out.append((first, last, size))
        closed = alone
    return out


def _single_races(stretches: list[tuple[int, int, int]], max_group_rows: int) -> list[int]:
    """Numbers of the stretches that are one seq above the group size. A stretch of
    many races may hold more rows than a group; its waves are cut to size later."""
    return [k for k, (first, last, n) in enumerate(stretches)
            if first == last and n > max_group_rows]


def _stretch_of(seq: Column, firsts: list[int], low: int = 0, high: int | None = None) -> Column:
    """Number of the last of `firsts` that is not above `seq`, by halving."""
    high = len(firsts) if high is None else high
    if high - low <= 1:
        return F.lit(low)
    half = (low + high) // 2
    return F.when(seq < firsts[half], _stretch_of(seq, firsts, low, half)).otherwise(
        _stretch_of(seq, firsts, half, high))


def assign_waves(log: DataFrame, stretches: list[tuple[int, int, int]]) -> DataFrame:
    """(pool, stretch, seq, race_id, wave, linked, n) of every race.

    Stretches are looked at side by side, one task for each and pool, which
    holds two numbers a row. A race's wave is one more than the latest wave of
    its sailors in the stretch; stretches follow each other, so waves in the
    order of (stretch, wave) never need a later one. `linked` names what the
    stretch's races of a pool link together.
    """
    def levels(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seq, race_id, sailor = (rows[c].to_numpy() for c in ("seq", "race_id", "sailor"))
        order = np.lexsort((race_id, seq))
        seq, race_id, sailor = seq[order], race_id[order], sailor[order]
        new = np.r_[True, (seq[1:] != seq[:-1]) | (race_id[1:] != race_id[:-1])]
        first, race = np.flatnonzero(new), np.cumsum(new) - 1
        wave, linked = waves_and_groups(race, sailor)
        return pd.DataFrame({
            "pool": key[0], "stretch": key[1], "seq": seq[first],
            "race_id": race_id[first], "wave": wave[first],
            "linked": linked[first], "n": np.diff(np.r_[first, len(race)]),
        })

    narrow = log.select(
        "pool", _stretch_of(F.col("seq"), [first for first, _, _ in stretches]).alias("stretch"), "seq", F.xxhash64("race").alias("race_id"),
        F.xxhash64("key").alias("sailor"))
    return narrow.groupBy("pool", "stretch").applyInPandas(
        levels, "pool string, stretch int, seq long, race_id long, wave long, linked long, n long")


def cut_by_width(
    widths: list[tuple[int, int, int, int]], max_group_rows: int, wide_rows: int, most_rows: int,
) -> list[tuple[int, int, int, int]]:
    """(stretch, wave, rows, rows of the largest linked group) in order ->
    (stretch, wave, step, tasks): a wave whose largest group is wide is a step of
    its own, dealt out race by race over so many tasks (its races are
    independent); narrow waves go together, a task for each linked group (0),
    while no group can exceed `max_group_rows` and all stay below `most_rows`."""
    out, step, linked, total, now = [], -1, 0, 0, None
    for stretch, wave, rows, largest in widths:
        wide = largest >= wide_rows
        fits = linked + largest <= max_group_rows and total + rows <= most_rows
        if wide or now != stretch or not fits:
            step, linked, total = step + 1, 0, 0
        linked, total = linked + largest, total + rows
        now = None if wide else stretch
        tasks = max(1, -(-rows // max(1, wide_rows // 8))) if wide else 0
        out.append((stretch, wave, step, tasks))
    return out


def shared_tasks(
    widths: list[tuple[int, int, int, int]], plan: list[tuple[int, int, int, int]],
    max_group_rows: int, cores: int,
) -> dict[int, int]:
    """Step -> number of tasks (of each pool) that its linked groups share. Groups of
    independent races may be rated as one, and many small ones cost a call of the rule
    each and a batch for each wave. Left out: wide steps, and those with a group that
    may be large. A task then holds a quarter of `max_group_rows` on average."""
    rows: dict[int, int] = {}
    linked: dict[int, int] = {}
    for (_, _, n, largest), (_, _, step, tasks) in zip(widths, plan, strict=True):
        if not tasks:
            rows[step] = rows.get(step, 0) + n
            linked[step] = linked.get(step, 0) + largest
    return {step: max(cores, -(-4 * n // max_group_rows)) for step, n in rows.items()
            if linked[step] * SMALL_PART <= max_group_rows}


class _Ratings:
    """The state while steps are rated: a base table, and the latest ratings of each
    step after it, which are folded into the base now and then."""

    def __init__(self, spark: SparkSession, state: DataFrame | None, spec: FoldSpec) -> None:
        self.spark, self.base, self.spec = spark, state, spec
        self.recent: list[str] = []
        self.own: str | None = None

    def attach(self, rows: DataFrame) -> DataFrame:
        if not self.recent:
            return _with_state(rows, self.base, self.spec)
        names = {c: f"_new_{c}" for c in self.spec.state}
        new = self._recent().select(
            "pool", "key", *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("_new"))
        both = _with_state(rows, self.base, self.spec).join(new, ["pool", "key"], "left")
        return both.withColumns({
            c: F.when(F.col("_new"), F.col(n)).otherwise(F.col(c)) for c, n in names.items()
        }).drop("_new", *names.values())

    def _recent(self) -> DataFrame:
        """Latest ratings over the recent steps; a later step has the higher seq."""
        if len(self.recent) == 1:
            return self.spark.read.parquet(*self.recent)
        columns = [*self.spec.state, "seen"]
        latest = self.spark.read.parquet(*self.recent).groupBy("pool", "key").agg(
            F.max_by(F.struct(*columns), "seen").alias("_s"))
        return latest.select("pool", "key", "_s.*")

    def add(self, path: str, marked: bool = False) -> None:
        """`marked`: a sailor's rows were all rated by one task, which has marked the last."""
        if marked:
            rated = self.spark.read.schema(_marked(self.spec)).parquet(path).filter("last")
            latest = rated.select(
                "pool", "key", *[F.col(o).alias(c) for c, (_, o) in self.spec.state.items()],
                F.col("seq").alias("seen"))
        else:
            rated = self.spark.read.schema(self.spec.output).parquet(path)
            latest = final_state(rated, None, self.spec)
        self.recent.append(_stored(latest, "latest"))
        if len(self.recent) >= FOLD_IN_EVERY:
            state = self._recent()
            if self.base is not None:
                kept = self.base.join(state, ["pool", "key"], "left_anti")
                state = kept.unionByName(state, allowMissingColumns=True)
            old, self.own = [*self.recent, self.own], _stored(state, "state")
            self.base, self.recent = self.spark.read.parquet(self.own), []
            for path in filter(None, old):
                drop_scratch(self.spark, path)


def _fold_in_steps(
    log: DataFrame, spec: FoldSpec, state: DataFrame | None, max_group_rows: int,
    wide_rows: int | None = None, level_rows: int = LEVEL_ROWS, log_path: str | None = None,
) -> DataFrame:
    """Rate a large stored log by waves: a wide wave over all tasks, narrow ones together.
    A log at `log_path` is deleted when its rows are dealt out to the steps."""
    spark: SparkSession = log.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wide_rows = wide_rows or max(1, min(WIDE_TASK_ROWS * cores, max_group_rows // 4))
    out_path = scratch_path(spark, "fold-out")
    stretches = _stretches(log, max_group_rows, level_rows)
    alone = _single_races(stretches, max_group_rows)
    in_one_race = F.lit(False)
    for k in alone:
        in_one_race |= F.col("seq") == stretches[k][0]
    if alone:
        # A folder for each, so rating one does not read the log again.
        alone_path = scratch_path(spark, "fold-alone")
        (log.filter(in_one_race).withColumn("at", F.col("seq"))
         .write.partitionBy("at").parquet(alone_path))
    levels_path = _stored(assign_waves(log.filter(~in_one_race), stretches), "waves")
    levels = spark.read.parquet(levels_path)
    # One row per wave: as many as the longest chains of races have links.
    widths = [tuple(r) for r in (
        levels.groupBy("stretch", "wave", "pool", "linked").agg(F.sum("n").alias("n"))
        .groupBy("stretch", "wave").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        .orderBy("stretch", "wave").collect())]
    plan = cut_by_width(widths, max_group_rows, wide_rows, max_group_rows * 4 * cores)
    staged_path = scratch_path(spark, "fold-steps")
    if plan:
        shared = shared_tasks(widths, plan, max_group_rows, cores)
        steps = spark.createDataFrame(
            [(*p, shared.get(p[2], 0)) for p in plan],
            "stretch int, wave long, step long, tasks long, shared long")
        group = F.xxhash64("stretch", "linked")
        slot = (
            F.when(F.col("tasks") > 0, F.pmod(F.xxhash64("seq", "race_id"), F.col("tasks")))
            .when(F.col("shared") > 0, F.pmod(group, F.col("shared"))).otherwise(group))
        placed = levels.join(steps, ["stretch", "wave"]).select(
            "pool", "seq", "race_id", "step", slot.alias("slot"))
        staged = log.withColumn("race_id", F.xxhash64("race")).join(
            placed, ["pool", "seq", "race_id"]).drop("race_id")
        files = (plan[-1][2] + 1) * int(spark.conf.get("spark.sql.shuffle.partitions"))
        if files > STEP_FILES:
            staged = staged.repartition("step", F.pmod("slot", F.lit(cores)))
        staged.write.partitionBy("step").parquet(staged_path)
    drop_scratch(spark, levels_path)
    if log_path:
        drop_scratch(spark, log_path)
    order = [(stretch, step) for stretch, step in
             dict.fromkeys((stretch, step) for stretch, _, step, _ in plan)]
    order = sorted(order + [(k, -1) for k in alone])
    ratings = _Ratings(spark, state, spec)
    for number, (stretch, step) in enumerate(order):
        if step < 0:
            source = f"{alone_path}/at={stretches[stretch][0]}"
            done = spec.large_race(ratings.attach(spark.read.parquet(source)), max_group_rows)
        else:
            source = f"{staged_path}/step={step}"
            done = _rate(ratings.attach(spark.read.parquet(source)), ["pool", "slot"], spec, True)
        path = f"{out_path}/block={number}"
        done.write.parquet(path)
        drop_scratch(spark, source)
        ratings.add(path, step >= 0)
    return spark.read.schema(f"{spec.output}, block int").parquet(out_path).drop("block")


def _stored(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


RACE = ["pool", "seq", "race"]


def _rate_large_race(rows: DataFrame, chunk_rows: int, options: FoldOptions) -> DataFrame:
    """One race beyond the group size: prefix sums for the update, chunk
    against chunk for the place forecast."""
    rated = cut_lineage(rate_races(rows, RACE, options.params, weight="weight", spread=True))
    done = rated.select(
        *ROW, F.col("mu").alias("mu0"), F.col("sigma").alias("sigma0"), "mu1", "sigma1"
    )
    if options.predict == "none":
        return done.withColumn("predicted", F.lit(None).cast("bigint"))
    use = "0" if options.predict == "before" else "1"
    teams = done.groupBy(*RACE, "team").agg(
        F.sum(f"mu{use}").alias("tm"), F.sum(F.col(f"sigma{use}") * F.col(f"sigma{use}")).alias("tv")
    )
    field = cut_lineage(attach(teams, RACE, F.count("*").alias("n")))
    chances = rival_sums(
        field, RACE, "team", ["tm", "tv", "n"],
        partial(chance_partial, beta=options.params.beta), ["chance"], chunk_rows,
    ).withColumn("chance", F.round("chance", CHANCE_DIGITS))
    chances = cut_lineage(chances)
    places = rank_in_group(
        chances, RACE, "chance", "predicted", hot=hot_groups(chances, RACE)
    ).withColumn("predicted", F.col("predicted").cast("bigint"))
    return done.join(places.drop("chance"), [*RACE, "team"]).select(*done.columns, "predicted")


def _classic_large_race(rows: DataFrame, chunk_rows: int, options: ClassicOptions) -> DataFrame:
    """The Elo and Glicko rules for one race beyond the group size."""
    rows = cut_lineage(rows)
    inputs = ["key", "partner", "score", "period", "rating", "rd", "vol", "last_period"]
    sums = rival_sums(
        rows, RACE, "line", inputs, partial(classic_partial, options=options),
        ["first", "second"], chunk_rows,
    )
    mates = rows.groupBy(*RACE, F.col("key").alias("partner")).agg(
        F.max("rating").alias("mate_rating")
    )
    full = attach(rows, RACE, F.avg("rating").alias("mean"), F.count("*").alias("size")).join(
        mates, [*RACE, "partner"], "left"
    ).withColumn("mate_rating", F.coalesce("mate_rating", F.lit(0.0))).join(sums, [*RACE, "line"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield classic_finish(batch, options)

    return full.mapInPandas(finish, classic(options).output)


def skip_seen(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """Rows not rated before, by (pool, race, key): a re-run adds nothing."""
    return rows.join(rated.select("pool", "race", "key").distinct(), ["pool", "race", "key"], "left_anti")


def classic_rows(
    entries: DataFrame, pool: Column, score: Column, result: Column, period: Column,
    partner: Column | None = None,
) -> DataFrame:
    """Fold input of the Elo and Glicko rules: seq, race, key and a score."""
    none = F.lit(None).cast("string")
    return entries.select(
        pool.alias("pool"), "seq", "race", F.xxhash64("key").alias("line"), "key",
        (none if partner is None else partner).alias("partner"),
        score.cast("double").alias("score"), result.cast("double").alias("result"),
        period.cast("double").alias("period"),
    ).filter("score is not null and key is not null")
