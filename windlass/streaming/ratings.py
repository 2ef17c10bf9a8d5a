"""The ordered rating as a stream: state by pool, regattas closed by event time.

Races must be rated in the order of the batch run: regattas by their first race,
races within a regatta by date, number and division. Rows arrive in any order
within the watermark's delay. A pool keeps the rows of its open regattas; a timer
of each regatta fires once the watermark is `regatta_days` behind its first race,
when everything up to there has arrived. Then all regattas that began so far are
folded with the ratings the pool keeps, and their rows come out.

A row for a regatta that is closed, or that would begin one before the closed
time, is late: it comes out with `late` set and no rating, and changes none; rows
behind the watermark itself are dropped by Spark. Rows without a key only move
time on. A restarted stream goes on from its
checkpoint; a replayed batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from windlass.operators.rating_kernel import FoldOptions, fold_group

# What the fold needs of the session; other providers have no timers by key.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
DAY_MS = 86_400_000

_ROW = "regatta string, race string, ms long, race_no long, div string, team long, line long, " \
       "rank double, key string, weight double"
_NAMES = [part.split()[0] for part in _ROW.split(",")]
OUTPUT = ("pool string, regatta string, race string, team long, line long, rank double, key string, "
          "mu0 double, sigma0 double, mu1 double, sigma1 double, predicted long, late boolean")
_OUT = [part.split()[0] for part in OUTPUT.split(",")]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_OPEN = _schema(
    ("regatta", T.StringType()), ("race", T.StringType()), ("ms", T.LongType()),
    ("race_no", T.LongType()), ("div", T.StringType()), ("team", T.LongType()),
    ("line", T.LongType()), ("rank", T.DoubleType()), ("key", T.StringType()),
    ("weight", T.DoubleType()))


class RatingProcessor(StatefulProcessor):
    """Ratings of one pool (the grouping key)."""

    def __init__(self, options: FoldOptions, regatta_days: int) -> None:
        self.options, self.wait = options, regatta_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState(
            "ratings", _schema(("key", T.StringType())),
            _schema(("mu", T.DoubleType()), ("sigma", T.DoubleType())))
        self.open = handle.getListState("open", _OPEN)
        # First race of each regatta that is open, and of those closed: null.
        self.regattas = handle.getMapState(
            "regattas", _schema(("regatta", T.StringType())), _schema(("first", T.LongType())))
        self.closed = handle.getValueState("closed", _schema(("ms", T.LongType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self.closed.get()[0] if self.closed.exists() else -(1 << 62)
        late, held = [], []
        for batch in rows:
            for row in batch[_NAMES].itertuples(index=False):
                if row.key is None or pd.isna(row.key):
                    continue
                regatta = (row.regatta,)
                known = self.regattas.containsKey(regatta)
                first = self.regattas.getValue(regatta)[0] if known else None
                if (first is None) if known else row.ms <= closed:
                    late.append(row)
                    continue
                if not known or row.ms < first:
                    self.regattas.updateValue(regatta, (int(row.ms),))
                    self.handle.registerTimer(int(row.ms) + self.wait)
                held.append((
                    row.regatta, row.race, int(row.ms), int(row.race_no),
                    None if pd.isna(row.div) else row.div, int(row.team), int(row.line),
                    float(row.rank), row.key, float(row.weight)))
        if held:
            self.open.appendList(held)
        if late:
            out = pd.DataFrame(late, columns=_NAMES).assign(pool=key[0], late=True)
            yield out.reindex(columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() - self.wait
        rows = pd.DataFrame(list(self.open.get()), columns=_NAMES) if self.open.exists() else None
        closed = self.closed.get()[0] if self.closed.exists() else upto - 1
        if rows is None or upto <= closed and not len(rows):
            return
        began = rows.groupby("regatta")["ms"].transform("min")
        ready = rows[began <= upto]
        if not len(ready):
            return
        kept = rows[began > upto]
        if len(kept):
            self.open.put([tuple(None if pd.isna(v) else v for v in r)
                           for r in kept.astype(object).itertuples(index=False)])
        else:
            self.open.clear()
        for regatta in ready["regatta"].unique():
            self.regattas.updateValue((regatta,), (None,))
        self.closed.update((max(upto, closed),))
        yield self._fold(key[0], ready)

    def _fold(self, pool: str, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(bare=rows["div"].isna(), letter=rows["div"].fillna(""))
        rank = rows[["ms", "race_no", "bare", "letter"]].apply(tuple, axis=1)
        races = rows.assign(at=rank).groupby(["regatta", "race"], as_index=False)["at"].min()
        races["begin"] = races.groupby("regatta")["at"].transform("min")
        races = races.sort_values(["begin", "regatta", "at", "race"], ignore_index=True)
        races["seq"] = races.index
        rows = rows.merge(races[["regatta", "race", "seq"]], on=["regatta", "race"])
        p = self.options.params
        state = {k: self.ratings.getValue((k,)) if self.ratings.containsKey((k,))
                 else (p.mu, p.sigma) for k in rows["key"].unique()}
        rows["mu"] = rows["key"].map(lambda k: state[k][0])
        rows["sigma"] = rows["key"].map(lambda k: state[k][1])
        rated = fold_group(rows.assign(pool=pool), self.options)
        last = rated.sort_values(["seq", "line"]).groupby("key").tail(1)
        for k, mu, sigma in zip(last["key"], last["mu1"], last["sigma1"]):
            self.ratings.updateValue((k,), (float(mu), float(sigma)))
        regatta = races.set_index("seq")["regatta"]
        rated = rated.assign(regatta=rated["seq"].map(regatta), late=False)
        return rated.reindex(columns=_OUT)

    def close(self) -> None:
        pass


def rate_stream(
    entries: DataFrame, options: FoldOptions | None = None, delay: str = "2 days",
    regatta_days: int = 7,
) -> DataFrame:
    """entries: a stream of pool, regatta, race, ts, race_no, div, team, line, rank,
    key, weight -> rated rows in append mode. The session needs `STATE_SETTINGS`."""
    timed = entries.withWatermark("ts", delay).selectExpr(
        "pool", "ts", "regatta", "race", "unix_millis(ts) as ms", "cast(race_no as long) as race_no",
        "div", "cast(team as long) as team", "cast(line as long) as line",
        "cast(rank as double) as rank", "key", "cast(weight as double) as weight")
    return timed.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=RatingProcessor(options or FoldOptions(), regatta_days),
        outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
