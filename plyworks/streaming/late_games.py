"""Ordered folds over streams whose games arrive late and in any order, with timers in event time.

A game that arrives is kept in the state of its key until the watermark has passed the time when it was played. Then a
timer takes all games that are due in order of their numbers through the fold. So a stream gives what the batch gives,
however its deliveries are shuffled within the delay. A game whose number was already passed is counted as late and
changes nothing; Spark itself leaves out (and counts as rows dropped by watermark) what is older than the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(v):
    return None if v is None or pd.isna(v) else v.item() if hasattr(v, "item") else v


class Replay(StatefulProcessor):
    """fold(key, games, state) gives rows and the next state; `state_schema` is that of the state and of the last number."""

    def __init__(self, fold: Callable, start: tuple, columns: str, out: str, state_schema: str):
        self.fold, self.start, self.columns, self.out, self.state_schema = fold, start, columns, out, state_schema
        self.time = "__time"
        self.kinds = {n: T.StructType.fromDDL(d) for n, d in {"held": state_schema, "late": "n long", "no": "game_no long", "game": f"time long, {columns}"}.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.kinds["held"])
        self.late = handle.getValueState("late", self.kinds["late"])
        self.waiting = handle.getMapState("waiting", self.kinds["no"], self.kinds["game"])

    def _state(self) -> tuple[tuple, int]:
        if not self.held.exists():
            return self.start, -1
        *state, last = self.held.get()
        return tuple(state), last

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        names = [c.split()[0] for c in self.state_schema.split(", ")]
        row = initialState.iloc[0]
        self.held.update(tuple(_plain(row[n]) for n in names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, last = self._state()
        late, names = 0, [c.split()[0] for c in self.columns.split(", ")]
        for part in rows:
            for r in part.to_dict("records"):
                if r["game_no"] <= last:
                    late += 1
                    continue
                moment = int(pd.Timestamp(r[self.time]).value // 1_000_000)
                self.waiting.updateValue((int(r["game_no"]),), (moment, *[_plain(r[n]) for n in names]))  # a repeated delivery is the same game
                self.handle.registerTimer(moment)
        if late:
            self.late.update((late + (self.late.get()[0] if self.late.exists() else 0),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= upto)
        state, last = self._state()
        for no, _ in due:
            self.waiting.removeKey((no,))
        fresh = [x for x in due if x[0] > last]
        if not fresh:
            return
        games = pd.DataFrame([(no, *v[1:]) for no, v in fresh], columns=["game_no", *[c.split()[0] for c in self.columns.split(", ")]])
        rows, state = self.fold(key[0], games, state)
        self.held.update((*[_plain(x) for x in state], fresh[-1][0]))
        rows["late"] = self.late.get()[0] if self.late.exists() else 0
        yield rows


def replayed(games: DataFrame, key: str, event_time: str, delay: str, processor: Replay, first: DataFrame | None = None) -> DataFrame:
    """The rows of a fold over a stream. first: key and the columns of the state, a row per key, to go on from. The session's state store must be
    that of RocksDB (`spark.sql.streaming.stateStore.providerClass`); it is set here if the session does not name one."""
    spark = games.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor.time = event_time
    columns = [c.split()[0] for c in processor.columns.split(", ")]
    rows = games.select(key, "game_no", event_time, *[c for c in columns if c != event_time]).withWatermark(event_time, delay)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(f"{processor.out}, late long"), outputMode="Append", timeMode="EventTime",
        initialState=None if first is None else first.groupBy(key),
    )
