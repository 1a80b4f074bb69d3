"""Folds, debouncing, presence and windowed counts over unbounded streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.folds import Fold

UPDATE = "id long, seq long, x double, y double, z double"


def deadband_stream(updates: DataFrame, band: float) -> DataFrame:
    """Updates (id, seq, x, y, z) further than band from the last one sent; state is one position per id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")  # one id in one micro-batch
        keep = []
        for i, now in enumerate(rows[["x", "y", "z"]].itertuples(index=False, name=None)):
            if sent is None or sum((a - b) ** 2 for a, b in zip(now, sent)) > band * band:
                sent = now
                keep.append(i)
        state.update(sent)
        yield rows.iloc[keep]

    stated = updates.select("id", "seq", "x", "y", "z").groupBy("id")
    return stated.applyInPandasWithState(step, UPDATE, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)


def presence_stream(updates: DataFrame, stale: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Presence (user_id, ts, seq, value) as keyed state with a time to live.

    Each update gives (user_id, ts, seq, value, present = true) with the latest of its micro-batch and the state;
    a user of whom nothing came for `stale` of event time gives one row with present = false and is forgotten.
    """
    # Milliseconds of the interval.
    wait = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            micros, seq, value = held
            yield pd.DataFrame({"user_id": [key[0]], "ts": [pd.Timestamp(micros, unit="us")], "seq": [seq], "value": [value], "present": [False]})
            return
        for rows in batches:
            newest = rows.sort_values(["ts", "seq"]).iloc[-1]
            now = (int(newest["ts"].value // 1000), int(newest["seq"]), float(newest["value"]))
            held = now if held is None or now[:2] > tuple(held[:2]) else held
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "ts": [pd.Timestamp(held[0], unit="us")], "seq": [held[1]], "value": [held[2]], "present": [True]})

    out = "user_id long, ts timestamp, seq long, value double, present boolean"
    rows = updates.select("user_id", "ts", "seq", "value").withWatermark("ts", late).groupBy("user_id")
    return rows.applyInPandasWithState(step, out, "micros long, seq long, value double", "append", GroupStateTimeout.EventTimeTimeout)


def presence_sessions(updates: DataFrame, stale: str = "30 seconds") -> DataFrame:
    """Sessions of presence per user (user_id, ts): a session ends when nothing came for `stale`."""
    return (
        updates.withWatermark("ts", stale)
        .groupBy("user_id", F.session_window("ts", stale).alias("w"))
        .agg(F.count(F.lit(1)).alias("updates"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "updates")
    )


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window of event time, with a watermark for late ones."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


class _FoldProcessor(StatefulProcessor):
    """A fold's state of one key as a value; rows of a micro-batch are taken in order."""

    def __init__(self, fold: Fold, order: list[str], columns: list[str]):
        self.fold, self.order, self.columns = fold, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((bytes(initialState["state"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        now = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        held, keep, values = self.fold.step(held, [now[c].to_numpy() for c in self.fold.inputs])
        self.state.update((pickle.dumps(held),))
        shown = now[self.columns] if keep is None else now[self.columns].iloc[keep]
        yield shown.assign(**dict(zip(self.fold.out, values)))

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, order: list[str], fold: Fold, start: DataFrame | None = None) -> DataFrame:
    """A fold over a stream: the rows it keeps with the columns it adds, as they come.

    start holds (key, state) of Fold.states over the rows before the stream, which goes on from there. Each key's rows must come in
    order from micro-batch to micro-batch; within one they are sorted. Needs the RocksDB state store.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` {t}" for n, t in fold.out.items()])
    begun = None if start is None else start.groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_FoldProcessor(fold, order, rows.columns), schema, "append", "none", begun)


class _DebounceProcessor(StatefulProcessor):
    """The last event of a key waits until nothing can follow it within quiet any more."""

    def __init__(self, at: str, order: list[str], quiet: int):
        self.at, self.order, self.quiet = at, order, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row binary")

    def _held(self) -> pd.DataFrame | None:
        rows = [pickle.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        return pd.concat(rows) if rows else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        now = pd.concat(([] if held is None else [held]) + list(rows)).sort_values(self.order, kind="stable")
        gap = now[self.at].shift(-1) - now[self.at]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        last = now.iloc[-1:]
        self.waiting.put([(pickle.dumps(last),)])
        self.handle.registerTimer(int(last[self.at].iloc[0].value // 1_000_000) + self.quiet)
        yield now.iloc[:-1][gap.iloc[:-1] >= pd.Timedelta(milliseconds=self.quiet)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.waiting.clear()
        if held is not None:
            yield held

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, key: str, order: list[str], at: str, quiet: str = "300 milliseconds", late: str = "0 seconds") -> DataFrame:
    """Events that nothing follows within `quiet` of event time (a timestamp column): a timer per key gives out the last one."""
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    stated = events.withWatermark(at, late).groupBy(key)
    return stated.transformWithStateInPandas(_DebounceProcessor(at, order, wait), schema, "append", "eventTime")
