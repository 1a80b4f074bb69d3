"""Order-dependent computations: rows of a key stream past a constant-size state.

Keys are shuffled and sorted by Spark; a task holds one key's state and one Arrow batch, never
the rows of a key. The state runs across batches, so keys of any length fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.functions import exprs as X

#: step(state, columns of a stretch of one key's rows) -> (next state, rows to keep or None for all, added columns)
Step = Callable[[Any, list[np.ndarray]], tuple[Any, np.ndarray | None, list]]


@dataclass(frozen=True)
class Fold:
    """A step with the columns it reads and those it adds; the same fold runs over tables and over streams."""

    inputs: list[str]
    out: dict[str, str]
    step: Step

    def over(self, df: DataFrame, key: str, order: list[str]) -> DataFrame:
        return ordered_fold(df, key, order, self.inputs, self.out, self.step)

    def states(self, df: DataFrame, key: str, order: list[str]) -> DataFrame:
        """(key, state): where the fold stands after all rows of each key, for a stream that goes on from there."""
        schema = T.StructType([df.schema[key], T.StructField("state", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, state, begun = None, None, False
            made = lambda: pa.RecordBatch.from_arrays([pa.array([last], to_arrow_type(schema[0].dataType)), pa.array([pickle.dumps(state)], pa.binary())], schema.names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in self.inputs]
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    name = batch.column(key)[lo].as_py()
                    if not begun or name != last:
                        if begun:
                            yield made()
                        last, state, begun = name, None, True
                    state = self.step(state, [c[lo:hi] for c in columns])[0]
            if begun:
                yield made()

        return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ordered_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], out: dict[str, str], step: Step) -> DataFrame:
    """df along order within each key, with the out columns that step makes of the input columns.

    step sees each stretch of a key inside an Arrow batch at once, as arrays; the state of a key begins as None.
    """
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()])
    schema, types = T.StructType([*df.schema.fields, *added.fields]), [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]
            kept, made = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                name = batch.column(key)[lo].as_py()
                if name != last:
                    last, state = name, None
                state, keep, values = step(state, [c[lo:hi] for c in columns])
                kept.append(np.arange(lo, hi) if keep is None else lo + keep)
                made.append(values)
            rows = np.concatenate(kept)
            if len(rows):
                new = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*made), types)] if out else []
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, *new], schema.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _first_beyond(rows: np.ndarray, start: int, sent: np.ndarray, bands: list[tuple[slice, float]]) -> int:
    """The first row from start on that is further than a band from sent; windows double while none is found."""
    size = 8
    while start < len(rows):
        part = rows[start : start + size] - sent
        hit = np.zeros(len(part), bool)
        for columns, band in bands:
            hit |= (part[:, columns] ** 2).sum(axis=1) > band * band
        if hit.any():
            return start + int(hit.argmax())
        start, size = start + len(part), 2 * size
    return len(rows)


def deadband_fold(position: list[str], velocity: list[str], position_band: float = 0.01, velocity_band: float = 0.005) -> Fold:
    """Updates that differ from the last one *sent* by more than a band; position and velocity are stored together."""
    bands = [(slice(0, len(position)), position_band), (slice(len(position), None), velocity_band)]

    def step(sent, columns):
        rows = np.column_stack(columns).astype(float)
        keep, at = [], 0 if sent is None else _first_beyond(rows, 0, sent, bands)
        while at < len(rows):
            keep.append(at)
            sent = rows[at]
            at = _first_beyond(rows, at + 1, sent, bands)
        return sent, np.array(keep, np.int64), []

    return Fold([*position, *velocity], {}, step)


def deadband(updates: DataFrame, key: str, order: list[str], position: list[str], velocity: list[str], position_band: float = 0.01, velocity_band: float = 0.005) -> DataFrame:
    """deadband_fold over a table."""
    return deadband_fold(position, velocity, position_band, velocity_band).over(updates, key, order)


def throttle_fold(at: str, least: float) -> Fold:
    """Events at least `least` after the last one accepted; order begins with the time `at`."""

    def step(accepted, columns):
        times, keep = columns[0], []
        i = 0 if accepted is None else int(np.searchsorted(times, accepted + least))
        while i < len(times):
            keep.append(i)
            accepted = times[i]
            i = max(i + 1, int(np.searchsorted(times, accepted + least)))
        return accepted, np.array(keep, np.int64), []

    return Fold([at], {}, step)


def throttle(events: DataFrame, key: str, order: list[str], at: str, least: float) -> DataFrame:
    """throttle_fold over a table."""
    return throttle_fold(at, least).over(events, key, order)


def debounce(events: DataFrame, key: str, order: list[str], at: str, quiet: float) -> DataFrame:
    """Events that nothing follows within `quiet`."""
    following = F.lead(at).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") - F.col(at) >= quiet)).drop("_next")


def adaptive_rate_fold(motion: str, threshold: float = 0.05, low: int = 5, high: int = 60, damping: float = 0.9) -> Fold:
    """The update rate after each measurement: damped towards high or low, cut to whole numbers and clamped."""
    follow = [[min(max(int(rate * damping + target * (1.0 - damping)), low), high) for rate in range(high + 1)] for target in (low, high)]

    # Eight measurements at once: bits tell which were fast; eight[bits, rate] holds the rates after each of them.
    eight = np.zeros((256, high + 1, 8), np.int64)
    flags = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    table, now = np.array(follow), np.tile(np.arange(high + 1), (256, 1))
    for k in range(8):
        now = eight[:, :, k] = table[flags[:, k : k + 1], now]
    after = eight[:, :, 7].tolist()

    def step(rate, columns):
        rate, fast = low if rate is None else rate, columns[0] > threshold
        bits = np.packbits(fast)  # the last byte is filled up with slow ones, whose rates are cut off
        starts = []
        for byte in bits.tolist():
            starts.append(rate)
            rate = after[byte][rate]
        rates = eight[bits, starts].ravel()[: len(fast)]
        return int(rates[-1]), None, [rates]

    return Fold([motion], {"rate": "long"}, step)


def adaptive_rate(motions: DataFrame, key: str, order: list[str], motion: str, threshold: float = 0.05, low: int = 5, high: int = 60, damping: float = 0.9) -> DataFrame:
    """adaptive_rate_fold over a table."""
    return adaptive_rate_fold(motion, threshold, low, high, damping).over(motions, key, order)


def smoothed_fold(value: str, weight: float = 0.8, gain: float = 10.0) -> Fold:
    """Exponential smoothing from 0, and the level shown: min(gain * smoothed, 1)."""
    block = 64
    fade = weight ** np.arange(1, block + 1)
    mix = (1.0 - weight) * np.tril(weight ** np.maximum(np.subtract.outer(np.arange(block), np.arange(block)), 0))

    def step(level, columns):
        level, values, out = level or 0.0, columns[0].astype(float), []
        for lo in range(0, len(values), block):
            part = values[lo : lo + block]
            out.append(fade[: len(part)] * level + mix[: len(part), : len(part)] @ part)
            level = float(out[-1][-1])
        found = np.concatenate(out)
        return level, None, [found, np.minimum(gain * found, 1.0)]

    return Fold([value], {"level": "double", "shown": "double"}, step)


def smoothed(levels: DataFrame, key: str, order: list[str], value: str, weight: float = 0.8, gain: float = 10.0) -> DataFrame:
    """smoothed_fold over a table."""
    return smoothed_fold(value, weight, gain).over(levels, key, order)


def hysteresis_fold(confidence: str, active: str, on: float = 0.8, off: float = 0.5) -> Fold:
    """A switch that needs more than `on` to turn on and stays while active or above `off`."""

    def step(state, columns):
        sure, pressed = columns[0], columns[1].astype(bool)
        turn = np.where((sure > on) & pressed, 1, np.where(pressed | (sure > off), 0, -1))
        latest = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
        held = np.where(latest >= 0, turn[latest] == 1, bool(state))
        return bool(held[-1]), None, [held]

    return Fold([confidence, active], {"state": "boolean"}, step)


def hysteresis(rows: DataFrame, key: str, order: list[str], confidence: str, active: str, on: float = 0.8, off: float = 0.5) -> DataFrame:
    """hysteresis_fold over a table."""
    return hysteresis_fold(confidence, active, on, off).over(rows, key, order)


def selection_fold(item: str, most: int = 2) -> Fold:
    """The selected items after each toggle: a second toggle removes, a new one evicts the oldest beyond most."""

    def step(chosen, columns):
        chosen, shown = list(chosen or []), []
        for one in columns[0].tolist():
            if one in chosen:
                chosen.remove(one)
            else:
                chosen = [*(chosen[1:] if len(chosen) >= most else chosen), one]
            shown.append(",".join(map(str, chosen)))
        return chosen, None, [np.array(shown, object)]

    return Fold([item], {"chosen": "string"}, step)


def selection(toggles: DataFrame, key: str, order: list[str], item: str, most: int = 2) -> DataFrame:
    """selection_fold over a table."""
    return selection_fold(item, most).over(toggles, key, order)


def undo_history_fold(action: str, value: str, most: int = 50) -> Fold:
    """The undo history after each event: current (its entry at the cursor), position (from 1, 0 if empty), entries.

    Actions: "set" cuts off what was undone and appends value, dropping the oldest beyond `most`; it is passed over if value equals
    the last one appended. "undo" and "redo" move the cursor if they can; "clear" empties the history. Others change nothing.
    A key's state is the `most` entries and the cursor; a stretch of equal actions is handled at once.
    """
    empty = ([], -1, None)

    def step(state, columns):
        entries, cursor, last = state or empty
        actions, values = columns
        cuts = [0, *(np.flatnonzero(actions[1:] != actions[:-1]) + 1).tolist(), len(actions)]
        shown, places, sizes = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            kind, n = actions[lo], hi - lo
            if kind == "set":
                for v in values[lo:hi].tolist():
                    if v != last or (cursor < 0 and not entries):
                        entries, last = [*entries[: cursor + 1], v][-most:], v
                        cursor = len(entries) - 1
                    shown.append(entries[cursor])
                    places.append(cursor + 1)
                    sizes.append(len(entries))
                continue
            if kind == "undo" and entries:
                at = np.maximum(cursor - np.arange(1, n + 1), 0)
            elif kind == "redo" and entries:
                at = np.minimum(cursor + np.arange(1, n + 1), len(entries) - 1)
            else:
                if kind == "clear":
                    entries, cursor, last = empty
                at = np.full(n, cursor)
            cursor = int(at[-1])
            shown += [entries[i] if i >= 0 else None for i in at.tolist()]
            places += (at + 1).tolist()
            sizes += [len(entries)] * n
        return (entries, cursor, last), None, [np.array(shown, object), np.array(places, np.int64), np.array(sizes, np.int64)]

    return Fold([action, value], {"current": "string", "position": "long", "entries": "long"}, step)


def undo_history(events: DataFrame, key: str, order: list[str], action: str, value: str, most: int = 50) -> DataFrame:
    """undo_history_fold over a table, with can_undo and can_redo."""
    folded = undo_history_fold(action, value, most).over(events, key, order)
    return folded.withColumns({"can_undo": F.col("position") > 1, "can_redo": F.col("position") < F.col("entries")})


def history_tail(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The latest `most` rows of each key."""
    newest = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def log_tail(entries: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """The latest `most` log entries."""
    return entries.orderBy(*(F.desc(c) for c in order)).limit(most)


def transcripts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Turns with something other than white space of any kind."""
    return turns.filter(F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False)))


def answers(chunks: DataFrame, key: str, order: str, text: str, end: Column | None = None) -> DataFrame:
    """The ordered concatenation of a conversation's chunks, which are bounded by the answer's own length.

    end tells the marker that ends an answer; it and what follows it don't count.
    """
    if end is not None:
        last = F.min(F.when(end, F.col(order))).over(W.partitionBy(key))
        chunks = chunks.withColumn("_end", last).filter(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("answer"), F.count(F.lit(1)).alias("n"))


def stream_answers(lines: DataFrame, column: str = "line") -> DataFrame:
    """Server-sent lines to answers: data lines with a non-empty data.answer or answer; the end marker has none, errors are rejected."""
    data = lines.filter(F.col(column).startswith("data:")).withColumn("json", F.trim(F.substring(column, 6, 1 << 30)))
    answer = F.coalesce(F.get_json_object("json", "$.data.answer"), F.get_json_object("json", "$.answer"))
    good = F.get_json_object("json", "$.error").isNull() & (F.coalesce(F.length("answer"), F.lit(0)) > 0)
    return data.withColumn("answer", answer).filter(good).drop("json")


def audio_answers(responses: DataFrame, column: str = "json") -> DataFrame:
    """responses with status, answer, audio and header (channels, rate, bits) of a JSON answer with sound.

    answer and audio come from data, else from the top. status is "ok", or what is wrong: "error", "no answer",
    "no audio", "bad base64", "too short" or "bad header"; then answer, audio and header are null.
    """
    field = lambda name: F.coalesce(F.get_json_object(column, f"$.data.{name}"), F.get_json_object(column, f"$.{name}"))
    # Fixed value: Base64 text.
    encoded = F.when(field("audio").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), field("audio"))
    rows = responses.withColumns({"answer": field("answer"), "audio": F.unbase64(encoded)})
    status = (
        F.when(F.get_json_object(column, "$.error").isNotNull(), "error")
        .when(F.col("answer").isNull(), "no answer")
        .when(field("audio").isNull(), "no audio")
        .when(F.col("audio").isNull(), "bad base64")
        .when(F.octet_length("audio") < 44, "too short")
        .when(X.wav_header(F.col("audio")).isNull(), "bad header")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    right = lambda c: F.when(F.col("status") == "ok", c)
    return rows.withColumns({"answer": right(F.col("answer")), "audio": right(F.col("audio")), "header": right(X.wav_header(F.col("audio")))})


def component_metrics(renders: DataFrame, slow: float = 16.67) -> DataFrame:
    """Per component: renders, total, mean, peak, last and how many were slow; slowest mean first."""
    return (
        renders.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("renders"),
            F.sum("ms").alias("total"),
            F.avg("ms").alias("mean"),
            F.max("ms").alias("peak"),
            F.max_by("ms", F.struct("ts", "seq")).alias("last"),
            F.count_if(F.col("ms") > slow).alias("slow"),
        )
        .orderBy(F.desc("mean"), "component")
    )


def transfer_statistics(updates: DataFrame, key: str = "client") -> DataFrame:
    """Per client: updates, bytes, mean bytes and the longest pause in seconds."""
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy(key).orderBy("ts", "seq"))
    return updates.withColumn("gap", gap).groupBy(key).agg(
        F.count(F.lit(1)).alias("updates"), F.sum("bytes").alias("total_bytes"), F.avg("bytes").alias("mean_bytes"), F.max("gap").alias("longest_pause")
    )
