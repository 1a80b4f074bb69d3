"""Binary position frames: 28 little-endian bytes per node (u32 id, three f32 positions, three f32 velocities)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import exprs as X

RECORD = np.dtype([("id", "<u4"), ("p", "<f4", 3), ("v", "<f4", 3)])
NODE = "frame_id long, id long, x float, y float, z float, vx float, vy float, vz float, mass short, flags short"


@F.pandas_udf(T.BinaryType())
def encode_node(id: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, vx: pd.Series, vy: pd.Series, vz: pd.Series) -> pd.Series:
    """One node's 28 bytes."""
    out = np.zeros(len(id), RECORD)
    out["id"] = id
    out["p"] = np.column_stack((x, y, z))
    out["v"] = np.column_stack((vx, vy, vz))
    raw = out.tobytes()
    return pd.Series([raw[i : i + 28] for i in range(0, len(raw), 28)], dtype=object)


def frames(nodes: DataFrame, per_frame: int = 1024) -> DataFrame:
    """(frame_id, payload): nodes in id order, per_frame ids to a frame."""
    one = nodes.select("id", encode_node(*(F.col(c) for c in ("id", "x", "y", "z", "vx", "vy", "vz"))).alias("raw"))
    grouped = one.groupBy(F.floor(F.col("id") / per_frame).alias("frame_id")).agg(F.array_sort(F.collect_list(F.struct("id", "raw"))).alias("parts"))
    payload = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["raw"]))
    return grouped.select("frame_id", payload.alias("payload"))


def decode_frames(packed: DataFrame, strict: bool = True) -> DataFrame:
    """One row per node, mass 100 and flags 0. Strict: a length that is no multiple of 28 is an error;
    else whole records are read and those with a value that is not finite dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, raw in zip(batch.column("frame_id").to_pylist(), batch.column("payload").to_pylist()):
                raw = raw or b""
                if strict and len(raw) % 28:
                    raise ValueError(f"frame {frame} has {len(raw)} bytes, no multiple of 28")
                rows = np.frombuffer(raw, RECORD, len(raw) // 28)
                if not strict:
                    rows = rows[np.isfinite(rows["p"]).all(axis=1) & np.isfinite(rows["v"]).all(axis=1)]
                n = len(rows)
                numbers = [*rows["p"].T, *rows["v"].T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, frame, np.int64)), pa.array(rows["id"].astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in numbers), pa.array(np.full(n, 100, np.int16)), pa.array(np.zeros(n, np.int16))],
                    ["frame_id", "id", "x", "y", "z", "vx", "vy", "vz", "mass", "flags"],
                )

    return packed.select("frame_id", "payload").mapInArrow(run, NODE)


@F.pandas_udf(T.BinaryType())
def inflate(raw: pd.Series) -> pd.Series:
    """Deflated bytes behind a two-byte header; other bytes stay as they are."""

    def one(b: bytes | None) -> bytes | None:
        return zlib.decompressobj(-15).decompress(b[2:]) if b and b[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda") else b

    return raw.map(one)


def frame_size(count: Column) -> Column:
    return count * 28


def position_array(updates: DataFrame) -> DataFrame:
    """(id, x, y, z) of every update, of unknown ids too; a component that is missing or no number is 0."""
    return updates.select("id", *(X.or_zero(F.col(c).cast("double")).alias(c) for c in ("x", "y", "z")))
