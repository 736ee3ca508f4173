"""Sketches counted per partition and merged in streams of bounded memory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm._memory import trimmed


def add_to_top(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Adds unsigned counts; what would run over stays at the top."""
    room = np.iinfo(a.dtype).max - b
    np.minimum(a, room, out=a)
    return np.add(a, b, out=a)


def put(plane: np.ndarray, cells: np.ndarray) -> None:
    """Sets the bits of the cells in a bit plane."""
    np.bitwise_or.at(plane, (cells >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8))


def has(plane: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the cells a bit plane holds."""
    return (plane[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pack(cells: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(cells).data)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(bytearray(zstandard.ZstdDecompressor().decompress(blob)), dtype=dtype)


def held(packed: Broadcast, dtype) -> np.ndarray:
    """The array of a packed broadcast, whose bytes the worker then lets go. Keep it in the task only."""
    out = unpack(packed.value, dtype)
    packed.__dict__.pop("_value", None)
    return out


def merged(
    df: DataFrame,
    shape: int | tuple[int, ...],
    dtype: str,
    count: Callable[[np.ndarray, pd.DataFrame], None],
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    finish: Callable[[np.ndarray], np.ndarray],
    parts: int | None = None,
) -> bytes:
    """What ``finish`` makes of the merged sketch of all rows, packed: ``count`` adds a batch to a partition's cells.

    Every partition makes one array of ``shape``; as many tasks as the root of
    their number (``parts``, or the session's shuffle partitions) merge them
    one by one, a last task merges what these made and finishes it, so each
    reads about the root of all arrays. The driver gets the packed bytes, to be
    passed on as they are. ``shape`` is a fixed bound, so nothing here grows with the
    rows. An empty table has an empty sketch.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(shape, dtype=dtype)
        for batch in batches:
            count(own, batch)
        yield pd.DataFrame({"blob": [pack(own)]})

    def sums(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
        own = None
        for batch in batches:
            for blob in batch["blob"]:
                own = unpack(blob, dtype).reshape(shape) if own is None else combine(own, unpack(blob, dtype).reshape(shape))
        return own

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sums(batches)
        if own is not None:
            yield pd.DataFrame({"blob": [pack(own)]})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sums(batches)
        yield pd.DataFrame({"blob": [pack(finish(np.zeros(shape, dtype=dtype) if own is None else own))]})

    groups = max(8, math.isqrt(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    made = df.mapInPandas(trimmed(partial), "blob binary").withColumn("part", F.spark_partition_id() % groups).repartition(groups, "part").select("blob")
    done = made.mapInPandas(trimmed(merge), "blob binary").repartition(1).mapInPandas(trimmed(last), "blob binary").first()
    return bytes(done.blob) if done else pack(finish(np.zeros(shape, dtype=dtype)))
