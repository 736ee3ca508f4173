"""Giving a worker's memory back when a task ends, since workers live on and are idle between stages."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pandas as pd


def release() -> None:
    """Frees what the task left, in Python, Arrow and the C library."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())  # what Arrow's own pool keeps can't be given back
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def trimmed(task: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``task`` that releases its memory when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from task(batches)
        finally:
            release()

    return run
