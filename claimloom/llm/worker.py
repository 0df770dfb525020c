"""What a Python worker keeps between tasks, held small so that stages of different operators do not add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_slot: dict = {}


def release() -> None:
    """Let go of what is kept and hand freed memory back to the system."""
    _slot.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def kept(key, build: Callable[[], object]):
    """The object built under this key; building another lets go of it."""
    if key not in _slot:
        release()
        _slot[key] = build()
    return _slot[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
