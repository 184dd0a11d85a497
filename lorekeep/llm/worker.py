"""What code inside tasks shares: memory that outlives a task, and batches in pieces of bounded size.

Functions travel to executors by value, so a cache may be no module global or decorator of this package: it would be
pickled by reference to a module that executors need not have.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def kept(name: str) -> dict:
    """A dict of this process, the same for all tasks it runs."""
    module = sys.modules.setdefault("_lorekeep_worker", types.ModuleType("_lorekeep_worker"))
    return module.__dict__.setdefault(name, {})


def trim() -> None:
    """Give memory that nothing uses back to the system; workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def forget(*names: str) -> None:
    """Drop what tasks of other stages kept in this process."""
    for name in names:
        kept(name).clear()
    trim()


def slices(batches: Iterator[pa.RecordBatch], column: int | None = None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose values in ``column`` hold at most ``limit`` bytes, or one row. Memory that
    Arrow no longer uses goes back to the system at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if column is None:
            yield batch
            continue
        at, size = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if size + n > limit and k > at:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += n
        yield batch.slice(at)
    trim()
