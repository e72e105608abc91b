"""What Python workers hold between tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from lodestrand.llm.words import forget


def give_back() -> None:
    """Collect garbage and return freed memory to the system; the allocators of C, numpy and Arrow would keep most of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, for mapInArrow, in a worker that holds little once the task has ended: its executor's JVM needs the memory.

    Workers outlive their tasks, but every task brings functions and module variables of its own. They refer to each
    other, so what a task remembered would stay until Python happens to collect its garbage.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return task
