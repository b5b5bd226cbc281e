"""Arrow batches cut so that Python holds a bounded length of text at once, and what a Python worker keeps between tasks.

Spark gives the tasks of all operators to the same workers. So a worker keeps things of one operator at a time, and
hands memory that a task needed back to the system at its end: a heap of the JVM stands beside each worker's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: By operator: what it keeps in this worker from task to task.
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What the operator keeps in this worker; what others kept goes."""
    if any(other != operator for other in _kept):
        mine = _kept.pop(operator, {})
        _kept.clear()
        _kept[operator] = mine
        gc.collect()
        handed_back()
    return _kept.setdefault(operator, {})


def handed_back() -> None:
    """Memory that is free in this process goes to the system, where its allocators can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def alone(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that keeps nothing of other operators, and hands free memory back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by(operator)
        yield from run(batches)
        handed_back()

    return task


def portions(batches: Iterable[pa.RecordBatch], place: int, *, rows: int, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of at most `rows` rows, and of `chars` characters but for the last text, each with its texts (column `place`)."""
    for batch in batches:
        at, length, texts = 0, 0, []
        for x in batch.column(place):
            texts.append(x.as_py())
            length += len(texts[-1] or "")
            if len(texts) == rows or length > chars:
                yield batch.slice(at, len(texts)), texts
                at, length, texts = at + len(texts), 0, []
        if texts:
            yield batch.slice(at), texts
