"""Arrow batches of texts, cut so that a task holds a bounded amount of text at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 4 << 20
#: What Python workers remember over tasks, only to be faster.
REMEMBERED: list[dict] = []


def give_back(keep: dict | None = None) -> None:
    """Return memory that the Python worker holds free or in REMEMBERED, as it may have worked for other stages before.

    What this stage remembers itself stays if it is given.
    """
    for known in REMEMBERED:
        if known is not keep:
            known.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_batches(
    batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = MAX_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of the batches with about `max_bytes` of text each (one row at least), and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
            piece = batch.slice(at, to - at)
            yield piece, piece.column(piece.schema.get_field_index(text)).to_pylist()
            at = to
