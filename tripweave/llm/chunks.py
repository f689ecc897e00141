"""Arrow helpers: documents cut at spaces, with every distinct chunk handled once a batch.

Kernels that need a value per word (token ids, counts, scores) look it up for
the distinct chunks of a batch and spread it with NumPy, so their cost follows
the number of distinct words rather than the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel holds at a time (a longer document is held whole).
SLICE_BYTES = 6 << 20


def release() -> None:
    """Gives back memory that Arrow and the C library keep though it is free: workers live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `limit` bytes of text, each of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Chunks:
    """Texts cut at each U+0020; nulls count as empty, and an empty text is one empty chunk.

    values: the distinct chunks; codes: each chunk's place among them;
    starts: each document's first chunk.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        cut = pc.split_pattern(texts, " ")
        self.counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1])) if len(self.counts) else np.zeros(0, np.int64)
        coded = cut.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.values: list[str] = coded.dictionary.to_pylist()

    def sums(self, per_value: np.ndarray) -> np.ndarray:
        """Sum over each document's chunks of a number (or row of numbers) per distinct chunk."""
        if not len(self.starts):
            return np.zeros((0, *per_value.shape[1:]), per_value.dtype)
        return np.add.reduceat(per_value[self.codes], self.starts, axis=0)


class Memo(dict):
    """A dictionary that stops growing at `most` entries; what it doesn't hold is worked out again."""

    def __init__(self, work, most: int = 400_000):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key):
        value = self.work(key)
        if len(self) < self.most:
            self[key] = value
        return value
