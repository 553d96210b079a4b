"""Cutting Arrow batches so that array work on them stays within a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """Parts of a string array, in order, of at most ``most_bytes``; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + most_bytes, "right")))
        yield texts.slice(begin, end - begin)
        begin = end
