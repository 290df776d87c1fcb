"""Sets of word shingles as hashed numbers, over Arrow columns of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from riskweave.llm.common import WordHasher, byte_column, mix, steps

WORDS = 5
_TIMES = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, hasher: WordHasher, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `words` words, as ascending 64-bit hashes.

    A text of fewer words has its whole sequence as one shingle; a text without words, or null, has none.
    """
    data, bounds = byte_column(column)
    for i, j in steps(bounds):
        h, at = hasher(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        full = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for k in range(words):
            full += h[k : k + len(full)] * _TIMES[k]
        full = mix(full)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                whole = (h[a:b] * _TIMES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([whole], dtype=np.uint64))
            else:
                yield full[:0]


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set: equal sets have equal names."""
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x
