"""Words of texts as 64-bit hashes in numpy arrays, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are split into words at a time.
PIECE_BYTES = 6_000_000
KNOWN_WORDS = 1_000_000


class WordHashes(dict):
    """Hash of each word, computed once; ``forget`` bounds what is held."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, parts: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))
        if len(self) > KNOWN_WORDS:
            self.clear()
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, empty for null. ``bytes.split()`` then parts words at ASCII white space only."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[slice]:
    """Runs of neighbouring texts of about ``size`` bytes; a longer text is one by itself."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
