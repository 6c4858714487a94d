"""Words and their hashes inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
#: Bytes of a text that are split into words at a time.
BLOCK_BYTES = 1 << 22
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; empty for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, about ``size`` bytes of them at a time, so that a long text costs no more memory."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            gap = _WHITE.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def shingle_blocks(data: bytes, length: int) -> Iterator[list[bytes]]:
    """Shingles of ``length`` words joined by a space; of fewer words, the whole sequence; of none, nothing."""
    held: list[bytes] = []
    found = False
    for block in word_blocks(data):
        held += block
        if len(held) >= length:
            found = True
            yield [b" ".join(held[i : i + length]) for i in range(len(held) - length + 1)]
            held = held[len(held) - length + 1 :]
    if not found and held:
        yield [b" ".join(held)]


def hashes(pieces: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Another well-spread hash of each hash: the finaliser of splitmix64 after adding ``salt`` times an odd number."""
    x = values + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
