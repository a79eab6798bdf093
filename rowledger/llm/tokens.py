"""Words and hashes of a whole Arrow batch at once, as numpy arrays over its UTF-8 bytes.

Hashes are 64 bits: a sum of random byte codes times powers of an odd number, then mixed.
Two different words of one corpus of ten million share a hash with a chance of about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# a chunk is as many whole texts as fit in this many bytes, or one longer text
CHUNK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# everything in ASCII but digits and letters
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finishing steps of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, starts) of runs of whole texts."""
    data, at = utf8(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@dataclass
class Words:
    start: np.ndarray   # byte where each word begins
    end: np.ndarray     # byte after it
    hash: np.ndarray    # uint64
    of: np.ndarray      # first word of each text, and the number of all words

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    up, down = _powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = WHITE, lower: bool = True) -> Words:
    """Maximal runs without separator bytes, within each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, span_hashes(LOWER[data] if lower else data, start, end), np.searchsorted(start, at, "left"))


def word_hash(word: str, lower: bool = True) -> np.uint64:
    """The hash that ``words`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(LOWER[data] if lower else data, np.array([0]), np.array([len(data)]))[0]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        total = total * _BASE + hashes[j : len(hashes) - n + 1 + j]
    return mix(total)


def counts_within(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each [at[i], at[i + 1])."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (data & 0xC0) != 0x80
