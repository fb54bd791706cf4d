"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed in one go (a longer document makes a chunk of its own); bytes up to which a span is hashed by blocks of eight.
CHUNK, BLOCKED = 1 << 18, 64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
#: The low n bytes of a 64-bit word.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def freeing(work: Callable) -> Callable:
    """`work`, a generator over Arrow batches; when a partition ends, free memory goes back to the system.

    Python workers outlive a partition and stay in the executor's memory while other stages run.
    """

    @functools.wraps(work)
    def run(*args: object, **named: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(2 * CHUNK)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; only those for a usual chunk are kept."""
    a, b = _usual_powers() if n <= 2 * CHUNK else _powers_to(n)
    return a[:n], b[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, scaled by `span_hash`, identify any span of `values`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end) of some tens of values; equal spans have equal hashes, wherever they stand."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def padded(data: np.ndarray) -> np.ndarray:
    """`data` with room behind it for `eight`."""
    return np.concatenate([data, np.zeros(16, np.uint8)])


def eight(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` (8 at most) bytes from each start as one number each; `data` is `padded`."""
    at_every_byte = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return at_every_byte[start] & _LOW_BYTES[size]


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span [start, end), of any length.

    Blocks of eight bytes are mixed in one after another; what is longer than BLOCKED goes through
    BLAKE2b, so a hash never depends on a weakness that long regular strings would meet.
    """
    data, size = padded(data), end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    short = np.flatnonzero(size <= BLOCKED)
    at, left = start[short], size[short]
    k = 0
    while len(short):
        out[short] = mix(out[short] * np.uint64(0xD6E8FEB86659FD93) + mix(eight(data, at, np.minimum(left, 8)) + np.uint64(k)))
        k += 1
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > BLOCKED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to `limit` at most; a single one may be larger."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end (in the joined bytes) of every word, and the joined bytes."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(first, start, side="right") - 1
    return byte_hash(data, start, end), owner, start, end, data


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words.

    ASCII capitals count as small letters. A text of fewer words has its whole sequence as the one
    shingle; a text without words has none.
    """
    words, owner, *_ = word_hashes([t.lower() for t in texts])
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        grams += words[j : j + len(grams)] * factors[j]
    grams = mix(grams)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n = hi - lo
        if n >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif n:
            out.append(mix((words[lo:hi] * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
