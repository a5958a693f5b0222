"""Vectorised word splitting and hashing over Arrow string columns.

A *word* is a maximal run of bytes outside ASCII white space (space and
\\t..\\r), i.e. ``[^\\x20\\x09-\\x0D]+``.  Whole texts are read, never prefixes.
The functions work on one Arrow batch at a time, in blocks of documents of
bounded total size, so a task's memory follows the block and the longest text.

A word's hash is its BLAKE2b digest of 128 bits, in two lanes of 64: no two words
that anybody could write down share both, whatever their lengths and letters.
Where a result must not rest on a hash at all, :class:`Numbers` and :func:`grams`
compare the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Words whose digests a worker remembers, none longer than LONG_WORD, and words digested at once.
CACHE_WORDS, LONG_WORD, STEP_WORDS = 150_000, 64, 1 << 16
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        size = max(n, BLOCK_BYTES + 1)
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if size <= 16 * BLOCK_BYTES:
            _powers[int(base)] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class WordBlock:
    """Words of the documents ``first .. first+n-1`` of a batch.

    ``bounds[i]:bounds[i+1]`` are the words of document ``first+i``;
    ``starts``/``ends`` are byte positions in ``data``; ``hashes`` and ``second``
    are the two lanes of the words' digests.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    second: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, i: int) -> list[bytes]:
        """The words of document ``first + i``."""
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


class _Digests(dict):
    """Digests by word, worked out when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


_digests = _Digests()
_held: list[dict] = []


def hold(cache: dict) -> None:
    """Let the worker remember these words, and forget those of any other kernel.

    Workers are used again by later stages and queries, so what each kernel
    remembers would add up.
    """
    if _held and _held[0] is not cache:
        _held.pop().clear()
    if not _held:
        _held.append(cache)


def returned(rows: Iterable) -> Iterator:
    """``rows``; at their end, memory that Arrow keeps for later goes back to the system."""
    yield from rows
    pa.default_memory_pool().release_unused()


def digests(words: Iterable[bytes]) -> np.ndarray:
    """One row of two 64-bit lanes per word."""
    hold(_digests)
    return np.frombuffer(b"".join(map(_digests.__getitem__, words)), "<u8").reshape(-1, 2)


class Numbers(dict):
    """Words by number, 0, 1, ... as they are first seen: equal for equal words, and only for these."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Equal values for equal runs of ``k`` ids (each below 2**31), and only for these."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    bits = max(1, int(ids.max()).bit_length())
    out = ids
    for j in range(1, k):
        if bits * k <= 63:
            out = (out[:-1] << bits) | ids[j:]
        else:
            out = np.unique((out[:-1] << 32) | ids[j:], return_inverse=True)[1].astype(np.int64)
    return out


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return column.fill_null("")


def blocks(column: pa.Array | pa.ChunkedArray, *, lower: bool = False, hashed: bool = True) -> Iterator[WordBlock]:
    """Word blocks of a string column, in order; a null text has no words."""
    column = _plain(column)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield _block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower, hashed)
        first = last


def _block(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool) -> WordBlock:
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    bounds = np.searchsorted(starts, offsets, "left")
    block = WordBlock(first, data, offsets, bounds, starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if hashed and len(starts):
        lanes = []
        for i in range(len(block)):
            if bounds[i + 1] - bounds[i] <= STEP_WORDS:
                lanes.append(digests(block.words(i)))
            else:  # the words of a very long text, some at a time
                for at in range(bounds[i], bounds[i + 1], STEP_WORDS):
                    lanes.append(digests(data[starts[at] : ends[min(at + STEP_WORDS, bounds[i + 1]) - 1]].tobytes().split()))
        both = np.concatenate(lanes)
        block.hashes, block.second = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    return block


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:n])
    for j in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n])
    return out


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``k`` words, mixed pair by pair, not polynomials."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, at = mix(hashes), 1, None, 0
    while True:
        if k & size:
            out = power[at : at + n] if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + power[at : at + n])
            at += size
        size *= 2
        if size > k:
            return out
        half = size // 2
        power = mix(power[:-half] * np.uint64(0xD6E8FEB86659FD93) + power[half:])


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of all windows of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_BASE_INV, n))
