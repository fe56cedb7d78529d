"""Arrow string columns as bytes, words and word hashes, a block at a time.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. Its
hash is a 64-bit polynomial over its bytes, taken from running sums so that no
Python code runs per word, and mixed at the end. Blocks of about a megabyte keep
the temporary arrays small, whatever the length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SYMBOL = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task doesn't hold it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with freed memory given back after each partition."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and the last ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most size bytes of text each, or a single text, so that arrays made of them stay small."""
    _, at = text_bytes(batch.column(column))
    here, n = 0, len(at) - 1
    while here < n:
        stop = max(here + 1, int(np.searchsorted(at, at[here] + size, side="right")) - 1)
        yield batch.slice(here, stop - here)
        here = stop


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of bytes raw, where texts begin at the offsets at."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_block(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each begins."""
    start, end = word_spans(raw, at)
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[LOWER[raw]] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _cuts(raw: np.ndarray, at: np.ndarray, size: int) -> list[int]:
    """Places to cut the bytes into blocks of about size: between texts or, within a long one, at white space."""
    cuts, here, n = [0], 0, len(raw)
    while n - here > size:
        k = int(np.searchsorted(at, here + size, side="right")) - 1
        nxt = int(at[k])
        if nxt <= here:  # one text spans the block
            stop, nxt = int(at[k + 1]), 0
            probe = here + size
            while probe < stop:
                gap = np.flatnonzero(WHITE[raw[probe : min(stop, probe + size)]])
                if len(gap):
                    nxt = probe + int(gap[0])
                    break
                probe += size
            nxt = nxt or stop
        cuts.append(nxt)
        here = nxt
    if cuts[-1] != n:
        cuts.append(n)
    return cuts


def hash_words(column: pa.Array, size: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and each text's number of words."""
    raw, at = text_bytes(column)
    hashes, counts = [], np.zeros(len(at) - 1, dtype=np.int64)
    cuts = _cuts(raw, at, size) if len(raw) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        a, b = int(np.searchsorted(at, lo, side="right")) - 1, int(np.searchsorted(at, hi, side="left"))
        inner = np.clip(at[a : b + 1], lo, hi) - lo
        found, start = _hash_block(raw[lo:hi], inner)
        hashes.append(found)
        # texts that are empty share an offset with the next one; the last of them owns the bytes
        owner = np.searchsorted(at, start + lo, side="right") - 1
        counts += np.bincount(owner, minlength=len(counts))[: len(counts)]
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, one text after another, and each set's size.

    With fewer words than the width the whole sequence is one shingle; without
    words the set is empty.
    """
    words, counts = hash_words(column)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(words)
    if n >= width:
        joined = words[: n - width + 1].copy()
        for k in range(1, width):
            joined = mix(joined) * np.uint64(_BASE) + words[k : n - width + 1 + k]
        joined = mix(joined + np.uint64(width))
    else:
        joined = np.zeros(0, np.uint64)
    parts, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e - s >= width:
            own = joined[s : e - width + 1].copy()
            own.sort()
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif e > s:
            whole = words[s : s + 1].copy()
            for k in range(s + 1, e):
                whole = mix(whole) * np.uint64(_BASE) + words[k : k + 1]
            own = mix(whole + np.uint64(e - s))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes
