"""Numpy views of Arrow string columns: words, word hashes and window hashes without Python strings.

Every function works on one slice of documents at a time (``slices``), so a task's memory is bounded by
``SLICE_BYTES`` or by its longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
U64 = np.uint64

_SEEDS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]


def non_space_table() -> np.ndarray:
    """True for the bytes of words split at ASCII white space."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def lower_alnum_tables() -> tuple[np.ndarray, np.ndarray]:
    """Word bytes (digits, letters, anything beyond ASCII) and the byte map that lower-cases A-Z."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return word[lower], lower


LOWER = lower_alnum_tables()[1]
NON_SPACE = non_space_table()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive slices of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    held = column.buffers()[2] if n else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's range of words (n + 1 entries)."""
    inside = table[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: its XXH64, or for up to seven bytes a bijection of them and their number."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    few = np.minimum(lengths, 7).astype(np.uint64)
    out = mix((eight[starts] & ((U64(1) << (few * U64(8))) - U64(1)) | few << U64(56)) ^ U64(_SEEDS[which]))
    longer = np.flatnonzero(lengths > 7)
    if len(longer):
        held, digest, seed = data.tobytes(), xxhash.xxh64_intdigest, _SEEDS[which]
        out[longer] = [digest(held[a:z], seed) for a, z in zip(starts[longer].tolist(), ends[longer].tolist())]
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; the caller drops runs that cross documents.

    Runs of doubling length are joined pairwise, each join finished by ``mix``.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    join = lambda a, b: mix(a * U64(_SEEDS[0]) + b)
    out, done, run, size, left = None, 0, words, 1, width
    while left:
        if left & 1:
            part = run[done : done + n]
            out = part if out is None else join(out, part)
            done += size
        left >>= 1
        if left:
            run, size = join(run[:-size], run[size:]), 2 * size
    return out


def document_of(word_ranges: np.ndarray) -> np.ndarray:
    """The document's number for each word."""
    return np.repeat(np.arange(len(word_ranges) - 1), np.diff(word_ranges))


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' bytes with one space after each word, and each word's start there."""
    lengths = ends - starts + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    out = np.full(int(at[-1]), 32, np.uint8)
    where = np.repeat(starts - at[:-1], lengths) + np.arange(int(at[-1]))
    body = np.ones(int(at[-1]), bool)
    body[at[1:] - 1] = False
    out[body] = data[where[body]]
    return out, at
