"""Words, shingles and terms of whole Arrow batches of texts, by numpy.

Texts are looked at as one run of UTF-8 bytes; nothing here loops over words.  Rows
are handled in slices of about ``SLICE`` bytes (one longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(n: int, start: int) -> np.ndarray:
    return mix((np.arange(n, dtype=U) + U(start)) * U(0x9E3779B97F4A7C15))


_BYTE = _stream(256, 1)
_PLACE = _stream(1024, 1 << 20) | U(1)
_SHINGLE = _stream(64, 1 << 40) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: all but the six white-space characters.
BLACK = np.ones(256, dtype=bool)
BLACK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of terms: letters and digits, and all that is not ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them and their end) of each slice;
    null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, of) of the words: byte positions, and for each row the number of
    words before it (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_word = inside[data]
    joined = np.zeros(len(data) + 1, dtype=bool)  # the byte before belongs to the same word
    joined[1:-1] = is_word[:-1] & is_word[1:]
    joined[offsets] = False
    start = np.flatnonzero(is_word & ~joined[:-1])
    end = np.flatnonzero(is_word & ~joined[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int | None = None) -> np.ndarray:
    """A hash of each word, A-Z as a-z; ``most``: of its first bytes only."""
    global _PLACE
    if not len(start):
        return np.zeros(0, dtype=U)
    length = end - start if most is None else np.minimum(end - start, most)
    if length.max() > len(_PLACE):
        _PLACE = _stream(int(length.max()) * 2, 1 << 20) | U(1)
    first = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(int(first[-1] + length[-1])) - np.repeat(first, length)
    values = _BYTE[LOWER[data[np.repeat(start, length) + place]]] * _PLACE[place]
    return mix(np.add.reduceat(values, first) + length.astype(U))


def shingles(hashes: np.ndarray, of: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, number before each row): every run of n words; of a row with
    fewer the run of all, of a row without words none."""
    counts = np.diff(of)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    before = np.zeros(len(of), np.int64)
    np.cumsum(made, out=before[1:])
    # Short rows are read past their end; those words are blanked out.
    first = np.repeat(of[:-1] - before[:-1], made) + np.arange(before[-1])
    size = np.repeat(np.minimum(counts, n), made)
    padded = np.concatenate([hashes, np.zeros(n, dtype=U)])
    total = size.astype(U)
    for k in range(n):
        total = total + np.where(k < size, padded[first + k], U(0)) * _SHINGLE[k]
    return mix(total), before


def distinct(values: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The distinct values of each row, ascending."""
    return [np.unique(values[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
