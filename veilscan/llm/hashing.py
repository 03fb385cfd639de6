"""Word boundaries and 64-bit hashes of words and word runs, for whole Arrow
columns at once.

A word's hash is a polynomial over random codes of its bytes, a run's hash a
polynomial over its words' hashes; both are finished with a mixing step. Equal
runs always get equal hashes; different runs collide with a chance of about
2^-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20_24))
_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
#: The same codes with A-Z read as a-z.
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_RUN = U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII character but letters and digits, for terms without punctuation.
_BETWEEN = _SPACE.copy()
_BETWEEN[:128] = [not chr(c).isalnum() for c in range(128)]
_LOW_BITS = 12
_POWERS = np.full(1 << _LOW_BITS, _BASE, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)
_HIGH_STEP = _POWERS[-1:] * _BASE
#: Bytes hashed at a time.
_CHUNK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n+1 row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return whole[first:last], offsets - first if len(offsets) else np.zeros(1, np.int64)


class Words:
    """Words of a column: byte spans, hashes, and for each row the range
    ``rows[i]:rows[i + 1]`` of its words. With ``terms`` all ASCII characters
    but letters and digits separate, else white space does."""

    def __init__(self, column: pa.Array, lower: bool = False, terms: bool = False):
        self.bytes, self.offsets = text_buffer(column)
        self.starts, self.ends = _spans(self.bytes, self.offsets, _BETWEEN if terms else _SPACE)
        self.rows = np.searchsorted(self.starts, self.offsets)
        self.codes = _LOWER if lower else _CODES
        self.hashes = _word_hashes(self.bytes, self.starts, self.ends, self.codes)

    def beginnings(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word, apart from those of
        whole words and of other sizes."""
        ends = np.minimum(self.ends, self.starts + size)
        return mix64(_word_hashes(self.bytes, self.starts, ends, self.codes) + _of_length(size))

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; entry i is meaningless where
        the row of word i ends before word i + k."""
        return mix64(run_sums(self.hashes, k) + _of_length(k))


def _spans(buffer: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(buffer)
    inside = ~between[buffer]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    borders = np.unique(offsets[(offsets > 0) & (offsets < size)])
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of the words, a bounded number of bytes at a time (a longer word
    forms a step of its own)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, side="right")))
        lengths = ends[at:to] - starts[at:to]
        begins = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        inner = np.arange(total) - np.repeat(begins, lengths)
        bytes_at = inner + np.repeat(starts[at:to], lengths)
        powers = _POWERS[inner & ((1 << _LOW_BITS) - 1)]
        high = int(lengths.max()) >> _LOW_BITS
        if high:
            steps = np.full(high + 1, _HIGH_STEP[0], np.uint64)
            steps[0] = 1
            powers = powers * np.multiply.accumulate(steps)[inner >> _LOW_BITS]
        sums = np.add.reduceat(codes[buffer[bytes_at]] * powers, begins)
        out[at:to] = mix64(sums ^ (lengths.astype(np.uint64) * _BASE))
        at = to
    return out


def run_sums(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial of each run of k hashes, by doubling; same length as the
    input, the last k - 1 entries meaningless."""
    out, length = np.zeros_like(hashes), 0
    power, factor = hashes, np.array([_RUN])  # runs of 2^j hashes, and the factor that skips them
    size, bit = 1, k
    while bit:
        if bit & 1:
            out = power if length == 0 else _joined(out, power, length, factor)
            length += size
        bit >>= 1
        if bit:
            power = _joined(power, power, size, factor)
            factor = factor * factor
            size *= 2
    return out


def _of_length(k: int) -> np.ndarray:
    return np.array([k], np.uint64) * _BASE


def _joined(first: np.ndarray, second: np.ndarray, skip: int, factor: np.ndarray) -> np.ndarray:
    """first[i] * factor + second[i + skip]."""
    out = first * factor
    if skip < len(out):
        out[:-skip] += second[skip:]
    return out


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row
    with fewer words has its whole sequence as one, a row without words none."""
    words = Words(column, lower)
    runs = words.runs(k)
    for first, last in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        count = last - first
        if count >= k:
            found = np.sort(runs[first : last - k + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            yield found[fresh]
        elif count:
            yield mix64(run_sums(words.hashes[first:last], count)[:1] + _of_length(count))
        else:
            yield runs[:0]
