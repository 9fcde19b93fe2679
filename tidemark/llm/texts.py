"""Arrow and numpy helpers on batches of texts, shared by the operators.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text; no byte of
a multi-byte character lies in that set, so byte rules and character rules agree.
Batches are cut into slices of bounded bytes, so that the memory of a task depends on
its longest text and not on the number of texts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX = np.random.Generator(np.random.PCG64(20240601)).integers(
    1, 2**63, size=(2, 256 + 4096), dtype=np.uint64
) | np.uint64(1)


def string_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``limit`` bytes of ``column`` at most.

    A single text above the limit is a slice of its own.
    """
    _, offs = string_data(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of consecutive texts: byte spans and the first word of each text."""

    raw: np.ndarray  # bytes of all texts
    texts: np.ndarray  # offset of each text in raw, one more than texts
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # byte behind each word
    first: np.ndarray  # first word of each text, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def place(self) -> np.ndarray:
        """Position of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)

    def left(self) -> np.ndarray:
        """Number of words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def joined(self) -> np.ndarray:
        """Bytes of all words, one after the other."""
        return self.raw[~_SPACE[self.raw]]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word: a sum of byte values times factors of their places.

        Beyond 4 096 bytes, the factors are multiplied by another one for each further 4 096, so
        that no place shares its factor with another.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.stop - self.start
        chars = self.joined()
        begin = np.cumsum(length) - length
        place = np.arange(len(chars)) - np.repeat(begin, length)
        value = _MIX[seed][chars] * _MIX[seed][256 + (place & 4095)]
        if length.max() > 4096:
            far = np.flatnonzero(place > 4095)
            value[far] *= stir((place[far] >> 12).astype(np.uint64)) | np.uint64(1)
        return stir(np.add.reduceat(value, begin) + length.astype(np.uint64))


def words(column: pa.Array) -> Words:
    """Find the words of every text; a null text has none."""
    raw, offs = string_data(column)
    inside = ~_SPACE[raw]
    before = np.empty(len(raw) + 1, bool)  # is the byte before each byte part of the same text's word
    before[0] = False
    before[1:] = inside
    cut = offs[(offs > 0) & (offs < len(raw))]
    opens = inside & ~before[:-1]
    opens[cut] = inside[cut]
    start = np.flatnonzero(opens)
    after = np.empty(len(raw), bool)
    if len(raw):
        after[:-1] = ~inside[1:]
        after[-1] = True
        after[cut - 1] = True
    stop = np.flatnonzero(inside & after) + 1
    return Words(raw, offs, start, stop, np.searchsorted(start, offs))


def stir(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; the last ``width - 1`` places have none.

    Runs of lengths 1, 2, 4, ... are combined by doubling, and the binary parts of
    ``width`` are chained, so the work is a few passes whatever the width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, done, out = values, 1, 0, None
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else stir(out * np.uint64(0xA24BAED4963EE407) + part)
            done += size
        if done == width:
            return out
        power = stir(power[:-size] * np.uint64(0x9FB21C651E98DF25) + power[size:])
        size *= 2
