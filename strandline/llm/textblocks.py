"""Words of many texts at once, on the bytes that Arrow hands over.

A block lower-cases A-Z (if asked to), cuts texts at blanks and the control characters 9 to 13 (or at all
marks), and keeps
the words of all its texts in one byte array with exactly one blank between words, so that a
run of words is one slice of it. Slices are hashed with XXH64, all of a block together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEED = 42
#: Bytes of text that make up one block, unless a single text is longer.
BLOCK_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits.
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


@dataclass
class Block:
    """`first`: index of each text's first word, with one more entry at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of `size` words within a text, and the text of each."""
        counts = np.maximum(0, np.diff(self.first) - size + 1)
        text = np.repeat(np.arange(self.texts), counts)
        skipped = np.cumsum(counts) - counts
        return self.first[:-1][text] + np.arange(len(text)) - skipped[text], text

    def words(self) -> pa.Array:
        """All words as an Arrow binary array, each with the blank after it."""
        offsets = np.append(self.start, self.end[-1] + 1 if len(self.end) else 0)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])

    def hashed(self, word: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """XXH64 of the runs that begin at these words."""
        start = self.start[word]
        return xxh64(self.data, start, self.end[word + size - 1] - start)


def block_of(texts: pa.Array, only_words: bool = False, lower: bool = True) -> Block:
    """Texts of an Arrow string column; null counts as empty. With `only_words`, ASCII marks part words as blanks do."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = (_MARKS if only_words else _BLANK)[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = ~blank[cuts]
    at = np.flatnonzero(begins)
    # a word ends at the next blank or at the next text
    stops = blank.copy()
    stops[cuts] = True
    stops[0:1] = stops[0:1] & blank[0:1]
    stop_at = np.append(np.flatnonzero(stops), len(raw))
    until = stop_at[np.searchsorted(stop_at, at + 1)]
    first = np.searchsorted(at, offsets)
    # pack the words with one blank after each
    size = until - at
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(at):
        kept = ~blank
        packed = np.full(int(end[-1]) + 1 + 8, 32, np.uint8)
        spot = np.ones(len(packed), bool)
        spot[end] = False
        spot[int(end[-1]) :] = False
        packed[spot] = _LOWER[raw[kept]] if lower else raw[kept]
    else:
        packed = np.full(8, 32, np.uint8)
    return Block(packed, start, end, first)


def blocks(texts: pa.Array, only_words: bool = False, block_bytes: int = BLOCK_BYTES, lower: bool = True) -> Iterator[tuple[int, Block]]:
    """Blocks of about `block_bytes` over a column, each with the index of its first text."""
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at = 0
    while at < len(sizes):
        held = np.cumsum(sizes[at:])
        stop = at + max(1, int(np.searchsorted(held, block_bytes)))
        yield at, block_of(texts.slice(at, stop - at), only_words, lower)
        at = stop


#: Longer slices are hashed one by one.
_LONG = 512
#: Slices hashed together: few enough for the work on them to stay in a processor's cache.
_TOGETHER = 1 << 15


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of slices of a byte array that has eight bytes to spare at its end."""
    if len(start) > _TOGETHER:
        parts = range(0, len(start), _TOGETHER)
        return np.concatenate([xxh64(data, start[i : i + _TOGETHER], length[i : i + _TOGETHER], seed) for i in parts])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + _P5, np.uint64)
        at, left = start.astype(np.int64), length.astype(np.int64)
        many = np.flatnonzero((left >= 32) & (left < _LONG))
        if len(many):
            lanes = [np.full(len(many), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            place, stripes = at[many], left[many] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for i in range(4):
                    lanes[i][on] = _rotate(lanes[i][on] + eight[place[on] + 32 * k + 8 * i] * _P2, 31) * _P1
            own = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                own = (own ^ _rotate(lane * _P2, 31) * _P1) * _P1 + _P4
            h[many] = own
            at[many] += stripes * 32
            left[many] -= stripes * 32
        h += length.astype(np.uint64)
        for k in range(3):
            on = np.flatnonzero((left >= 8) & (left < _LONG))
            if not len(on):
                break
            h[on] = _rotate(h[on] ^ _rotate(eight[at[on]] * _P2, 31) * _P1, 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero((left >= 4) & (left < _LONG))
        h[on] = _rotate(h[on] ^ four[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for k in range(3):
            on = np.flatnonzero((left > 0) & (left < _LONG))
            h[on] = _rotate(h[on] ^ data[at[on]].astype(np.uint64) * _P5, 11) * _P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
    return h
