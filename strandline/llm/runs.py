"""Periodic runs of words, by power-of-two naming.

Karp, Miller and Rosenberg's names: at level k every stretch of 2**k words has a number, equal
for equal stretches, made from the numbers of its two halves. Words that match those p words
further on come in rows, and a run of period p and length m is such a row of m - p, so one point
of a grid of that step lies in it. Grid points whose words match are extended both ways by the
names, from the highest level down. Nothing is hashed and no suffixes are sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textblocks import Block, blocks

#: A run has so many words at least, and twice its period.
LEAST = 12
#: Points of the grids that are looked at together.
_POINTS = 1 << 20

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def names(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Levels of names of the stretches within each text; -1 where no other stretch of the text is equal.

    `first` is each text's first place, with the end as one more entry. Each level has one more entry, -1, at its end. There are as many
    levels as have equal stretches, so no two places of a text match for 2**levels words.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels: list[np.ndarray] = []
    at, keys = np.arange(len(words)), text << 32 | words
    while len(at):
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        level = np.full(len(words) + 1, -1, np.int64)
        level[at] = np.where(count[number] > 1, number, -1)
        if level.max() < 0:
            break
        # the next level: both halves have equals elsewhere, and lie in one text, since numbers differ between texts
        half = 1 << len(levels)
        levels.append(level)
        at = at[at + half < len(words)]
        at = at[(level[at] >= 0) & (level[at + half] >= 0)]
        at = at[text[at] == text[at + half]]
        keys = level[at] << 32 | level[at + half]
    return levels


def _matching(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words match from places i and j on, or before them."""
    n = len(levels[0]) - 1
    length = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        level, size = levels[k], 1 << k
        x, y = (i - length - size, j - length - size) if back else (i + length, j + length)
        x, y = (np.where((x < 0) | (y > n), n, x), np.where((x < 0) | (y > n), n, y))
        named = level[x]
        length += np.where((named >= 0) & (named == level[y]), size, 0)
    return length


def _grid(first: np.ndarray, levels: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of all points at which a run may be, some at a time.

    A run of period p has `step` matches or more in a row, step = max(least - p, p), so texts whose longest equal stretches are
    shorter need no such period.
    """
    n = np.diff(first)
    longest = np.zeros(len(n), np.int64)
    for k, level in enumerate(levels):
        some = np.unique(np.searchsorted(first, np.flatnonzero(level >= 0), side="right") - 1)
        longest[some] = (2 << k) - 1
    periods = np.where((longest >= -(-least // 2)) & (n >= least), np.minimum(n // 2, longest), 0)
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    # (text, period) rows, cut so that neither rows nor points of a part are many
    for low in range(0, total, _POINTS):
        row = np.arange(low, min(low + _POINTS, total))
        text = np.searchsorted(ends, row, side="right")
        p = row - (ends - periods)[text] + 1
        step = np.maximum(least - p, p)
        fits = step <= longest[text]
        text, p, step = text[fits], p[fits], step[fits]
        points = -(-(n[text] - p) // step)
        sums = np.cumsum(points)
        at = 0
        while at < len(sums):
            before = int(sums[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(sums, before + _POINTS)))
            part = np.repeat(np.arange(at, stop), points[at:stop])
            nth = np.arange(len(part)) - (sums - points)[part] + before
            yield first[text[part]] + nth * step[part], p[part]
            at = stop


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all texts, by start, then period; places count over all texts.

    `words` are numbers, equal for equal words. A run is given once, with its smallest period.
    """
    levels = names(words, first)
    found = [np.zeros((0, 3), np.int64)]
    for i, p in _grid(first, levels, least) if levels else ():
        named = levels[0][i]
        match = (named >= 0) & (named == levels[0][i + p])
        i, p = i[match], p[match]
        after, before = _matching(levels, i, i + p, False), _matching(levels, i, i + p, True)
        whole = after + before + p >= np.maximum(least, 2 * p)
        found.append(_smallest(np.stack([i - before, i + after + p, p], axis=1)[whole]))
    return tuple(_smallest(np.concatenate(found)).T)


def _smallest(found: np.ndarray) -> np.ndarray:
    """One row for each start and end. A stretch of twice a multiple of its period ends where it does for the period itself."""
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(ids: list, first: np.ndarray) -> np.ndarray:
    """For each place the place whose word stands there: texts whose id's crc32 is divisible by ten repeat a passage from some word on."""
    source = np.arange(first[-1])
    for t, id_ in enumerate(ids):
        n = int(first[t + 1] - first[t])
        if id_ is None or not n:
            continue
        h = zlib.crc32(str(id_).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[t] + a : first[t + 1]] = first[t] + a + np.arange(n - a) % p
    return source


def _summaries(block: Block, source: np.ndarray, least: int) -> list[tuple]:
    """The columns of RESULT for each text of a block whose words stand as in `source`."""
    words, first = block.words(), block.first
    codes = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, period = runs(codes[source], first, least)
    # words after the first period of any run go
    edge = np.zeros(len(source) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge)[:-1] == 0
    size = (block.end - block.start + 1)[source]
    text = words.take(pa.array(source[kept]))
    joined = memoryview(text.buffers()[2] or b"")
    stops = np.append(0, np.cumsum(np.where(kept, size, 0)))[first]
    own = np.searchsorted(start, first)
    out = []
    for t in range(block.texts):
        a, b = own[t], own[t + 1]
        s, m, q = start[a:b] - first[t], end[a:b] - start[a:b], period[a:b]
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), m.tolist(), q.tolist()))
        best: tuple = (None,) * 4
        if b > a:
            w = int(np.lexsort((q, s, -m))[0])
            best = int(s[w]), int(m[w]), int(q[w]), 1000 * int(m[w]) // int(q[w])
        collapsed = joined[stops[t] : max(stops[t], stops[t + 1] - 1)]  # without the last blank
        out.append((int(b - a), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
    return out


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """One row for each row of `df`: doc_id and the columns of RESULT.

    Words are what stands between blanks and the control characters 9 to 13, as they are written. A run is a stretch of words with
    smallest period q, of `least` words or more and at least 2 * q, that can't be made longer. `start` to `exponent_milli` tell of the
    longest run (then the first, then the one of the smallest period) and are null without one; `runs_sha256` digests the list of all
    runs and `collapsed_sha256` the words that are left if each run keeps its first q words.

    With `plant`, texts are first changed as in `planted`. Null and empty texts have no words and no runs; a null id is never changed.
    Repeated rows come out as often as they went in, an empty table gives an empty one, other columns are not read. Whole
    texts are read; memory grows with the longest text (8 bytes a word and level), not with the number of its grid points.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, block in blocks(b.column(1), lower=False):
                ids = b.column(0).slice(at, block.texts)
                source = planted(ids.to_pylist(), block.first) if plant else np.arange(block.first[-1])
                columns = zip(*_summaries(block, source, least))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *(c.split()[0] for c in RESULT.split(", "))])

    return df.select(F.col(doc_id).alias("id"), text).mapInArrow(batches, f"id {kind}, {RESULT}").withColumnRenamed("id", doc_id)
