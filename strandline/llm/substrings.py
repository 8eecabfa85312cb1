"""Substring dedup by hashing normalised units: lines, cut further inside.

A passage may stand anywhere in a line, so a unit ends with its line, at the first end of a
sentence by which it has SHORT characters, or, once it has LONG words, after a word that its
own hash picks; equal passages are cut alike soon after they begin. A unit is normalised (words
by single blanks, lower case) and digested; digests are grouped over all documents and the
earliest-ranked occurrence stays. Later ones are removed, with their places in the original
text retained, where so many stand in a row that they make up a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import cut_lineage, own_names
from strandline.llm.textblocks import xxh64

#: Characters that a unit has before the end of a sentence ends it; blanks don't count.
SHORT = 30
#: Words that a unit has before it may end inside a sentence: after a word whose hash is a multiple of PICKED.
LONG, PICKED = 16, 8
#: Characters without blanks, about 20 words, that repeated units in a row have before they are removed.
PASSAGE = 100
#: Bytes of text that are cut at once, unless one text is longer.
BLOCK_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
#: First bytes of the characters U+3000 to U+9FFF, which are written without blanks: each is a word.
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEA] = True
#: … 。 ！ ？ as three bytes each.
_WIDE_ENDS = [int.from_bytes(c.encode(), "big") for c in "…。！？"]


class _Tokens:
    """Words of a text column: byte places in `raw`, and the bytes with single blanks between words, lower case or not."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        raw, n = self.raw, len(self.raw)
        blank, alone = _BLANK[raw], _ALONE[raw]
        self.char = (raw & 0xC0) != 0x80
        begins = ~blank
        begins[1:] &= blank[:-1]
        begins |= alone
        after = np.flatnonzero(alone) + 3
        after = after[after < n]
        begins[after] |= ~blank[after]
        inner = self.offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] |= ~blank[inner]
        self.start = np.flatnonzero(begins)
        # a word ends at the next blank, word or text
        stops = blank | begins
        stops[inner] = True
        stop_at = np.append(np.flatnonzero(stops), n)
        self.stop = stop_at[np.searchsorted(stop_at, self.start, "right")]
        # one blank is kept in front of a word that has any there
        kept = ~blank
        spaced = self.start[1:][blank[self.start[1:] - 1]] - 1 if len(self.start) else self.start
        kept[spaced] = True
        self.packed = np.append(np.where(blank[kept], np.uint8(32), raw[kept]), np.zeros(8, np.uint8))
        self.place = np.append(0, np.cumsum(kept))


def _cuts(text: _Tokens, hashes: np.ndarray) -> np.ndarray:
    """Number of the first word of each unit, and one beyond the last word."""
    raw, start, stop = text.raw, text.start, text.stop
    last = raw[stop - 1]
    wide = np.zeros(len(stop), bool)
    three = np.flatnonzero(stop >= 3)
    at = stop[three]
    wide[three] = np.isin(raw[at - 3].astype(np.int64) << 16 | raw[at - 2].astype(np.int64) << 8 | raw[at - 1], _WIDE_ENDS)
    ends = _ENDS[last] | wide
    picked = hashes % np.uint64(PICKED) == 0
    lines = np.append(0, np.cumsum(raw == 10))[start] + np.searchsorted(text.offsets, start, "right")
    fresh = np.ones(len(start) + 1, bool)
    fresh[1:-1] = lines[1:] != lines[:-1]
    chars = np.append(0, np.cumsum(text.char & ~_BLANK[raw]))
    until = chars[stop]
    # only words that may end a unit are looked at one by one
    at = np.flatnonzero(ends | picked)
    begin, held = 0, 0
    cuts: list[int] = []
    stretch = np.flatnonzero(fresh)
    line_of = stretch[np.searchsorted(stretch, at, "right") - 1]
    for k, is_end, is_picked, total, line in zip(*(x.tolist() for x in (at, ends[at], picked[at], until[at], line_of))):
        if line > begin:
            begin, held = line, int(chars[start[line]])
        if (is_end and total - held >= SHORT) or (is_picked and k + 1 - begin >= LONG):
            begin, held = k + 1, total
            cuts.append(begin)
    fresh[cuts] = True
    return np.flatnonzero(fresh)


def cut_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """Units of texts: number of the text, place in characters, characters without blanks, and two hashes that make the digest."""
    text, lower = _Tokens(column), _Tokens(pc.utf8_lower(column))
    if not len(text.start):
        return {k: np.zeros(0, t) for k, t in (("text", np.int64), ("start", np.int64), ("stop", np.int64), ("size", np.int64), ("high", np.uint64), ("low", np.uint64))}
    place, begins = lower.place, lower.place[lower.start]
    hashes = xxh64(lower.packed, begins, place[lower.stop] - begins)
    cuts = _cuts(text, hashes)
    first, last = cuts[:-1], cuts[1:] - 1
    where = begins[first]
    length = place[lower.stop[last]] - where
    chars = np.append(0, np.cumsum(text.char))
    solid = np.append(0, np.cumsum(text.char & ~_BLANK[text.raw]))
    start, stop = text.start[first], text.stop[last]
    of = np.searchsorted(text.offsets, start, "right") - 1
    base = chars[text.offsets[of]]
    return {
        "text": of,
        "start": chars[start] - base,
        "stop": chars[stop] - base,
        "size": solid[stop] - solid[start],
        "high": xxh64(lower.packed, where, length, 1),
        "low": xxh64(lower.packed, where, length, 2),
    }


def units(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, hash, at, start, stop, size, high, low) of every unit; `at` counts the units of a text, places are characters from 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = np.array(pc.binary_length(b.column(2)), dtype=np.int64)
            done = 0
            while done < len(sizes):
                stop = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), BLOCK_BYTES)))
                found = cut_texts(b.column(2).slice(done, stop - done))
                of = found["text"]
                rows = pa.array(of + done, pa.int32())
                at = np.arange(len(of)) - np.searchsorted(of, of)
                numbers = [pa.array(x.astype(np.int32)) for x in (at, found["start"], found["stop"], found["size"])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), *numbers, pa.array(found["high"].view(np.int64)), pa.array(found["low"].view(np.int64))],
                    names=["id", "hash", "at", "start", "stop", "size", "high", "low"],
                )
                done = stop

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, f"id {kind}, hash long, at int, start int, stop int, size int, high long, low long")


def repeated_units(df: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row for each unit to remove: (doc_id, start, stop, kept_doc_id, kept_start, kept_stop, text_hash, digest).

    `start` and `stop` are the place of the unit in the original text. The earliest occurrence is that of
    the least doc_id (nulls last), then of the least text hash, then of the least place. Later ones are removed
    where units in a row that all have an earlier occurrence hold `passage` characters or more without
    blanks; with 0 every later occurrence goes. Rows equal in doc_id and text are one document: their
    units are no occurrences of one another, and a row comes out once. Null and empty texts have no units.
    """
    found = units(df, doc_id, text)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"), F.col("at"), F.col("start"), F.col("stop"))
    earliest = found.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.max(rank).alias("last")).filter("kept != last").drop("last")
    # as a table of its own, so that both sides of the join are dealt out anew and a hot digest can be split
    earliest = cut_lineage(earliest)
    later = found.join(earliest, ["high", "low"]).filter(rank != F.col("kept")).drop_duplicates(["id", "hash", "at"])
    if passage > 0:
        # units of one document are as many as its text has
        own = Window.partitionBy("id", "hash")
        later = later.withColumn("row", F.col("at") - F.row_number().over(own.orderBy("at")))
        later = later.withColumn("held", F.sum("size").over(Window.partitionBy("id", "hash", "row"))).filter(F.col("held") >= passage)
    return later.select(
        F.col("id").alias(doc_id),
        "start",
        "stop",
        F.col("kept.id").alias("kept_doc_id"),
        F.col("kept.start").alias("kept_start"),
        F.col("kept.stop").alias("kept_stop"),
        F.col("hash").alias("text_hash"),
        F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))).alias("digest"),
    )


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """All rows of `df` with the repeated units cut out of `text`, and `removed`: their places in the original, in order.

    Null texts stay null. A column named `removed` is replaced; all others stay as they are, whatever their names.
    """
    kept = [c for c in df.columns if c.lower() != "removed"]
    id_, mark, spans_ = own_names(df, "id", "mark", "spans")
    spans = (
        repeated_units(df.select(doc_id, text), doc_id, text, passage)
        .groupBy(F.col(doc_id).alias(id_), F.col("text_hash").alias(mark))
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans_))
    )
    docs = df.select(*(F.col(f"`{c}`") for c in kept)).alias("d")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col(mark))
    joined = docs.join(spans, same, "left")
    own = F.col(f"d.`{text}`")
    # what lies between the removed places: from the end of one to the start of the next
    ends = F.concat(F.array(F.lit(0)), F.transform(spans_, lambda r: r["stop"]))
    starts = F.concat(F.transform(spans_, lambda r: r["start"]), F.array(F.length(own)))
    between = F.zip_with(ends, starts, lambda e, s: F.substring(own, e + 1, F.greatest(s - e, F.lit(0))))
    cleaned = F.when(F.col(spans_).isNull(), own).otherwise(F.array_join(between, ""))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select(*(cleaned.alias(c) if c == text else F.col(f"d.`{c}`") for c in kept), F.coalesce(spans_, empty).alias("removed"))
