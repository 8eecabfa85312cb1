"""What filters do to each other: survivors of every subset of filters, and of every order of applying them.

Each document is reduced to a mask of the filters that it fails. Counts of equal masks in each part of the
corpus are turned by the subset-zeta transform (one cumulative sum along each filter's axis) into the documents that survive
any subset; a step of any order is then the difference between two neighbouring subsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage
from strandline.llm.textblocks import Block, blocks

LETTERS = "ABCDE"
#: A: fewer words. B: fewer different words in 100 words. C: more capitals in 100 characters. D: holds any of these.
FEWEST_WORDS, DIFFERENT_SHARE, CAPITAL_SHARE, MARKS = 200, 50, 2, "#$%&*|"
#: What is counted for each mask, and summed over the steps.
COUNTS = ("n", "good", "toxic")


def _marks(block: Block, texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    text = np.repeat(np.arange(block.texts), np.diff(block.first))
    codes = pc.dictionary_encode(block.words()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    different = np.bincount(np.unique(text << 32 | codes) >> 32, minlength=block.texts)
    words = np.diff(block.first)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    def count(bytes_: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(bytes_))[offsets - offsets[0]])

    capitals, characters = count((raw >= 65) & (raw <= 90)), count(raw & 0xC0 != 0x80)
    marked = np.isin(np.arange(256), list(MARKS.encode()))[raw]
    fails = (words < FEWEST_WORDS, 100 * different < DIFFERENT_SHARE * words, 100 * capitals > CAPITAL_SHARE * characters, count(marked) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def text_failures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask) of each row: bits 0 to 3 of the mask are the filters A to D that the whole text fails.

    Texts of equal digests (BLAKE2b, 128 bits) count as identical.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, block in blocks(b.column(2), lower=False):
                texts = pc.fill_null(b.column(2).slice(at, block.texts), "")
                digests = [hashlib.blake2b(t.as_buffer() or b"", digest_size=16).digest() for t in texts]
                columns = [b.column(0).slice(at, block.texts), b.column(1).slice(at, block.texts), pa.array(digests, pa.binary()), pa.array(_marks(block, texts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, part string, digest binary, mask int")


def mask_counts(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, those of `labels.quality` 1 and those of `labels.toxic` 1.

    Bit 4 of the mask is filter E: a row with a smaller doc_id has the identical text. Ranks of equal texts aren't taken: the
    least doc_id of each digest is aggregated, and rows are looked up in it by digest and doc_id together, so that many copies
    meet in no task. Null ids rank last: they fail E if a row with an id has their text. Rows equal in id and text are documents of
    their own and none fails E for another. A label holds if any row of `labels` with the id says so; null ids have no labels.
    """
    rows = text_failures(df, doc_id, text, part).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows)  # read twice below, texts once
    heads = rows.groupBy("digest").agg(F.min("doc_id").alias("head")).select(F.col("digest").alias("d"), "head")
    first = F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("head"))
    marked = rows.join(heads, first, "left").withColumn("mask", F.col("mask") + F.when(F.col("d").isNull(), 1 << 4).otherwise(0))
    told = labels.groupBy(F.col("doc_id").alias("of")).agg(*(F.max((F.col(c) == 1).cast("long")).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))))
    marked = marked.join(told, F.col("doc_id") == F.col("of"), "left")
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]))


def survivors(counts: np.ndarray) -> np.ndarray:
    """For each set of filters (last axis, as bits) how many documents fail none of them; `counts` are by failed filters.

    The documents whose mask lies within the complement of the set: the zeta transform, read from its end.
    """
    bits = int(counts.shape[-1]).bit_length() - 1
    cube = counts.reshape(*counts.shape[:-1], *(2,) * bits)
    for axis in range(1, bits + 1):
        cube = np.cumsum(cube, axis=-axis)
    return cube.reshape(counts.shape)[..., ::-1]


def order_steps(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters (one letter each, bit 0 first) and step, from the rows of `mask_counts`.

    kept and removed: documents after and at this step. redundant: those that fail its filter, removed earlier. unique_fails:
    those that fail its filter only. good_lost and toxic_lost: removed here with that label. shapley: what the filter removes,
    summed over all orders. All are counts within the part, zeros included; an empty table gives no rows.
    """
    size = len(letters)
    orders = list(permutations(range(size)))
    filters = np.array(orders).ravel()
    bits = (1 << np.array(orders)).astype(np.int64)
    after = np.cumsum(bits, axis=1).ravel()
    before, own = after - bits.ravel(), bits.ravel()
    named = pa.array(np.repeat(["".join(letters[i] for i in o) for o in orders], size).tolist())
    steps = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders)))
    whole = F.collect_list(F.struct("mask", *COUNTS)).alias("masks")  # at most one for each mask

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, masks in zip(b.column(0), b.column(1).to_pylist()):
                by_mask = np.zeros((len(COUNTS), 1 << size), np.int64)
                for m in masks:
                    by_mask[:, m["mask"]] = [m[c] for c in COUNTS]
                left = survivors(by_mask)
                gone = left[:, before] - left[:, after]
                failing = left[0, 0] - left[0, own]
                shapley = np.bincount(filters, weights=gone[0], minlength=size).astype(np.int64)[filters]
                found = [left[0, after], gone[0], failing - gone[0], by_mask[0, own], gone[1], gone[2], shapley]
                parts = pa.array([part.as_py()] * len(own), pa.string())
                yield pa.RecordBatch.from_arrays([parts, named, steps, *map(pa.array, found)], names=names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names[3:])
    return counts.groupBy("part").agg(whole).mapInArrow(batches, schema)


def filter_audit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """`order_steps` of the five filters on whole texts; null texts are empty, null parts the empty string.

    Texts of any length are read as they are, a very long one in one piece. Further columns of either table are not read.
    """
    return order_steps(mask_counts(df, labels, doc_id, text, part))
