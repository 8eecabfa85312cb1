"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the benchmark items are looked up in every document, and around the hits the
document's words are aligned with the item's; the alignment's score over the best possible one
tells how much of the item the document holds, edits allowed. Hits of n-grams that occur in
unusually many documents for their item are many: where no rare one is near, the words in
common are counted first, and stretches that can't reach the threshold are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import own_names
from strandline.llm.textblocks import Block, block_of, blocks

SEED_WORDS = 4
#: A seed is rare if it is in no more documents than this many times its item's median seed.
RARE = 4.0
#: Share of the best possible score from which a document holds an item.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
#: Words of the items that are sent to every task at once, unless one item has more; a larger benchmark is taken in parts.
MOST_BROADCAST = 300_000
#: A word of an item, as texts are cut: letters and digits of ASCII, and all other characters beyond it.
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(column: pa.Array) -> Iterator[tuple[int, Block]]:
    return blocks(pc.utf8_lower(column), only_words=True)


@dataclass(frozen=True)
class Item:
    """The words of a benchmark item, hashed, and its n-grams with their first places."""

    number: object
    words: np.ndarray
    seeds: dict[int, list[int]]
    size: int


def item_of(number: object, text: str | None) -> Item:
    block = block_of(pc.utf8_lower(pa.array([text], pa.string())), only_words=True)
    n = int(block.first[-1])
    size = min(SEED_WORDS, n)
    seeds: dict[int, list[int]] = {}
    if n:
        for at, h in enumerate(block.hashed(np.arange(n - size + 1), size).view(np.int64).tolist()):
            seeds.setdefault(h, []).append(at)
    return Item(number, block.hashed(np.arange(n), 1) if n else np.zeros(0, np.uint64), seeds, size)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: (score, end of it in `words`)."""
    steps = np.arange(len(words) + 1) * GAP
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(words) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(words == w, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        # a gap in the item: the best earlier cell of the row less the way to here
        row = np.maximum.accumulate(row + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def spans(item: Item, hits: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """Stretches of a document's words that may hold the item, from hits (place in the document, place in the item)."""
    n, slack = len(item.words), max(4, len(item.words) // 2)
    out: list[tuple[int, int]] = []
    for place, own in sorted(hits):
        begin, stop = max(0, place - own - slack), min(count, place + n - own + slack)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out


def may_hold(item: np.ndarray, words: np.ndarray, threshold: float) -> bool:
    """False only if no alignment of the two can reach the threshold, by the words that they have in common.

    With m matches, an alignment of score s or more has at most 2 m - s other words, so it spans at most 3 m - s words.
    """
    least = threshold * MATCH * len(item)
    common = np.append(0, np.cumsum(np.isin(words, item)))
    reach = max(1, int((MATCH + 1) * len(item) - least))
    most = int((common[reach:] - common[:-reach]).max()) if len(common) > reach else int(common[-1])
    return MATCH * min(most, int(np.isin(item, words).sum())) >= least


def _hits(block: Block, wanted: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word of the text, seed) of the runs whose hash is in the sorted array `wanted`."""
    begin, text = block.runs(size)
    hashes = block.hashed(begin, size)
    # most hashes are ruled out by their first bits
    some = np.zeros(1 << 20, bool)
    some[(wanted >> np.uint64(44)).astype(np.int64)] = True
    on = np.flatnonzero(some[(hashes >> np.uint64(44)).astype(np.int64)])
    place = np.searchsorted(wanted, hashes[on])
    on = on[wanted[np.minimum(place, len(wanted) - 1)] == hashes[on]] if len(wanted) else on[:0]
    return text[on], begin[on] - block.first[text[on]], hashes[on]


def seed_counts(docs: DataFrame, text: str, items: list[Item]) -> dict[int, int]:
    """Number of documents that hold each seed at least once, for seeds that occur."""
    by_size = _by_size(items)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, block in _blocks(b.column(0)):
                seen = [np.unique(np.stack([t.astype(np.uint64), h]), axis=1)[1] for t, _, h in (_hits(block, w, n) for n, w in by_size.items())]
                hashes, counts = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
                if len(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["seed", "n"])

    # no more rows than the benchmark has seeds
    counted = docs.select(text).mapInArrow(batches, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in counted.collect()}


def _by_size(items: list[Item], keep: set[int] | None = None) -> dict[int, np.ndarray]:
    sizes: dict[int, set[int]] = {}
    for i in items:
        sizes.setdefault(i.size, set()).update(s for s in i.seeds if keep is None or s in keep)
    return {n: np.sort(np.array(sorted(s), np.int64).view(np.uint64)) for n, s in sizes.items() if n and s}


def rare_seeds(items: list[Item], counts: dict[int, int]) -> set[int]:
    """Seeds in no more documents than RARE times the median seed of an item that has them."""
    kept: set[int] = set()
    for i in items:
        if i.seeds:
            most = RARE * max(1.0, float(np.median([counts.get(s, 0) for s in i.seeds])))
            kept |= {s for s in i.seeds if counts.get(s, 0) <= most}
    return kept


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, text_hash, item_id, score, first_word, last_word) for every document and item that it holds.

    `score` is the alignment's score over that of the whole item, 1 for an exact copy; the words count
    from 0 in the document, cut at all marks but letters and digits. Items without words are never held,
    items shorter than a seed only as a whole. A document with several copies of an item gives the best,
    then the first. Documents equal in doc_id and text come out once.

    Null texts hold nothing; with a threshold of 0 or less every document with a seed of an item holds it.
    The benchmark's items are read on the driver, in parts of a bounded number of words, each item in one part; for
    each part the documents are read twice where they lie, and no text is shuffled. Every seed counts, rare or not.
    """
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).dropDuplicates()
    words = rows.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)).alias("cell")).agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(_ITEM_WORD), F.lit(0)))).alias("n"))
    parts: list[list[int]] = [[]]
    held = 0
    for cell, n in sorted((r["cell"], r["n"] or 0) for r in words.collect()):  # 1,024 cells at most
        if parts[-1] and held + n > MOST_BROADCAST:
            parts.append([])
            held = 0
        parts[-1].append(cell)
        held += n
    cell = F.pmod(F.xxhash64("item_id", "text"), F.lit(1024))
    found = [_held(docs, rows.filter(cell.isin(own)) if len(parts) > 1 else rows, doc_id, text, threshold) for own in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _held(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """`contaminated` for a benchmark (item_id, text) whose items can be sent to every task."""
    items = [item_of(r[0], r[1]) for r in benchmark.collect()]
    keep = rare_seeds(items, seed_counts(docs, text, items))
    by_size = _by_size(items)
    places: dict[int, list[tuple[int, int, bool]]] = {}
    for k, i in enumerate(items):
        for s in i.seeds:
            places.setdefault(s, []).extend((k, at, s in keep) for at in i.seeds[s])
    shared = docs.sparkSession.sparkContext.broadcast((items, by_size, places))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_size, places = shared.value
        known: dict[tuple[int, bytes], tuple[int, int]] = {}  # (0, 0) where the threshold is out of reach
        names = ["id", "hash", "item", "score", "first_word", "last_word"]
        for b in it:
            for first_row, block in _blocks(b.column(2)):
                found: dict[tuple[int, int], list[tuple[int, int]]] = {}
                rare: dict[tuple[int, int], list[int]] = {}
                for size, wanted in by_size.items():
                    for t, p, h in zip(*(x.tolist() for x in _hits(block, wanted, size))):
                        for k, own, few in places.get(h if h < 1 << 63 else h - (1 << 64), ()):
                            found.setdefault((t, k), []).append((p, own))
                            if few:
                                rare.setdefault((t, k), []).append(p)
                rows: list[tuple] = []
                for (t, k), hits in found.items():
                    begin, stop = int(block.first[t]), int(block.first[t + 1])
                    words, item = block.hashed(np.arange(begin, stop), 1), items[k]
                    best = (0.0, 0, 0)
                    for lo, hi in spans(item, hits, stop - begin):
                        part = words[lo:hi]
                        mark = (k, part.tobytes())
                        if mark not in known:
                            if len(known) > 20_000:
                                known.clear()
                            near = any(lo <= p < hi for p in rare.get((t, k), ()))
                            known[mark] = align(item.words, part) if near or may_hold(item.words, part, threshold) else (0, 0)
                        score, end = known[mark]
                        share = score / (MATCH * len(item.words))
                        if share >= threshold and share > best[0]:
                            back, length = align(item.words[::-1], part[:end][::-1])
                            best = (share, lo + end - length, lo + end - 1)
                    if best[0]:
                        rows.append((first_row + t, k, *best))
                if rows:
                    at, ks, scores, firsts, lasts = zip(*rows)
                    take = pa.array(at, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(1).take(take), pa.array(ks, pa.int32()), pa.array(scores, pa.float64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                        names=names,
                    )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = rows.mapInArrow(batches, f"id {kind}, hash long, item int, score double, first_word int, last_word int").distinct()
    ids = docs.sparkSession.createDataFrame([(k, i.number) for k, i in enumerate(items)], f"item int, item_id {benchmark.schema["item_id"].dataType.simpleString()}")
    return found.join(F.broadcast(ids), "item").select(F.col("id").alias(doc_id), F.col("hash").alias("text_hash"), "item_id", "score", "first_word", "last_word")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns of any names, that hold no item of the benchmark. Rows with a null text stay."""
    id_, mark = own_names(docs, "id", "mark")
    held = contaminated(docs, benchmark, doc_id, text, threshold=threshold)
    held = held.select(F.col(doc_id).alias(id_), F.col("text_hash").alias(mark)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(mark))
    return docs.join(held, same, "left_anti")
