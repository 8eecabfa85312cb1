"""Language-model scores with stupid backoff, from n-gram count tables partitioned by hash.

Each document's n-grams (one to ORDER words) are hashed. A block of documents sends its
different n-grams with their counts to the partitions of the count table that the hashes name;
a partition adds up the counts of all blocks and joins the totals back to what each block
asked for. The block then scores its words and sums them per document. By default a document's
own occurrences don't count for it.

What moves is each different n-gram of a block once, in about six bytes, its count on the way
back, and the words of the texts as numbers. A row of (n-gram, document, count) for each of them
has 32 bytes before compression. A message holds a block's n-grams for one partition, so there are never more
messages than rows in that plain join; `block_bytes` and `partition_bytes` are to grow with
the memory of the executors (about 30 bytes of a worker for each byte of either).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.llm.common import cut_lineage
from strandline.llm.fastwords import mixed
from strandline.llm.textblocks import blocks

#: Words of the longest n-grams.
ORDER = 3
#: What a step down to the shorter n-gram costs.
BACKOFF = 0.4
#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose n-grams share one partition of the count table.
PARTITION_BYTES = 8 << 20
#: Words that are scored together, unless one text has more.
SCORED_WORDS = 1 << 19

_LOW_BITS = 40


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers of one kind, all their first bytes before all second ones, compressed."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueezed(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 64-bit hashes: the five low bytes of each, and the compressed steps of what lies above."""
    high = (keys >> np.uint64(_LOW_BITS)).astype(np.uint32)
    return keys.view(np.uint8).reshape(-1, 8)[:, : _LOW_BITS // 8].tobytes(), squeezed(np.diff(high, prepend=np.uint32(0)))


def unpacked_keys(low: bytes, high: bytes) -> np.ndarray:
    raw = np.frombuffer(low, np.uint8).reshape(-1, _LOW_BITS // 8)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, : raw.shape[1]] = raw
    steps = unsqueezed(high, np.uint32, len(raw))
    return keys.view(np.uint64).ravel() | np.cumsum(steps, dtype=np.uint64) << np.uint64(_LOW_BITS)


class Words:
    """The words of a block of documents, hashed; `first`: index of each document's first word, and the end."""

    def __init__(self, first: np.ndarray, hashes: np.ndarray, order: int):
        self.first, self.order = first, order
        self.document = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.within = np.arange(len(hashes)) - first[self.document]
        self.ends: list[np.ndarray] = []  # by order, the last words of its n-grams
        grams, own = [], hashes
        for n in range(1, order + 1):
            if n > 1:
                own = mixed(mixed(np.concatenate([own[:1], own[:-1]])) ^ hashes)
            self.ends.append(np.flatnonzero(self.within >= n - 1))
            grams.append(own[self.ends[-1]])
        self.grams = np.concatenate(grams)

    def scored(self, totals: np.ndarray, place: np.ndarray, leave_out: bool) -> dict[str, np.ndarray]:
        """Sums per document, the words that are scored alone without their division by all words.

        `totals` are counts over all documents, `place` tells where among them each of `grams` is.
        """
        documents, n = len(self.first) - 1, len(self.document)
        logs, used, last, at = np.zeros(n), np.ones(n, np.int64), np.zeros(n), 0
        unseen = np.zeros(n, bool)
        for size, ends in enumerate(self.ends, 1):
            own = place[at : at + len(ends)]
            at += len(ends)
            count = np.zeros(n)
            count[ends] = totals[own]
            if leave_out:
                in_document = (self.document[ends] * len(totals) + own).astype(np.uint64)
                _, which, times = np.unique(in_document, return_inverse=True, return_counts=True)
                count[ends] -= times[which]
            if size == 1:
                unseen, logs = count == 0, np.log(np.maximum(count, 1))
            else:
                seen = count > 0
                context = np.concatenate([last[:1], last[:-1]])
                lower = np.where(self.within >= size - 1, logs + np.log(BACKOFF), logs)
                logs = np.where(seen, np.log(np.maximum(count, 1)) - np.log(np.maximum(context, 1)), lower)
                used[seen] = size
            last = count

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(self.document, weights=values, minlength=documents).astype(float)

        counts = {"n_backoffs": used < np.minimum(self.order, self.within + 1), "n_unseen": unseen, "n_alone": used == 1}
        return {"n_words": np.diff(self.first)} | {k: total(v).astype(np.int64) for k, v in counts.items()} | {"log_part": total(logs)}


def _packs(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(number, ids, first word of each document, hashes of the words) of each block, the same each time a partition is read."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for at, block in blocks(b.column(1), block_bytes=block_bytes):
            yield number, b.column(0).slice(at, block.texts), block.first.astype(np.int64), block.hashed(np.arange(int(block.first[-1])), 1)
            number += 1


def packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block: the words as numbers, the most frequent first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, first, hashes in _packs(it, block_bytes):
            words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
            by_times = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_times] = np.arange(len(words), dtype=np.uint32)
            columns = (pa.array([x], t) for x, t in ((first.tobytes(), pa.binary()), (squeezed(rank[codes]), pa.binary()), (words[by_times].tobytes(), pa.binary())))
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed, *columns], names=["block", "ids", "first", "codes", "words"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(batches, f"block long, ids array<{kind}>, first binary, codes binary, words binary")


def requests(rows: DataFrame, parts: int, order: int, block_bytes: int) -> DataFrame:
    """What each block asks of each partition: its n-grams whose hashes lie in the partition's range, and their counts."""
    names = ["part", "block", "low", "high", "counts"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
        for number, _, first, hashes in _packs(it, block_bytes):
            keys, counts = np.unique(Words(first, hashes, order).grams, return_counts=True)
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            out = [(p, number, *packed_keys(keys[a:z]), squeezed(counts[a:z].astype(np.uint32))) for p, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 1000]), kinds)], names=names)

    return rows.mapInArrow(batches, "part int, block long, low binary, high binary, counts binary")


def _mark(keys: np.ndarray) -> int:
    """A sum of hashes, by which sets of n-grams are told apart."""
    return int(mixed(keys).sum(dtype=np.uint64).view(np.int64))


def totals(requested: DataFrame, parts: int) -> DataFrame:
    """What each block asked of each partition of the count table, with the counts over all blocks."""

    def add_up(table: pa.Table) -> pa.Table:
        keys = [unpacked_keys(a, b) for a, b in zip(table["low"].to_pylist(), table["high"].to_pylist())]
        counts = np.concatenate([unsqueezed(c, np.uint32, len(k)) for c, k in zip(table["counts"].to_pylist(), keys)])
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(unique)).astype(np.uint64)[place]
        replies = [squeezed(x) for x in np.split(total, cuts)]
        sizes, marks = pa.array([len(k) for k in keys], pa.int32()), pa.array([_mark(k) for k in keys], pa.int64())
        return table.select(["part", "block"]).append_column("n", sizes).append_column("mark", marks).append_column("totals", pa.array(replies, pa.binary()))

    return requested.repartition(parts, "part").groupBy("part").applyInArrow(add_up, "part int, block long, n int, mark long, totals binary")


def scores(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    leave_one_out: bool = True,
    block_bytes: int | None = None,
    partition_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_backoffs, n_unseen, log_score): the sum over a document's words of the natural log of S.

    S of a word after the order - 1 before it is c(all) / c(those before) if that n-gram occurs, else BACKOFF
    times S of the word after one word less; at last it is c(word) / N, where a word that doesn't occur counts as
    one that occurs once. c counts over all of `df`, N is the number of its words; with `leave_one_out` a
    document's own n-grams and words are left out of both. `n_backoffs` are the words that took a step down,
    `n_unseen` those that don't occur (elsewhere). Words are cut at blanks, A-Z in lower case.

    Documents without words (null and empty texts too) score 0. A text of any length is one block and is counted whole. Repeated rows are documents of their own: they
    count, and come out, as often as they are there. Other columns don't matter. `df` is read three times (once for
    its size) and must come in the same order each time, as files do; if it doesn't, the job stops.
    """
    block_bytes, partition_bytes = block_bytes or BLOCK_BYTES, partition_bytes or PARTITION_BYTES
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    names = ["n_words", "n_backoffs", "n_unseen", "n_alone", "log_part"]

    def score(blocks_: pa.Table, replies: pa.Table) -> pa.Table:
        found = sorted(zip(*(replies[c].to_pylist() for c in ("part", "n", "totals"))))
        total = np.concatenate([unsqueezed(t, np.uint64, n) for _, n, t in found] or [np.zeros(0, np.uint64)])
        (row,) = blocks_.to_pylist()
        first = np.frombuffer(row["first"], np.int64)
        words = np.frombuffer(row["words"], np.uint64)[unsqueezed(row["codes"], np.uint32, int(first[-1]))]
        unique = np.unique(Words(first, words, order).grams)
        marks = np.array(replies["mark"].to_pylist(), np.int64).view(np.uint64).sum(dtype=np.uint64).view(np.int64)
        if len(unique) != len(total) or _mark(unique) != int(marks):
            raise ValueError("the rows came in another order the second time; write them to a table first")
        parts, at = [], 0
        while at < len(first) - 1:  # some documents at once
            stop = max(at + 1, int(np.searchsorted(first, first[at] + SCORED_WORDS, "right")) - 1)
            own = Words(first[at : stop + 1] - first[at], words[first[at] : first[stop]], order)
            grams, place = np.unique(own.grams, return_inverse=True)
            parts.append(own.scored(total[np.searchsorted(unique, grams)].astype(np.float64), place, leave_one_out))
            at = stop
        sums = {k: np.concatenate([p[k] for p in parts]) for k in names}
        return pa.table({"id": pa.array(row["ids"], id_type), **{k: sums[k] for k in names}})

    replies = totals(requests(rows, parts, order, block_bytes), parts)
    # blocks without any words ask for nothing, and still get their rows
    grouped = packed(rows, block_bytes).repartition(parts, "block").groupBy("block").cogroup(replies.repartition(parts, "block").groupBy("block"))
    parts_of = cut_lineage(grouped.applyInArrow(score, f"id {kind}, {', '.join(f'{n} long' for n in names[:-1])}, log_part double"))
    n = parts_of.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(n) - (F.col("n_words") if leave_one_out else F.lit(0)), F.lit(1))
    return parts_of.select(
        F.col("id").alias(doc_id), "n_words", "n_backoffs", "n_unseen", (F.col("log_part") - F.col("n_alone") * F.log(others)).alias("log_score")
    )
