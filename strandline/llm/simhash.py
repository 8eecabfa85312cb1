"""SimHash near-duplicates: fingerprints that differ in a few bits at most are linked.

Fingerprints are embedded as vectors of bit counts, one for each two-bit segment. The
Manhattan distance of two vectors is never more than the number of differing bits, so a
range join in the embedded space loses no link, and an exact comparison of the bits follows.
The join grid: the vectors are halved, and within distance 3 one half is within 1. A half's
vector is the cell; vectors one apart have totals one apart, so each fingerprint looks in its
own cell and in those with one count raised by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, own_names
from strandline.llm.components import component_roots
from strandline.llm.textblocks import Block, blocks

SHINGLE = 3
DISTANCE = 3
#: Shingle size of the similarity that near copies have at least: shared shingles over all different ones of both texts.
WIDE, SIMILAR = 5, 0.8
#: A sketch has so many bands of so many least hashes; a pair of similarity s shares no band with probability
#: (1 - s ** _ROWS) ** _BANDS, 3 in 100,000 at 0.8.
_BANDS, _ROWS = 20, 4
_ODD_FACTORS = np.random.default_rng(10).integers(0, 1 << 63, _BANDS * _ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# byte -> its bits spread over the eight bytes of a long
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Hashes whose bits are counted in bytes before the bytes could run over.
_GROUP = 255


def _shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and the text of each; a text of fewer words is one shingle."""
    words = np.diff(block.first)
    begin, text = block.runs(size)
    short = np.flatnonzero((words > 0) & (words < size))
    hashes = np.concatenate([block.hashed(begin, size), block.hashed(block.first[short], words[short])])
    return hashes, np.concatenate([text, short])


def block_fingerprints(block: Block, size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included: bits set in over half of the hashes.

    A text of fewer words than a shingle counts as one shingle; one without words gives zero.
    """
    hashes, text = _shingles(block, size)
    order = np.argsort(text, kind="stable")
    hashes, text = hashes[order], text[order]
    out = np.zeros(block.texts, np.uint64)
    if not len(text):
        return out
    some, first, n = np.unique(text, return_index=True, return_counts=True)
    parts = -(-n // _GROUP)
    part_of = np.repeat(np.arange(len(some)), parts)
    starts = first[part_of] + (np.arange(len(part_of)) - (np.cumsum(parts) - parts)[part_of]) * _GROUP
    raw = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.add.reduceat(_SPREAD[raw[:, i]], starts).view(np.uint8).reshape(-1, 8) for i in range(8)], axis=1)
    totals = np.add.reduceat(counts.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = np.packbits(totals * 2 > n[:, None], axis=1, bitorder="little")
    out[some] = bits.view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each whole text, as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, block in blocks(b.column(1)):
                fps = block_fingerprints(block).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(fps)), pa.array(fps)], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(batches, f"key {kind}, fp long").withColumnRenamed("key", key)


_HALF, _ODD = 0xFFFFFFFF, 0x55555555


def embedded(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of half a fingerprint, packed in two bits each."""
    return half.bitwiseAND(F.lit(_ODD)) + F.shiftright(half, 1).bitwiseAND(F.lit(_ODD))


def cells(half: int, raised: bool) -> Column:
    """Cells of one half of `fp`: its own and, if asked for, those with one count raised by one."""
    own = embedded(F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(_HALF)))
    keys = [own]
    if raised:
        for i in range(16):
            count = F.shiftright(own, 2 * i).bitwiseAND(F.lit(3))
            keys.append(F.when(count < 2, own + F.lit(1 << (2 * i))))
    return F.transform(F.array_compact(F.array(*keys)), lambda k: k * 2 + half)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints in column `fp` that differ in at most `distance` (up to 3) bits.

    A pair may come from either half of the grid, and so twice.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the halved grid finds distances up to 3")
    home = distinct.select(F.col("fp").alias("b"), F.explode(F.concat(cells(0, False), cells(1, False))).alias("cell"))
    look = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(cells(0, True), cells(1, True))).alias("cell"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return look.join(home, "cell").filter(near & (F.col("a") != F.col("b"))).select("a", "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of `df`: (doc_id, fp, component_id), the last being the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids are never
    the smallest; a component with no other id has a null component_id. Repeated rows are linked
    by their equal fingerprints and come out as often as they went in.
    """
    marked = cut_lineage(fingerprints(df, doc_id, text))
    distinct = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    roots = cut_lineage(component_roots(links(distinct, distance), "a", "b"))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(doc_id, "fp", "component_id")


def distinct_shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, texts that have any, first hash of each of them): every text's different shingles."""
    hashes, text = _shingles(block, size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    hashes = hashes[new]
    some, first = np.unique(text[new], return_index=True)
    return hashes, some, first


def block_sketches(block: Block, size: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have words, mark of the set of shingles of each, its bands): equal sets have equal marks."""
    hashes, some, first = distinct_shingles(block, size)
    if not len(some):
        return some, np.zeros(0, np.uint64), np.zeros((0, _BANDS), np.uint64)
    bands = np.repeat(np.arange(1, _BANDS + 1, dtype=np.uint64)[:, None], len(some), axis=1)
    for i, factor in enumerate(_ODD_FACTORS):
        band = (bands[i // _ROWS] ^ np.minimum.reduceat(hashes * factor, first)) * np.uint64(0x9E3779B185EBCA87)
        bands[i // _ROWS] = band ^ band >> np.uint64(32)
    return some, np.add.reduceat(hashes, first), bands.T


def sketches(df: DataFrame, key: str, text: str, size: int = WIDE) -> DataFrame:
    """(key, fp, mark, bands) of each whole text; a text without words has mark 0 and no bands."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, block in blocks(b.column(1)):
                fps = block_fingerprints(block).view(np.int64)
                some, found, bands = block_sketches(block, size)
                marks, ends = np.zeros(block.texts, np.uint64), np.zeros(block.texts, np.int32)
                marks[some], ends[some] = found, _BANDS
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(fps)), pa.array(fps), pa.array(marks.view(np.int64)), listed], names=["key", "fp", "mark", "bands"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(batches, f"key {kind}, fp long, mark long, bands array<long>")


def _sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """(mark, grams): the different shingles of the texts of (mark, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, block in blocks(b.column(1)):
                hashes, some, first = distinct_shingles(block, size)
                listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(hashes)), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, block.texts).take(pa.array(some)), listed], names=["mark", "grams"])

    return df.select("mark", text).mapInArrow(batches, "mark long, grams array<long>").dropDuplicates(["mark"])


def _across(texts: DataFrame, linked: DataFrame) -> DataFrame:
    """(band, fp, mark, root, members) of those of (band, fp, mark) in bands that reach over more than one component."""
    roots = component_roots(linked, "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = texts.select("band", "fp", "mark").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # tables of their own, here and below, so that a hot band can be split in the joins
    return cut_lineage(_open(rooted, "band").select("band", "fp", "mark", "root", "members"))


def _open(rows: DataFrame, *keys: str) -> DataFrame:
    """Those rows whose keys are in more than one component (`root`), with the number of rows of the keys."""
    counted = rows.groupBy(*keys).agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.count(F.lit(1)).alias("members"))
    return rows.join(cut_lineage(counted.filter("_r != _s").select(*keys, "members")), list(keys))


def _with_heads(held: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, head, head_fp) and, for each text of a head's bands, (head, mark, whole, size, inside, others).

    The head is the text that meets most others in its bands: of copies edited here and there, that is what they were made from.
    `whole` and `size` are the shingles of the head and the text, `inside` those in both, `others` what only the text has.
    """
    met = held.groupBy("mark").agg(F.sum("members").alias("met"))
    heads = held.join(met, "mark").groupBy("band").agg(F.max(F.struct("met", "mark", "fp")).alias("h"))
    heads = cut_lineage(heads.select("band", F.col("h.mark").alias("head"), F.col("h.fp").alias("head_fp")))
    pairs = cut_lineage(held.join(heads, "band").select("head", "mark").distinct())
    both = pairs.join(sets, "mark").join(sets.select(F.col("mark").alias("head"), F.col("grams").alias("g")), "head")
    others = F.array_except("grams", "g")
    counts = (F.size("g").alias("whole"), F.size("grams").alias("size"), (F.size("grams") - F.size(others)).alias("inside"))
    return heads, cut_lineage(both.select("head", "mark", *counts, others.alias("others")))


def _candidates(held: DataFrame, heads: DataFrame, compared: DataFrame, least: float) -> DataFrame:
    """Pairs (fa, a, fb, b) of texts in one band and different components that can reach the similarity.

    At similarity s, texts of m and n shingles share s / (1 + s) of m + n. What they share is inside the band's head, or they
    have a shingle in common that the head lacks; so pairs come by the head if both have enough inside it, and by such shingles.
    """

    def reach(shared: Column) -> Column:  # the most shingles that a text sharing so many may have
        return F.floor(shared * ((1 + least) / least) + 1e-6) - F.col("size")

    def paired(rows: DataFrame, *keys: str) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
        can = F.expr("x.root < y.root AND x.size <= y.most AND y.size <= x.most")
        ends = ((f"{side}.{c}", out) for side, c, out in (("x", "fp", "fa"), ("x", "mark", "a"), ("y", "fp", "fb"), ("y", "mark", "b")))
        counts = (F.least("x.inside", "y.inside").alias("inside"), (F.col("x.size") + F.col("y.size")).alias("both"))
        return x.join(y, [*on, can]).select("x.head", *(F.col(c).alias(out) for c, out in ends), *counts)

    names = ["fa", "a", "fb", "b"]
    texts = cut_lineage(held.drop("members").join(heads.select("band", "head"), "band").join(compared.drop("others"), ["head", "mark"]))
    by_head = texts.withColumn("most", reach(F.col("inside")))
    smallest = cut_lineage(by_head.groupBy("band").agg(F.min("size").alias("smallest")))
    by_head = cut_lineage(_open(by_head.join(smallest, "band").filter("smallest <= most"), "band"))

    grams = texts.select("head", "mark", "fp", "root").distinct().join(compared, ["head", "mark"])
    grams = grams.select("head", "mark", "fp", "root", "size", "inside", F.explode("others").alias("gram"))
    grams = cut_lineage(_open(grams, "head", "gram"))
    more = grams.groupBy("head", "mark", "fp").agg(F.count(F.lit(1)).alias("more"))
    by_gram = grams.join(more, ["head", "mark", "fp"]).withColumn("most", reach(F.col("inside") + F.col("more")))
    by_gram = cut_lineage(by_gram.filter(F.col("most") + 1e-6 >= F.col("size") * least))
    # a row for each shared shingle that the head lacks
    sharing = paired(by_gram, "head", "gram").groupBy("head", *names).agg(F.min("inside").alias("inside"), F.min("both").alias("both"), F.count(F.lit(1)).alias("n"))
    sharing = sharing.filter((F.col("n") + F.col("inside")) * (1 + least) + 1e-6 >= F.col("both") * least)
    return paired(by_head, "band").select(*names).union(sharing.select(*names)).distinct()


def _similar(keyed: DataFrame, text: str, nodes: DataFrame, linked: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) of fingerprints for texts that share a band and whose similarity is `least` or more, as far as components need them.

    First each text of a band is compared with the band's head. Bands within one component have nothing to add then, so a
    large group of near copies isn't paired up; in the others all that can still be similar are compared.
    """
    held = _across(nodes.select("fp", "mark", F.explode("bands").alias("band")), linked)
    at = nodes.join(held.select("mark").distinct(), "mark").groupBy("mark").agg(F.min("first").alias("first"))
    at = cut_lineage(at.select("mark", F.col("first.id").alias("_at_id"), F.col("first.hash").alias("_at_hash")))
    same = F.col("_id").eqNullSafe(F.col("_at_id")) & (F.col("_hash") == F.col("_at_hash"))
    sets = cut_lineage(_sets(keyed.select("_id", "_hash", text).join(at, same).select("mark", text), text, size))
    heads, compared = _with_heads(held, sets)
    close = compared.filter(F.col("inside") / (F.col("whole") + F.col("size") - F.col("inside")) >= least).select("head", "mark")
    named = close.join(heads.select("head", "head_fp").distinct(), "head").join(held.select("mark", "fp").distinct(), "mark")
    found = cut_lineage(named.select(F.col("head_fp").alias("a"), F.col("fp").alias("b")).filter("a != b"))
    pairs = cut_lineage(_candidates(_across(held, linked.unionByName(found)), heads, compared, least))
    x, y = (sets.select(F.col("mark").alias(m), F.col("grams").alias(g)) for m, g in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    close = shared / (F.size("x") + F.size("y") - shared) >= least
    rest = pairs.join(y, "b").join(x, "a").filter(close).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return found.unionByName(cut_lineage(rest))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WIDE, similarity: float | None = None) -> DataFrame:
    """The rows of `df`, all columns, that stand for their groups of near copies: one row of each group.

    Near copies are texts linked by their fingerprints as in `near_duplicates` and, if `similarity` is given, texts
    whose shingles of `size` words have a Jaccard similarity of so much or more. Pairs of the second kind are looked up by bands of least
    hashes and compared exactly; groups are chains of either.
    The row with the least doc_id stays (nulls last), then the least text hash; of rows equal in both,
    any one. Null, empty and blank texts have fingerprint zero and are one group. Columns of any names stay as they are.
    """
    own, hashed = F.col(doc_id), F.coalesce(F.xxhash64(text), F.lit(0))
    keyed = df.select(own.alias("_id"), hashed.alias("_hash"), F.col(text).alias("text"))
    marked = cut_lineage(sketches(keyed.select(F.struct("_id", "_hash").alias("key"), "text"), "key", "text", size))
    rank = F.struct(F.col("key._id").isNull().alias("none"), F.col("key._id").alias("id"), F.col("key._hash").alias("hash"))
    # equal marks have equal bands
    nodes = cut_lineage(marked.groupBy("fp", "mark").agg(F.min(rank).alias("first"), F.first("bands").alias("bands")))
    distinct = nodes.groupBy("fp").agg(F.min("first").alias("first"))
    linked = cut_lineage(links(distinct))
    if similarity is not None:
        linked = linked.unionByName(_similar(keyed, "text", nodes, linked, size, similarity))
    roots = component_roots(linked, "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first"))
    id_, mark, times = own_names(df, "id", "mark", "times")
    repeats = marked.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    kept = cut_lineage(
        chosen.select(F.struct(F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash")).alias("key"))
        .join(repeats, "key")
        .select(F.col("key._id").alias(id_), F.col("key._hash").alias(mark), F.col("times").alias(times))
    )
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col(id_)) & (F.coalesce(F.xxhash64(F.col(f"d.`{text}`")), F.lit(0)) == F.col(mark))
    out = df.alias("d").join(kept.filter(F.col(times) == 1), same, "left_semi")
    if kept.filter(F.col(times) > 1).limit(1).count():
        again = df.alias("d").join(kept.filter(F.col(times) > 1), same).dropDuplicates([id_, mark])
        out = out.unionByName(again.select(*(F.col(f"d.`{c}`") for c in df.columns)))
    return out


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
