"""Line dedup on overlapping windows of consecutive lines.

Lines are normalised (blanks folded, trimmed, lower case) and hashed; three in a row make a
window. Windows that occur more than once anywhere keep their earliest occurrence; lines of
the later ones are merged into spans and removed from their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import cut_lineage, own_names


SIZE = 3


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))


def identified(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _hash, text): rows equal in doc_id and text are one document."""
    return df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(_id, _hash, at, digest, check) for every run of `size` lines that are not all blank; `at` counts lines from 0.

    Lines are told apart by two 64-bit hashes, and so are windows.
    """
    lines = F.transform(F.split("text", "\n", -1), normalised)
    both = F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("check"), x).alias("b"))))
    hashed = docs.select("_id", "_hash", both.alias("h"))
    starts = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size))
    runs = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("h", i + 1, size).alias("run")))
    some = F.filter(runs, lambda r: F.exists(r["run"], lambda x: x.isNotNull()))
    digests = F.transform(
        some, lambda r: F.struct(r["at"].alias("at"), F.xxhash64(r["run"]).alias("digest"), F.xxhash64(F.lit("check"), r["run"]).alias("check"))
    )
    return hashed.select("_id", "_hash", F.inline(digests))


def rank_of(at: str = "at") -> Column:
    """Order of occurrences: by doc_id with nulls last, then by text, then by place."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"), F.col(at).alias("at"))


def later_windows(found: DataFrame, size: int = SIZE) -> DataFrame:
    """(_id, _hash, first, last): lines of every occurrence but the earliest; lines of the earliest itself are spared."""
    earliest = (
        found.groupBy("digest", "check")
        .agg(F.min(rank_of()).alias("kept"), F.max(rank_of()).alias("last"))
        .filter("kept != last")
        .select("digest", "check", "kept")
    )
    # as a table of its own, so that both sides of the join are dealt out anew and a hot window can be split
    earliest = cut_lineage(earliest)
    own = F.col("_id").eqNullSafe(F.col("kept.id")) & (F.col("_hash") == F.col("kept.hash"))
    first = F.when(own, F.greatest("at", F.col("kept.at") + size)).otherwise(F.col("at"))
    return (
        found.join(earliest, ["digest", "check"])
        .filter(rank_of() != F.col("kept"))
        .select("_id", "_hash", first.alias("first"), (F.col("at") + size - 1).alias("last"))
        .filter("first <= last")
    )


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document become one; one row for each document with an array of them."""
    whole = Window.partitionBy("_id", "_hash").orderBy("first", "last")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("first") <= F.max("last").over(before) + 1, 0).otherwise(1)
    islands = spans.distinct().withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(whole))
    joined = islands.groupBy("_id", "_hash", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("removed_lines"))


def _without(lines: Column, spans: Column) -> Column:
    """The lines whose numbers are in no span, in time that grows with lines and spans, not with their product."""
    gone = F.flatten(F.transform(spans, lambda r: F.sequence(r["first"], r["last"])))
    # an array of one, so that both are worked out once a text
    whole = F.array(F.struct(lines.alias("lines"), gone.alias("gone")))

    def left(s: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i))

    return F.get(F.transform(whole, left), F.lit(0))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """All rows and columns of `df` with `text` cleaned, and `removed_lines`: array of (first, last) line numbers of the original.

    Null texts stay null and empty ones empty; texts of fewer lines than a window and windows of blank
    lines only never match. Rows equal in doc_id and text are one document and lose the same lines; the
    earliest occurrence is that of the least doc_id (nulls last), then of the least text hash. A text
    that loses all lines is empty. A text of any length is one row of windows. A column named `removed_lines` is
    replaced; all others stay, whatever their names.
    """
    names = [c for c in df.columns if c.lower() != "removed_lines"]
    id_, mark, spans_ = own_names(df, "id", "mark", "spans")
    found = windows(identified(df, doc_id, text).filter(F.col("text").contains("\n")), size)
    spans = merged(later_windows(found, size)).select(F.col("_id").alias(id_), F.col("_hash").alias(mark), F.col("removed_lines").alias(spans_))
    own = F.col(f"d.`{text}`")
    kept = _without(F.split(own, "\n", -1), F.col(spans_))
    same = (F.xxhash64(own) == F.col(mark)) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col(id_))
    joined = df.alias("d").join(spans, same, "left")
    cleaned = F.when(F.col(spans_).isNull(), own).otherwise(F.array_join(kept, "\n"))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return joined.select(*(cleaned.alias(c) if c == text else F.col(f"d.`{c}`") for c in names), F.coalesce(spans_, empty).alias("removed_lines"))
