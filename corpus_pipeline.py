"""A corpus pipeline of five stages: classify, dedup lines, dedup near copies, decontaminate, encode.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and
returns the columns of `documents` (the last one adds the pieces). Stages are written as
Parquet in the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, lines, pieces, quality, queries, simhash
from strandline.llm.common import read_table, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on labelled rows of `docs`.

    A null or empty text is scored by the bias alone; a very long one is scored whole; repeated rows stay or go together. Without labels every
    score is 0.5 and all rows stay. An empty table stays empty, and columns other than those of `documents` go, here and in all stages.
    """
    model = queries.fitted_quality(spark, docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, name="_score").filter("_score >= 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows are cut out; n_chars follows; a document that loses its whole text goes.

    Null and empty texts, and those of fewer than three lines, stay as they are, with the n_chars that they came with. Rows equal in doc_id and
    text lose the same lines; the earliest occurrence is that of the least doc_id, nulls last. A text of any length is one row of windows.
    """
    cleaned = lines.line_dedup(docs.select(*COLUMNS))
    emptied = (F.size("removed_lines") > 0) & (F.trim("text") == "")
    return cleaned.filter(~emptied).withColumn("n_chars", _size_of_changed()).select(*COLUMNS)


def _size_of_changed() -> Column:
    return F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, then the least text hash.

    Near copies share 0.8 of their five-word shingles, or have fingerprints at most three bits apart. Null, empty and blank texts are
    one group. Of rows equal in doc_id and text one stays; a null doc_id stays only if no other id is in the group. Whole texts are compared.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), size=simhash.WIDE, similarity=simhash.SIMILAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows with a null or empty text hold none and stay; repeated rows stay or go together; very long texts are searched whole, and so are
    rows with a null doc_id. Without items all rows stay.
    """
    return decontaminate.clean(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the pieces of its text and the text decoded from them.

    A null text has null pieces and a null decoded text, an empty one the piece of the leading blank. Every row comes out as often as it went in;
    a text of any length is encoded whole.
    """
    return pieces.encode_texts(docs.select(*COLUMNS), queries.PIECES_MODEL)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encode),
]

#: The classifier and the Viterbi search are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is removed once the next one's is complete; the last one stays, since the result reads it."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
