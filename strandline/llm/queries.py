"""The queries that the driver entry registers for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import audit, decontaminate, graphs, lines, lm, pieces, quality, runs, secrets, sharding, simhash, substrings, tiff
from strandline.llm import sql as twins
from strandline.llm.common import read_table

#: A public model that the tokenizer folder holds; encode_texts takes any path.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled rows that the quality classifier is fitted on at most.
QUALITY_SAMPLE = 12_000


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, PIECES_MODEL, keep=["doc_id", "text"])
    return coded.select("doc_id", "n_pieces", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark).drop("text_hash")


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scores(read_table(spark, sf_dir, "documents"))
    return found.withColumn("mean_log_score", F.col("log_score") / F.greatest("n_words", F.lit(1)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    language = secrets.learn_language(docs)
    forest = secrets.train_forest(secrets.sample_findings(spark, language), language)
    found = secrets.scan(docs, forest, language)
    return found.select("doc_id", "start", F.length("candidate").alias("size"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shard_rows(rows, "doc_id", shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_units(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed_lines", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))
    return cleaned.select("doc_id", "text", F.array_join(spans, ",").alias("removed_lines"))


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(read_table(spark, sf_dir, "documents"))


def fitted_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.train(quality.sample_labelled(documents, labels, "quality", QUALITY_SAMPLE))


def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted_quality(spark, docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (~quality.learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)


def op12_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbours(read_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_benchmark_decontamination,
        op3_stupid_backoff,
        op4_secret_scan,
        op5_ring_sharding,
        op6_substring_dedup,
        op7_line_windows,
        op8_tiff_media,
        op9_quality_ftrl,
        op10_simhash_grid,
        op11_periodic_runs,
        op12_pruned_graph,
        op13_filter_audit,
    )
}

#: Where SQL can express the result.
SQL: dict[str, str] = {"op7_line_windows": twins.LINE_WINDOWS, "op13_filter_audit": twins.FILTER_AUDIT}
