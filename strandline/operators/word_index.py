"""Full-text search over an inverted index: ranked by BM25, by all words, or by phrase.

Postings (term, id, length, positions) lie in folders by a bucket of the term, so a search opens the folders of its own words only.
Words are runs of letters and digits in lower case; there is no stemming. Ids must tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.statistics import top_per

#: Words of all texts that make up a bucket.
BUCKET_WORDS = 1 << 22
#: Pairs of a query and a text that are added up in one task, and words of queries that are sent to all tasks.
TASK_PAIRS, SENT_WORDS = 1 << 21, 1 << 20
#: Saturation of repeated words, and how much the length of a text counts.
K1, B = 1.2, 0.75


# schemas, since a table without any words leaves no files to tell them
_POSTINGS, _TERMS = "term string, id {}, length int, positions array<int>, bucket int", "term string, df long, bucket int"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def _bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _postings(rows: DataFrame) -> DataFrame:
    """(id, length, term, positions) of rows (id, words): words are sorted within their row, and equal ones are a stretch of it."""
    found = rows.select("id", F.size("words").alias("length"), F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos")))).alias("sorted"))
    begins = F.transform("sorted", lambda w, i: F.when((i == 0) | (w["term"] != F.get("sorted", i - 1)["term"]), i))
    found = found.withColumn("begins", F.filter(begins, lambda i: i.isNotNull()))

    def stretch(begin: Column, k: Column) -> Column:
        return F.slice("sorted", begin + 1, F.coalesce(F.get("begins", k + 1), F.size("sorted")) - begin)

    each = F.transform("begins", lambda b, k: F.struct(F.get("sorted", b)["term"].alias("term"), stretch(b, k)["pos"].alias("positions")))
    return found.select("id", "length", F.inline(each))


def build(df: DataFrame, path: str, id_: str, text: str, buckets: int | None = None) -> None:
    """Writes postings/bucket=… (term, id, length, positions), terms/bucket=… (term, df) and totals (texts, words, buckets, kind of id) under `path`.

    Texts without words, and null ones, count as texts and have no postings. The positions of a word are put together in the text's own row, so
    only whole postings are shuffled, and buckets with a very common word are written by several tasks.
    """
    rows = df.select(F.col(id_).alias("id"), words(F.col(text)).alias("words"))
    counted = rows.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    buckets = buckets or max(1, -(-counted.words // BUCKET_WORDS))
    kind = df.schema[id_].dataType.simpleString()
    totals = df.sparkSession.createDataFrame([(counted.texts, counted.words, buckets, kind)], "texts long, words long, buckets int, kind string")
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    placed = _postings(rows).withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = df.sparkSession.read.schema(_POSTINGS.format(kind)).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    terms.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def _totals(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/totals").first()  # one row


def _asked(queries: DataFrame, query: str, text: str, buckets: int) -> DataFrame:
    """(query, pos, term, bucket) of all words of the queries."""
    return queries.select(F.col(query).alias("query"), F.posexplode(words(F.col(text))).alias("pos", "term")).withColumn("bucket", _bucket("term", buckets))


def _opened(spark: SparkSession, folder: str, schema: str, asked: DataFrame) -> DataFrame:
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # no more than there are buckets
    return spark.read.schema(schema).parquet(folder).filter(F.col("bucket").isin(wanted))


def _of_texts(spark: SparkSession, path: str, asked: DataFrame, columns: list[Column | str], extra: DataFrame | None = None) -> DataFrame:
    """`asked` (or `extra`, joined by term) with the postings of its words, `columns` of them, each text's in one partition.

    Postings are shuffled once by their text, whatever the number of queries, which meet them there; so what a query makes of a text is added
    up without another shuffle. More than SENT_WORDS words of queries are joined as Spark sees fit.
    """
    totals = _totals(spark, path)
    sizes = asked.agg(F.count(F.lit(1)).alias("words"), F.count_distinct("query").alias("queries")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-totals.texts * sizes.queries // TASK_PAIRS), -(-totals.words // BUCKET_WORDS))
    send = F.broadcast if sizes.words <= SENT_WORDS else lambda df: df
    postings = _opened(spark, f"{path}/postings", _POSTINGS.format(totals.kind), asked).join(send(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    return postings.select("term", *columns).repartition(tasks, "id").join(send((asked if extra is None else extra).drop("bucket")), "term")


def ranked(spark: SparkSession, path: str, queries: DataFrame, k: int, query: str = "query", text: str = "text", every: bool = False, digits: int = 6, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score, rank): for each query the k texts of the highest BM25, rounded to `digits`; ties to the smaller id.

    A word counts once, however often the query has it. With `every`, only texts with all words of the query are found. A query without
    words finds nothing. Lengths of texts come with the postings, so that no table of all texts is joined.
    """
    totals = _totals(spark, path)
    asked = _asked(queries, query, text, totals.buckets).select("query", "term", "bucket").distinct()
    asked = asked.join(asked.groupBy("query").agg(F.count(F.lit(1)).alias("terms")), "query")
    weighed = asked.join(_opened(spark, f"{path}/terms", _TERMS, asked), ["bucket", "term"])
    idf = F.log1p((totals.texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("query", "term", "terms", idf.alias("idf"))
    hits = _of_texts(spark, path, asked, ["id", "length", F.size("positions").alias("tf")], weighed)
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") * totals.texts / max(totals.words, 1)))
    scored = hits.groupBy("query", "id").agg(F.round(F.sum(part), digits).alias("score"), F.count(F.lit(1)).alias("n"), F.max("terms").alias("terms"))
    if every:
        scored = scored.filter("n = terms")
    return top_per(scored.select("query", "id", "score"), "query", [F.desc("score"), F.col("id")], k)


def phrases(spark: SparkSession, path: str, queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, id, first): the texts that have a query's words one after the other, and the first place (word number from 0) where they begin."""
    totals = _totals(spark, path)
    asked = _asked(queries, query, text, totals.buckets)
    asked = asked.join(asked.groupBy("query").agg(F.count(F.lit(1)).alias("terms")), "query")
    hits = _of_texts(spark, path, asked, ["id", "positions"])
    # places at which the phrase would begin; the arrays of one text are as many as the phrase has words
    begins = hits.select("query", "id", "terms", F.transform("positions", lambda p: p - F.col("pos")).alias("begins"))
    together = begins.groupBy("query", "id").agg(F.collect_list("begins").alias("all"), F.max("terms").alias("terms")).filter(F.size("all") == F.col("terms"))
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), F.array_intersect)
    return together.select("query", "id", F.array_min(common).alias("first")).filter("first IS NOT NULL")
