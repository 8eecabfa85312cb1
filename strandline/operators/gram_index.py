"""Trigram index: texts of at least a given similarity without comparing all.

Texts are sets of trigrams, and similarity is shared over all different ones. The rarest trigrams of a text come first; two texts
of similarity t or more share l of them among the first n - ceil(t n) + l of each, if they share so many at all, and their sizes are near each
other. Texts are looked up by pairs (l = 2), which are far rarer than single ones; texts that need to share but one, and pairs of texts of
which one is long, by single ones (l = 1). Where two texts meet, bits that each of their trigrams flips tell at least how many they don't share,
so most are given up there, before they are shuffled. What passes is compared exactly, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import fuzzy
from strandline.functions.texts import trigrams
from strandline.operators.statistics import top_per

#: Trigrams of all texts that make up a bucket.
BUCKET_GRAMS = 1 << 22
#: Trigrams of a text up to which pairs of them are made; the pairs grow with their square.
LONG = 40
#: Rows of one text that are put together with the queries like it in one go.
BLOCK = 1 << 12
#: Below what rounding can make of equal numbers.
_EPS = 1e-9
#: Columns of 64 bits each, of which a trigram flips one bit of one.
_FLIPS = ["flips0", "flips1", "flips2"]


def _bucket(gram: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _flips(grams: Column | str) -> list[Column]:
    """The bits that a text's trigrams flip: those of two texts differ in no more bits than trigrams are in one text alone."""
    none = F.lit(0).cast("long")

    def one(gram: Column, k: int) -> Column:
        at = F.pmod(F.xxhash64(gram), F.lit(64 * len(_FLIPS)))
        return F.when(F.floor(at / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(none)

    def all_of(k: int) -> Column:
        return F.aggregate(grams, none, lambda bits, gram: bits.bitwiseXOR(one(gram, k)))

    return [all_of(k).alias(name) for k, name in enumerate(_FLIPS)]


def build(df: DataFrame, path: str, id_: str, text: str, buckets: int | None = None) -> None:
    """Writes postings/bucket=… (gram, item, size, pos), items (item, text, grams, size, flips), members (item, id) and counts (gram, n, buckets).

    Equal texts are one item, named by the least id, so many copies cost no more than one; members lists them all. Null texts are left out.
    """
    rows = df.select(F.col(id_).alias("id"), F.lower(F.col(text)).alias("text")).filter("text IS NOT NULL")
    first = rows.groupBy("text").agg(F.min("id").alias("item"))
    spark = df.sparkSession
    first.withColumn("grams", trigrams(F.col("text"))).select("text", "item", "grams", F.size("grams").alias("size"), *_flips("grams")).write.mode("overwrite").parquet(f"{path}/items")
    items = spark.read.parquet(f"{path}/items")
    rows.join(items.select("text", "item"), "text").select("item", "id").write.mode("overwrite").parquet(f"{path}/members")
    each = items.select("item", "size", F.explode("grams").alias("gram"))
    total = items.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    buckets = buckets or max(1, -(-total // BUCKET_GRAMS))
    each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/counts")
    placed = _in_order(each, spark.read.parquet(f"{path}/counts"), ["item", "size"]).withColumn("bucket", _bucket("gram", buckets))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def _postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings of the buckets asked for; the schema is told, since an index of no texts has no files."""
    kind = spark.read.parquet(f"{path}/items").schema["item"].dataType.simpleString()
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # no more than there are buckets
    return spark.read.schema(f"gram string, item {kind}, size int, pos int, bucket int").parquet(f"{path}/postings").filter(F.col("bucket").isin(wanted))


def _in_order(each: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, pos): the trigrams of each text, the rarest first; what the index doesn't have is rarer than all it has."""
    known = each.join(counts.select("gram", "n"), "gram", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    return known.select(*keys, F.posexplode("g.gram").alias("pos", "gram"))


def _held(size: Column, least: float) -> Column:
    """How many trigrams a text shares at least with one that is as similar as `least`."""
    return F.ceil(size * least - _EPS)


def _signatures(each: DataFrame, flips: DataFrame, key: str, least: float) -> DataFrame:
    """(key, size, flips, sign): pairs of the rarest trigrams of each text, and single ones where pairs may miss it or it is long."""
    size, held = F.col("size"), _held(F.col("size"), least)
    first = each.filter(F.col("pos") < size - held + 2).groupBy(key, "size").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("g"))
    g, none = F.col("g"), F.array().cast("array<string>")
    pairs = F.flatten(F.transform(g, lambda a, i: F.transform(F.slice(g, i + 2, F.size(g)), lambda b: F.concat(a["gram"], b["gram"]))))
    single = F.transform(F.filter(g, lambda a: a["pos"] < size - held + 1), lambda a: a["gram"])
    signs = F.concat(F.when(size <= LONG, pairs).otherwise(none), F.when((held < 2) | (size >= LONG * least - _EPS), single).otherwise(none))
    return first.join(flips, [key, "size"]).select(key, "size", *_FLIPS, F.explode(signs).alias("sign"))


def candidates(spark: SparkSession, path: str, queries: DataFrame, least: float, query: str = "query", text: str = "text") -> DataFrame:
    """(query, item): pairs that may be as similar as `least`, above 0."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be above 0 and at most 1")
    counts = spark.read.parquet(f"{path}/counts")
    buckets = counts.first()
    grams = queries.filter(F.col(text).isNotNull()).select(F.col(query).alias("query"), trigrams(F.col(text)).alias("grams")).withColumn("size", F.size("grams"))
    # no text is without trigrams; an inner explode would ask so of every row that the queries are taken from
    asked = _in_order(grams.select("query", "size", F.explode_outer("grams").alias("gram")), counts, ["query", "size"])
    wanted = asked.filter(F.col("pos") < F.col("size") - _held(F.col("size"), least) + 2).select("gram").distinct()
    wanted = wanted.withColumn("bucket", _bucket("gram", buckets.buckets if buckets else 1))
    postings = _postings(spark, path, wanted).join(wanted, ["bucket", "gram"], "left_semi")
    mine = _signatures(asked, grams.select("query", "size", *_flips("grams")), "query", least).withColumnsRenamed({"size": "own"} | {f: f"own_{f}" for f in _FLIPS})
    pairs = mine.join(_signatures(postings, spark.read.parquet(f"{path}/items").select("item", "size", *_FLIPS), "item", least), "sign")
    size, own = F.col("size"), F.col("own")
    near = (size >= own * least - _EPS) & (own >= size * least - _EPS)
    # two short texts that share two trigrams at least are found by pairs
    needed = (F.length("sign") > 3) | (F.greatest(size, own) > LONG) | (_held(F.greatest(size, own), least) < 2)
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"own_{f}"))) for f in _FLIPS), F.lit(0))
    alike = size + own - apart >= (size + own + apart) * (least - _EPS)
    return pairs.filter(near & needed & alike).select("query", "item").distinct()


def similar(spark: SparkSession, path: str, queries: DataFrame, least: float, query: str = "query", text: str = "text") -> DataFrame:
    """(query, id, similarity): all rows whose text is as similar as `least` or more; case doesn't count.

    Only the folders of the queries' rarest trigrams are read. Null texts find nothing. Queries must differ in `query`; equal texts are looked up once.
    """
    asked = queries.select(F.col(query).alias("query"), F.lower(F.col(text)).alias("text")).filter("query IS NOT NULL AND text IS NOT NULL")
    once = asked.groupBy("text").agg(F.min("query").alias("first"))
    pairs = candidates(spark, path, once, least, "first", "text").withColumnRenamed("query", "first")
    items = spark.read.parquet(f"{path}/items").select("item", "grams")
    own = once.select("first", trigrams(F.col("text")).alias("own"))
    both = pairs.join(own, "first").join(items, "item")
    shared = F.size(F.array_intersect("own", "grams"))
    scored = both.select("first", "item", (shared / (F.size("own") + F.size("grams") - shared)).alias("similarity"))
    found = scored.filter(F.col("similarity") >= least - _EPS).join(asked.join(once, "text").select("first", "query"), "first")
    return _each_member(found.select("query", "item", "similarity"), spark.read.parquet(f"{path}/members"))


def _each_member(found: DataFrame, members: DataFrame) -> DataFrame:
    """(query, id, similarity) for every row of the items found, in blocks of `BLOCK` or so rows of one item with all queries that found it.

    A frequent text with many queries like it gives the product of both, so tasks are counted by blocks: the pairs that come in say nothing of it.
    """
    sizes = members.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    tasks = max(1, -(-members.count() // BLOCK))
    asked = found.join(sizes, "item").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rows = members.join(sizes, "item").select("item", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    # each row with its queries in turn: written columns are long runs and short repeats that way, not a sequence of ids for each query
    return asked.repartition(tasks, "item", "block").hint("shuffle_hash").join(rows.repartition(tasks, "item", "block"), ["item", "block"]).select("query", "id", "similarity")


def sharing(spark: SparkSession, path: str, queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, item): pairs that have any trigram in common, for scores of other kinds."""
    counts = spark.read.parquet(f"{path}/counts").first()
    asked = queries.select(F.col(query).alias("query"), F.explode(trigrams(F.col(text))).alias("gram")).withColumn("bucket", _bucket("gram", counts.buckets if counts else 1))
    return asked.join(_postings(spark, path, asked), ["bucket", "gram"]).select("query", "item").distinct()


def fuzzy_matches(spark: SparkSession, path: str, queries: DataFrame, k: int, cutoff: float = 60.0, query: str = "query", text: str = "text", digits: int = 6) -> DataFrame:
    """(query, id, score, rank): the k rows of the highest weighted ratio, `cutoff` or more, in lower case; ties to the smaller id.

    Only texts with a trigram of the query are scored. One without any can still reach a cutoff by scattered characters; it isn't found.
    """
    items = spark.read.parquet(f"{path}/items").select("item", F.col("text").alias("found"))
    own = queries.select(F.col(query).alias("query"), F.lower(F.col(text)).alias("own"))
    pairs = sharing(spark, path, queries, query, text).join(own, "query").join(items, "item")
    scored = pairs.select("query", "item", F.round(fuzzy.weighted_ratio(F.col("own"), F.col("found")), digits).alias("score")).filter(F.col("score") >= cutoff)
    # an item's k least ids are all that can be among a query's first k
    members = top_per(spark.read.parquet(f"{path}/members"), "item", [F.col("id")], k).drop("rank")
    return top_per(scored.join(members, "item").select("query", "id", "score"), "query", [F.desc("score"), F.col("id")], k)
