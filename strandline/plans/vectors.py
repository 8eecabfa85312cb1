"""Queries on embeddings: search, analogies, clusters, quantisation, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import beam, catalogue, codebooks, recommend, sequences, similarity, skipgram, statistics, vector_index
from strandline.plans.registry import query
from strandline.sources import files
from strandline.sources.tables import BEHAVIOURS_SQL as EV
from strandline.sources.tables import behaviours, table

COS = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))"
E_SQL = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "


def _vector(spark: SparkSession, d: str, n: int) -> list[float]:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == n).select("embedding").first()[0]


@query(E_SQL + f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM v a, v b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY similarity DESC, b.vec_id LIMIT 10")
def vs01_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, exclude=[0])


@query(E_SQL + f"SELECT b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (ORDER BY round({COS}, 6) DESC, b.vec_id) AS INTEGER) AS rank FROM v a, v b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND b.label = 3 QUALIFY rank <= 10")
def vs01_topk_of_type(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.top_k(table(spark, d, "embeddings").filter("label = 3"), _vector(spark, d, 0), 10, exclude=[0])
    return statistics.top_per(found.withColumn("one", F.lit(1)), "one", [F.desc("similarity"), F.col("vec_id")], 10).drop("one")


@query(E_SQL + f"""SELECT a.vec_id AS query, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS INTEGER) AS rank
FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY rank <= 5""")
def vs02_allpairs_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return similarity.all_pairs_top_k(e, e, 5)


@query()
def vs03_lsh_search(spark: SparkSession, d: str) -> DataFrame:
    return similarity.lsh_candidates(table(spark, d, "embeddings"), _vector(spark, d, 0), 11).filter("vec_id <> 0").orderBy(F.desc("similarity"), "vec_id").limit(10)


@query("""WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i),
v AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY label) SELECT a.label AS a, b.label AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS similarity FROM v a, v b""")
def vs04_similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the clusters' mean vectors, over all rows: as many vectors as labels."""
    means = similarity.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    a, b = means.select(F.col("label").alias("a"), F.col("embedding").alias("x")), means.select(F.col("label").alias("b"), F.col("embedding").alias("y"))
    return a.join(F.broadcast(b)).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(E_SQL + f"""SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS similarity FROM v a, v b WHERE a.vec_id IN (0, 1, 2, 3, 5, 8, 13, 21) AND b.vec_id IN (0, 1, 2, 3, 5, 8, 13, 21)""")
def vs04_chosen_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of chosen vectors."""
    found = similarity.similarity_matrix(table(spark, d, "embeddings"), [0, 1, 2, 3, 5, 8, 13, 21])
    return found.withColumn("similarity", F.round("similarity", 6))


@query(E_SQL + """, g AS (SELECT list_transform(list_zip(x.e, y.e, z.e), lambda t: t[2] - t[1] + t[3]) AS e FROM v x, v y, v z WHERE x.vec_id = 1 AND y.vec_id = 2 AND z.vec_id = 3)
SELECT b.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS similarity FROM g a, v b WHERE b.vec_id NOT IN (1, 2, 3) ORDER BY similarity DESC, b.vec_id LIMIT 5""")
def vs05_analogy(spark: SparkSession, d: str) -> DataFrame:
    return similarity.analogy(table(spark, d, "embeddings"), 1, 2, 3, 5)


@query(E_SQL + f"SELECT b.vec_id, round({COS}, 6) AS similarity, p_name AS title FROM v a, v b JOIN part ON p_partkey = b.vec_id WHERE a.vec_id = 5 AND b.vec_id <> 5 AND a.label = b.label AND p_size > 10 ORDER BY similarity DESC, b.vec_id LIMIT 20")
def vs06_similar_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    kind = e.filter("vec_id = 5").first()["label"]
    active = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("title"))
    rows = e.filter(F.col("label") == kind).join(active, "vec_id", "left_semi")
    return similarity.top_k(rows, _vector(spark, d, 5), 20, exclude=[5]).join(active, "vec_id").select("vec_id", "similarity", "title")


@query(E_SQL + f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM v a, v b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND b.vec_id NOT IN (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events WHERE user_id = 8 AND event_type IN ('click', 'purchase')) AND round({COS}, 6) >= 0.1 ORDER BY similarity DESC, b.vec_id LIMIT 50")
def vs07_items_for_user(spark: SparkSession, d: str) -> DataFrame:
    candidates = table(spark, d, "embeddings").select(F.lit(8).cast("long").alias("user_id"), F.col("vec_id").alias("item_id"), "embedding")
    fresh = recommend.not_interacted(candidates, behaviours(spark, d), ("click", "buy", "purchase"))
    return similarity.top_k(fresh.withColumnRenamed("item_id", "vec_id"), _vector(spark, d, 7), 50, exclude=[7]).filter("similarity >= 0.1")


@query(E_SQL + f"SELECT b.vec_id AS user_id, round({COS}, 6) AS similarity FROM v a, v b WHERE a.vec_id = 11 AND b.vec_id <> 11 ORDER BY similarity DESC, b.vec_id LIMIT 50")
def vs08_similar_users(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(table(spark, d, "embeddings"), _vector(spark, d, 11), 50, exclude=[11]).withColumnRenamed("vec_id", "user_id")


@query(E_SQL + "SELECT b.vec_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id = 9 AND b.vec_id NOT IN (9, 10, 11) ORDER BY score DESC, b.vec_id LIMIT 10")
def vs09_inner_product(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 9)))
    rows = table(spark, d, "embeddings").filter(~F.col("vec_id").isin(9, 10, 11))
    return rows.select("vec_id", F.round(vectors.dot(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


KIND_SQL = "CASE WHEN expected < 100000 THEN 'FLAT' WHEN expected < 10000000 THEN CASE WHEN latency < 10 THEN 'IVF_SQ8' ELSE 'IVF_FLAT' END WHEN expected < 100000000 THEN CASE WHEN recall > 0.98 THEN 'HNSW_HIGH_RECALL' ELSE 'HNSW' END ELSE 'DISKANN' END"


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT * FROM (VALUES (1), (1000), (100000), (1000000)) t(growth), (VALUES (5.0, 0.95), (50.0, 0.95), (50.0, 0.99)) u(latency, recall)),
x AS (SELECT growth, latency, recall, n * growth AS expected FROM n, w) SELECT CAST(expected AS BIGINT) AS expected, CAST(latency AS DOUBLE) AS latency, CAST(recall AS DOUBLE) AS recall, {KIND_SQL} AS kind FROM x""")
def vs10_index_kind(spark: SparkSession, d: str) -> DataFrame:
    """The kind of index for the table as it is and as it may grow."""
    rows = table(spark, d, "embeddings").count()
    asked = [(rows * g, *w) for g in (1, 1000, 100_000, 1_000_000) for w in ((5.0, 0.95), (50.0, 0.95), (50.0, 0.99))]
    return spark.createDataFrame([(*a, vector_index.recommended(*a)) for a in asked], "expected long, latency double, recall double, kind string")


@query()
def vs10_ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """Every row is in the index; rows whose id is divisible by 20 are searched, in as many cells as a sample of others needs."""
    e, path = table(spark, d, "embeddings"), files.scratch(spark)
    vector_index.build(e, path)
    nprobe = vector_index.probes_for(spark, path, e.filter("vec_id % 20 = 7"))
    return vector_index.search(spark, path, e.filter("vec_id % 20 = 0"), 10, nprobe, refine=8)


@query(E_SQL + f"""SELECT a.vec_id AS query, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS INTEGER) AS rank
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""")
def vs10_ivf_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """A search of all cells is exact."""
    e, path = table(spark, d, "embeddings"), files.scratch(spark)
    vector_index.build(e, path, rounds=2)
    return vector_index.search(spark, path, e.filter("vec_id % 20 = 0"), 10)


@query()
def vs11_kmeans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(vectors.as_doubles(F.col("embedding"))).alias("features"))
    return KMeans(k=8, seed=42, maxIter=10).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def vs12_pca(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(vectors.as_doubles(F.col("embedding"))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="features").fit(rows).transform(rows)
    found = PCA(k=2, inputCol="features", outputCol="pc").fit(centred).transform(centred)
    pc = vector_to_array("pc")
    return found.select("vec_id", *(F.round(F.get(pc, F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(2)))


@query()
def vs14_word2vec(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram vectors of the items of users' sequences, trained here."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    walks = sequences.user_sequences(behaviours(spark, d), 1 << 30).select(F.transform("events.item_id", lambda i: i.cast("string")).alias("tokens"))
    model = Word2Vec(vectorSize=16, windowSize=5, minCount=1, maxIter=1, seed=42, inputCol="tokens", outputCol="v").fit(walks)
    return model.getVectors().select(F.col("word").alias("token"), F.size(vector_to_array("vector")).alias("dims"))


@query()
def vs14_skipgram_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of items from pairs within two events of a user, trained with drawn negatives in four blocks of either matrix."""
    walks = sequences.user_sequences(behaviours(spark, d), 1 << 30).select("user_id", F.col("events.item_id").alias("ids"))
    pairs = skipgram.counted_pairs(catalogue.skip_grams(walks, "user_id", "ids", 2, dynamic=False), "target", "context")
    found, _ = skipgram.train(pairs, dims=16, rounds=2, blocks=4)
    return found.select(F.col("word").alias("token"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
d AS (SELECT user_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM e JOIN embeddings ON vec_id = item WHERE n <= 10),
m AS (SELECT user_id, i, avg(x) AS x FROM d GROUP BY user_id, i) SELECT user_id, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 9) AS first FROM m QUALIFY i = 1""")
def vs15_user_vectors(spark: SparkSession, d: str) -> DataFrame:
    newest = statistics.top_per(behaviours(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", F.col("item_id").alias("vec_id"))
    e = table(spark, d, "embeddings")
    means = similarity.mean_vectors(newest.join(e, "vec_id"), "user_id", "embedding", e.agg(F.max(F.size("embedding"))).first()[0])
    return means.select("user_id", F.round(F.get(vectors.normalised(F.col("embedding")), F.lit(0)), 9).alias("first"))


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
d AS (SELECT user_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM e JOIN embeddings ON vec_id = item WHERE n <= 10)
SELECT user_id, round(sum(x) / count(*), 9) AS mean FROM d GROUP BY user_id""")
def jo16_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    newest = statistics.top_per(behaviours(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", F.col("item_id").alias("vec_id"))
    e = table(spark, d, "embeddings")
    means = similarity.mean_vectors(newest.join(e, "vec_id"), "user_id", "embedding", e.agg(F.max(F.size("embedding"))).first()[0])
    return means.select("user_id", F.round(vectors.total(F.col("embedding")) / F.size("embedding"), 9).alias("mean"))


@query(E_SQL + "SELECT vec_id, CASE WHEN abs(sqrt(list_dot_product(e, e)) * (1 + vec_id % 2) - 1) > 0.5 THEN 0.9 ELSE 0.1 END::DOUBLE AS score FROM v")
def vs16_perturbed_embedding(spark: SparkSession, d: str) -> DataFrame:
    length = vectors.norm(F.col("embedding")) * (1 + F.col("vec_id") % 2)
    return table(spark, d, "embeddings").select("vec_id", F.when(F.abs(length - 1) > 0.5, 0.9).otherwise(0.1).alias("score"))


@query(E_SQL + "SELECT vec_id, round(1 - list_dot_product(e, (SELECT e FROM v WHERE vec_id = 4)) / sqrt(list_dot_product(e, e)) / sqrt((SELECT list_dot_product(e, e) FROM v WHERE vec_id = 4)), 6) AS distance FROM v ORDER BY distance, vec_id LIMIT 25")
def sl05_knn_distance(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 4)))
    rows = table(spark, d, "embeddings").select("vec_id", F.round(1 - vectors.cosine(F.col("embedding"), q), 6).alias("distance"))
    return rows.orderBy("distance", "vec_id").limit(25)


@query(E_SQL + f"SELECT b.vec_id, round(1 - {COS}, 6) AS distance FROM v a, v b WHERE a.vec_id = 4 AND round(1 - {COS}, 6) < 0.7 ORDER BY distance, b.vec_id LIMIT 100")
def sl06_vector_range(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 4)))
    rows = table(spark, d, "embeddings").select("vec_id", F.round(1 - vectors.cosine(F.col("embedding"), q), 6).alias("distance"))
    return rows.filter("distance < 0.7").orderBy("distance", "vec_id").limit(100)


@query(E_SQL + f"SELECT b.vec_id, round({COS}, 6) AS cosine, round(list_dot_product(a.e, b.e), 6) AS dot FROM v a, v b WHERE a.vec_id = 2")
def jo14_query_times_matrix(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 2)))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine"), F.round(vectors.dot(F.col("embedding"), q), 6).alias("dot"))


@query(E_SQL + "SELECT vec_id, 0.0::DOUBLE AS zero, 0.0::DOUBLE AS unequal, -1.0::DOUBLE AS opposite FROM v")
def fn27_cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    nil, short = F.transform(e, lambda x: F.lit(0.0)), F.slice(e, 1, 3)
    return table(spark, d, "embeddings").select(
        "vec_id", vectors.cosine(e, nil).alias("zero"), vectors.cosine(e, short).alias("unequal"), F.round(vectors.cosine(e, F.transform(e, lambda x: -x)), 9).alias("opposite")
    )


@query(E_SQL + "SELECT vec_id, round(list_dot_product(e, e), 9) AS self_dot FROM v")
def fn28_dot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 9).alias("self_dot"))


@query(E_SQL + "SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 9) AS first, 1.0::DOUBLE AS length FROM v")
def fn29_normalise(spark: SparkSession, d: str) -> DataFrame:
    n = vectors.normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(n, F.lit(0)), 9).alias("first"), F.round(vectors.norm(n), 9).alias("length"))


@query(E_SQL + "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 6) AS distance FROM v a, v b WHERE b.vec_id = 3")
def fn31_squared_distance(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 3)))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.squared_distance(F.col("embedding"), q), 6).alias("distance"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo) * 2 - 1, 9) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def fn32_min_max(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.min_max_scaled(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return found.select("p_partkey", F.round("p_retailprice_scaled", 9).alias("scaled"))


@query("SELECT p_partkey, round((p_size - m) / s, 9) AS scaled FROM part, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part)")
def fn33_standardise(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.standardised(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")
    return found.select("p_partkey", F.round("p_size_scaled", 9).alias("scaled"))


@query("""WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i)
SELECT label, round(sum(x * i), 6) AS mark FROM m GROUP BY label""")
def ar13_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    means = similarity.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    marked = vectors.total(F.transform("embedding", lambda x, i: x * (i + 1)))
    return means.select("label", F.round(marked, 6).alias("mark"))


@query(E_SQL + "SELECT a.vec_id, round(a.e[1] + b.e[1], 9) AS sum_first, round(a.e[1] - b.e[1], 9) AS diff_first FROM v a, v b WHERE b.vec_id = 0")
def ar14_vector_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _vector(spark, d, 0)))
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(vectors.plus(e, q), F.lit(0)), 9).alias("sum_first"), F.round(F.get(vectors.minus(e, q), F.lit(0)), 9).alias("diff_first"))


def _codebooks(spark: SparkSession, d: str) -> list[list[tuple[int, list[float]]]]:
    rows = table(spark, d, "embeddings").filter("vec_id < 24").select("vec_id", "embedding").collect()  # 24 rows
    found = {r["vec_id"]: r["embedding"] for r in rows}
    return [[(i, found[level * 8 + i]) for i in range(8)] for level in range(3)]


DIST = "round(list_sum(list_transform(list_zip(r.e, c.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9)"
MINUS = "list_transform(list_zip(r.e, c.e), lambda t: t[1] - t[2])"


def _level(n: int, of: str) -> str:
    return f"""SELECT r.vec_id, {''.join(f'r.l{k}, ' for k in range(1, n))}CAST(c.vec_id - {8 * (n - 1)} AS INTEGER) AS l{n}, {MINUS} AS e FROM {of} r JOIN v c ON c.vec_id BETWEEN {8 * (n - 1)} AND {8 * n - 1}
QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY {DIST}, c.vec_id) = 1"""


RVQ_SQL = E_SQL + f", q1 AS ({_level(1, 'v')}), q2 AS ({_level(2, 'q1')}), q3 AS ({_level(3, 'q2')}) "


@query(RVQ_SQL + "SELECT vec_id, l1, l2, l3 FROM q3")
def ar15_rvq(spark: SparkSession, d: str) -> DataFrame:
    return similarity.residual_codes(table(spark, d, "embeddings"), _codebooks(spark, d)).select("vec_id", "l1", "l2", "l3")


@query()
def ar15_fitted_codebooks(spark: SparkSession, d: str) -> DataFrame:
    """Error and use of three levels of eight codes fitted to all vectors."""
    e = table(spark, d, "embeddings")
    return codebooks.level_report(e, codebooks.fit_levels(e, 8, 3))


@query(RVQ_SQL + "SELECT q3.vec_id, round(v.e[1] - q3.e[1], 6) AS first FROM q3 JOIN v USING (vec_id)")
def ar16_rvq_decode(spark: SparkSession, d: str) -> DataFrame:
    books = _codebooks(spark, d)
    codes = similarity.residual_codes(table(spark, d, "embeddings"), books)
    return similarity.decoded(codes, books).select("vec_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query(RVQ_SQL + ", c AS (SELECT l2, count(*) AS n FROM q3 GROUP BY l2), p AS (SELECT n, n / sum(n) OVER () AS p FROM c) SELECT count(*) / 8 AS utilisation, round(exp(-sum(p * ln(p))), 6) AS perplexity, min(n) AS least, max(n) AS most, 8 - count(*) AS dead FROM p")
def ag40_codebook_usage(spark: SparkSession, d: str) -> DataFrame:
    codes = similarity.residual_codes(table(spark, d, "embeddings"), _codebooks(spark, d))
    return similarity.codebook_usage(codes, "l2", 8).withColumn("perplexity", F.round("perplexity", 6))


@query(RVQ_SQL + """, e AS (SELECT list_dot_product(q3.e, q3.e) AS se, list_sum(list_transform(q3.e, lambda x: abs(x))) AS ae, len(q3.e) AS n FROM q3)
SELECT round(sum(se) / sum(n), 6) AS mse, round(sqrt(sum(se) / sum(n)), 6) AS rmse, round(sum(ae) / sum(n), 6) AS mae FROM e""")
def ag41_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    books = _codebooks(spark, d)
    e = table(spark, d, "embeddings")
    both = similarity.decoded(similarity.residual_codes(e, books), books).join(e.select("vec_id", "embedding"), "vec_id")
    return similarity.reconstruction(both, "embedding", "vector").select(*(F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae")))


@query(E_SQL + """, g AS (SELECT vec_id % 4 AS expert, abs(e[1]) / (abs(e[1]) + abs(e[2])) AS p FROM v) SELECT expert, round(avg(p), 6) AS mean_probability, count(*) / (SELECT count(*) FROM v) AS fraction FROM g GROUP BY expert""")
def ag42_expert_balance(spark: SparkSession, d: str) -> DataFrame:
    e = [F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in range(2)]
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("expert"), (e[0] / (e[0] + e[1])).alias("p"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    per = rows.groupBy("expert").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(total)).select("expert", F.round("p", 6).alias("mean_probability"), (F.col("n") / F.col("t")).alias("fraction"))


@query(E_SQL + f", p AS (SELECT a.label, {COS} AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT s.label, s.size, coalesce(round(p.m, 6), 1.0) AS mean, coalesce(round(p.d, 6), 0.0) AS std FROM (SELECT label, count(*) AS size FROM v GROUP BY label) s LEFT JOIN (SELECT label, avg(c) AS m, stddev_pop(c) AS d FROM p GROUP BY label) p USING (label)")
def ag29_cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.cluster_cohesion(table(spark, d, "embeddings"))
    return found.select("label", "size", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""WITH x AS (SELECT label, vec_id % 3 AS kind FROM embeddings), c AS (SELECT label, kind, count(*) AS n FROM x GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS size, arg_max(kind, n * 10 - kind) AS dominant FROM c GROUP BY label""")
def ag30_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("label").agg(F.sum("n").alias("size"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("dominant"))


@query("""WITH c AS (SELECT label, vec_id % 5 AS child, count(*) AS n FROM embeddings GROUP BY ALL), p1 AS (SELECT label, round(ln(sum(n) / (SELECT count(*) FROM embeddings)), 9) AS s FROM c GROUP BY label ORDER BY s DESC, label LIMIT 4)
SELECT label, child, round(s + ln(n / (SELECT sum(n) FROM c x WHERE x.label = c.label)), 6) AS score FROM c JOIN p1 USING (label) ORDER BY score DESC, label, child LIMIT 6""")
def sl19_beam(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of a beam over code tables: the best prefixes, then their best extensions by summed log probability."""
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 5).alias("child"))
    total = e.agg(F.count(F.lit(1)).alias("t"))
    first = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).withColumn("s", F.round(F.ln(F.col("n") / F.col("t")), 9)).orderBy(F.desc("s"), "label").limit(4)
    second = e.groupBy("label", "child").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(first), "label")
    return second.select("label", "child", F.round(F.col("s") + F.ln(F.col("m") / F.col("n")), 6).alias("score")).orderBy(F.desc("score"), "label", "child").limit(6)


CODES = "item_id % 4 AS c1, (item_id // 4) % 5 AS c2, item_id // 20 AS c3"


@query(EV + f""", e AS (SELECT user_id, {CODES} FROM ev), n1 AS (SELECT user_id, c1, count(*) AS n FROM e GROUP BY ALL), n2 AS (SELECT c1, c2, count(*) AS n FROM e GROUP BY ALL), n3 AS (SELECT c1, c2, c3, count(*) AS n FROM e GROUP BY ALL),
p1 AS (SELECT user_id, c1, round(ln(n / sum(n) OVER (PARTITION BY user_id)), 9) AS s FROM n1), p2 AS (SELECT c1, c2, ln(n / sum(n) OVER (PARTITION BY c1)) AS p FROM n2), p3 AS (SELECT c1, c2, c3, ln(n / sum(n) OVER (PARTITION BY c1, c2)) AS p FROM n3),
b1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, c1) <= 3), s2 AS (SELECT user_id, c1, c2, round(s + p, 9) AS s FROM b1 JOIN p2 USING (c1)),
b2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, c1, c2) <= 3), s3 AS (SELECT user_id, c1, c2, c3, round(s + p, 9) AS s FROM b2 JOIN p3 USING (c1, c2)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, c1, c2, c3) AS rank FROM s3)
SELECT user_id, concat_ws(',', c1, c2, c3) AS codes, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def sl19_user_beam(spark: SparkSession, d: str) -> DataFrame:
    """Three levels for each user: their own first codes, then what follows a prefix over all events."""
    k = F.col("item_id")
    ev = behaviours(spark, d).select("user_id", (k % 4).alias("c1"), (F.floor(k / 4) % 5).cast("int").alias("c2"), F.floor(k / 20).cast("int").alias("c3"))
    first = beam.log_shares(ev.groupBy("user_id", F.col("c1").alias("code")).agg(F.count(F.lit(1)).alias("n")), ["user_id"], "code")
    levels = []
    for before, own in ((["c1"], "c2"), (["c1", "c2"], "c3")):
        counted = ev.groupBy(*before, F.col(own).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(beam.log_shares(counted, before, "code").select(F.array(*before).alias("prefix"), "code", "logp"))
    found = beam.search(first, levels, 3, 5)
    return found.select("user_id", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"), F.round("score", 6).alias("score"), "rank")
