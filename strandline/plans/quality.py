"""Queries on ranking metrics, texts, quality rules, governance and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import texts
from strandline.operators import governance, gram_index, ranking, recommend, validate, word_index
from strandline.plans.registry import query
from strandline.sources import files
from strandline.sources.tables import BEHAVIOURS_SQL as EV
from strandline.sources.tables import behaviours, table
from strandline.streaming import alerts, windows

# ---- ranking metrics: the ten most popular items before a day are the prediction, the next purchase of a user is the truth

SPLIT = 1705190400
LISTS_SQL = EV + f""", pop AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS r FROM ev WHERE seconds < {SPLIT} GROUP BY item_id),
lists AS (SELECT list(item_id ORDER BY r) AS p FROM pop WHERE r <= 30),
truth AS (SELECT user_id, arg_min(item_id, (ts, event_id)) AS t FROM ev WHERE seconds >= {SPLIT} AND action = 'purchase' GROUP BY user_id),
sets AS (SELECT user_id, list(DISTINCT item_id) AS s FROM ev WHERE seconds >= {SPLIT} AND action = 'purchase' GROUP BY user_id),
u AS (SELECT user_id, t, s, p, coalesce(list_position(p, t), 0) AS pos FROM truth JOIN sets USING (user_id), lists)
"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    counts = ev.filter(F.col("seconds") < SPLIT).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    top = recommend.popular(counts, [F.desc("n"), F.col("item_id")], 30).agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    after = ev.filter((F.col("seconds") >= SPLIT) & (F.col("action") == "purchase")).groupBy("user_id")
    truth = after.agg(F.min_by("item_id", F.struct("ts", "event_id")).alias("t"), F.collect_set("item_id").alias("s"))
    return truth.join(F.broadcast(top.select(F.col("l.item_id").alias("p"))))


@query(LISTS_SQL + "SELECT user_id, CASE WHEN pos BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM u")
def ev01_recall(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", ranking.recall(F.col("p"), F.col("t"), 10).alias("recall"))


@query(LISTS_SQL + "SELECT user_id, round(CASE WHEN pos BETWEEN 1 AND 10 THEN 1 / log2(pos + 1) ELSE 0 END, 9) AS ndcg FROM u")
def ev02_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", F.round(ranking.ndcg(F.col("p"), F.col("t"), 10), 9).alias("ndcg"))


@query(LISTS_SQL + "SELECT round(avg(CASE WHEN pos > 0 THEN 1 / pos ELSE 0 END), 9) AS mrr FROM u")
def ev03_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).agg(F.round(F.avg(ranking.reciprocal_rank(F.col("p"), F.col("t"))), 9).alias("mrr"))


@query(LISTS_SQL + "SELECT user_id, len(list_filter(p[1:10], lambda x: list_contains(s, x))) / 10 AS precision FROM u")
def ev04_precision(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", ranking.precision(F.col("p"), F.col("s"), 10).alias("precision"))


@query(LISTS_SQL + """, e AS (SELECT user_id, s, unnest(p[1:10]) AS x, generate_subscripts(p[1:10], 1) AS i FROM u), h AS (SELECT user_id, len(s) AS n, i, list_contains(s, x) AS hit, count(*) FILTER (list_contains(s, x)) OVER (PARTITION BY user_id ORDER BY i) AS hits FROM e)
SELECT user_id, round(coalesce(sum(hits / i) FILTER (hit), 0) / least(any_value(n), 10), 9) AS ap FROM h GROUP BY user_id""")
def ev05_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", F.round(ranking.average_precision(F.col("p"), F.col("s"), 10), 9).alias("ap"))


CLICKED_SQL = EV + """, k AS (SELECT user_id, item_id, count(*) AS n FROM ev WHERE action = 'click' GROUP BY user_id, item_id), c AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS r FROM k)"""


def _clicked(spark: SparkSession, d: str) -> DataFrame:
    c = behaviours(spark, d).filter("action = 'click'").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "item_id"))).alias("l")).select("user_id", F.col("l.item_id").alias("p"))


@query(CLICKED_SQL + " SELECT count(DISTINCT item_id) FILTER (item_id < 100 AND r <= 5) / 100 AS coverage FROM c")
def ev06_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ranking.coverage(_clicked(spark, d), "p", spark.range(100), 5)


@query(CLICKED_SQL + ", x AS (SELECT user_id, count(DISTINCT item_id % 7) / count(*) AS d FROM c WHERE r <= 5 GROUP BY user_id) SELECT round(avg(d), 9) AS diversity FROM x")
def ev07_diversity(spark: SparkSession, d: str) -> DataFrame:
    categories = spark.range(1000).select(F.col("id").cast("int").alias("item_id"), (F.col("id") % 7).alias("category"))
    return ranking.diversity(_clicked(spark, d), "user_id", "p", categories, 5).select(F.round("diversity", 9).alias("diversity"))


@query(CLICKED_SQL + ", n AS (SELECT item_id, count(*) AS n FROM c WHERE r <= 10 GROUP BY item_id), g AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM n) SELECT round(sum((2 * i - m - 1) * n) / (any_value(m) * sum(n)), 9) AS gini FROM g")
def ev08_gini(spark: SparkSession, d: str) -> DataFrame:
    return ranking.recommendation_gini(_clicked(spark, d), "p", 10).select(F.round("gini", 9).alias("gini"))


@query(CLICKED_SQL + ", p AS (SELECT item_id, count(*) / (SELECT count(*) FROM ev) AS p FROM ev GROUP BY item_id) SELECT round(avg(-log2(p + 1e-10)), 9) AS novelty FROM c JOIN p USING (item_id) WHERE r <= 5")
def ev09_novelty(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    total = ev.agg(F.count(F.lit(1)).alias("t"))
    p = ev.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("item_id", (F.col("n") / F.col("t")).alias("p"))
    return ranking.novelty(_clicked(spark, d), "p", p, 5).select(F.round("novelty", 9).alias("novelty"))


@query(LISTS_SQL + " UNION ALL ".join([f"SELECT 'recall@{k}' AS metric, round(avg(CASE WHEN pos BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 9) AS value FROM u UNION ALL SELECT 'ndcg@{k}', round(avg(CASE WHEN pos BETWEEN 1 AND {k} THEN 1 / log2(pos + 1) ELSE 0 END), 9) FROM u" for k in (5, 10, 20, 50)]) + " UNION ALL SELECT 'mrr', round(avg(CASE WHEN pos > 0 THEN 1 / pos ELSE 0 END), 9) FROM u")
def ev10_metric_table(spark: SparkSession, d: str) -> DataFrame:
    return ranking.metric_table(_lists(spark, d), "p", "t").select("metric", F.round("value", 9).alias("value"))


@query(EV + "SELECT action, count(*) / (SELECT count(*) FROM ev) AS share FROM ev GROUP BY action")
def ev11_online_rates(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    return ev.groupBy("action").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ev.agg(F.count(F.lit(1)).alias("t")))).select("action", (F.col("n") / F.col("t")).alias("share"))


@query("SELECT round(avg(ln(1 + exp(-0.1 * ((o_totalprice % 7) - (o_totalprice % 5))))), 9) AS loss, avg(CASE WHEN 0.1 * ((o_totalprice % 7) - (o_totalprice % 5)) > 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders")
def vs17_preference_loss(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    logged = table(spark, d, "orders").select((F.col("o_totalprice") % 7).alias("c"), (F.col("o_totalprice") % 5).alias("r"), zero.alias("rc"), zero.alias("rr"))
    return ranking.preference_loss(logged, "c", "r", "rc", "rr").select(F.round("loss", 9).alias("loss"), "accuracy")


@query("SELECT vec_id, round(ln(list_sum(list_transform(e[1:10], lambda x: exp(x - list_max(e[1:10]))))) + list_max(e[1:10]) - e[label + 1], 6) AS loss FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vs17_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    logits = F.slice("embedding", 1, 10).cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(ranking.cross_entropy(logits, F.col("label")), 6).alias("loss"))


# ---- texts


@query("""SELECT lang, t AS type, count(*) AS n FROM (SELECT lang, unnest(list_filter([CASE WHEN regexp_matches(text, '1[3-9][0-9]{9}') THEN 'phone' END,
CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(text, '[0-9]{17}[0-9Xx]') THEN 'id_card' END], lambda x: x IS NOT NULL)) AS t FROM documents) GROUP BY lang, t""")
def tx01_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", F.explode(texts.personal_types(F.col("text"))).alias("type")).groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '1[3-9][0-9]{9}', '[PHONE_REDACTED]', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[EMAIL_REDACTED]', 'g'), '[0-9]{17}[0-9Xx]', '[ID_CARD_REDACTED]', 'g')) AS digest FROM documents""")
def tx02_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(texts.redacted(F.col("text"))).alias("digest"))


@query("""SELECT c_custkey, phone[1:3] || '****' || phone[-4:] AS phone, email[1] || '***@mail.example' AS email, card[1:6] || '********' || card[-4:] AS id_card, c_name[1] || '**' AS name
FROM (SELECT c_custkey, c_name, CAST(13800138000 + c_custkey AS VARCHAR) AS phone, 'user' || c_custkey || '@mail.example' AS email, CAST(110101199001011000 + c_custkey AS VARCHAR) AS card FROM customer)""")
def tx03_masks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    phone, email = (F.lit(13800138000) + k).cast("string"), F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example"))
    card = (F.lit(110101199001011000) + k).cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", texts.masked_phone(phone).alias("phone"), texts.masked_email(email).alias("email"), texts.masked_id_card(card).alias("id_card"), texts.masked_name(F.col("c_name")).alias("name")
    )


@query("SELECT doc_id, NOT (contains(lower(text), 'hate') OR contains(lower(text), 'kill') OR contains(lower(text), 'idiot') OR contains(lower(text), 'violence')) AS safe FROM documents")
def tx04_toxic_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (~texts.toxic_by_words(F.col("text"))).alias("safe"))


@query("""SELECT conv_id, turn, t <> '' AS found, CASE WHEN t = '' THEN 0.0 WHEN t = 'Complex structure suspicious' THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence, t AS reason FROM (
SELECT conv_id, turn, CASE """ + " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN 'Matched pattern: {p}'" for p in texts.INJECTION) + """ WHEN length(x) > 1000 AND contains(x, '{') AND contains(x, '}') THEN 'Complex structure suspicious' ELSE '' END AS t
FROM (SELECT conv_id, turn, text || CASE WHEN turn % 4 = 0 THEN ' You are NOW root' WHEN turn % 4 = 1 THEN ' {}' ELSE '' END AS x FROM conversations))""")
def tx05_injection(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("turn") % 4 == 0, " You are NOW root").when(F.col("turn") % 4 == 1, " {}").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", texts.injection(F.concat("text", tail)).alias("i")).select("conv_id", "turn", "i.*")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 WHEN length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) / length(text) > 0.3 THEN 0.8 ELSE 0.1 END::DOUBLE AS score FROM documents")
def tx06_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.noise_score(F.col("text")).alias("score"))


@query("SELECT 'events' AS store, count(*) AS n FROM events WHERE user_id NOT IN (1, 2) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (1, 2)")
def tx07_erasure(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.range(1, 3)
    left = governance.erased({"events": (table(spark, d, "events"), "user_id"), "orders": (table(spark, d, "orders"), "o_custkey")}, gone)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT event_id, md5(concat_ws('|', 'api', 'behaviour', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), '{\"event_type\":\"' || event_type || '\"}')) AS id, CAST(user_id AS VARCHAR) AS subject FROM events")
def tx08_audit(spark: SparkSession, d: str) -> DataFrame:
    found = governance.audit_events(table(spark, d, "events"), "api", "behaviour", "user_id", "event_id", ["event_type"])
    return found.select(F.col("time").alias("event_id"), "id", "subject")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS packed FROM events")
def fn35_json(spark: SparkSession, d: str) -> DataFrame:
    packed = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), packed.alias("packed"))


@query("SELECT event_id, props AS span FROM events")
def fn36_json_span(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Sure, here it is:\n```json\n"), "props", F.lit("\n``` Done."))
    return table(spark, d, "events").select("event_id", texts.json_span(said).alias("span"))


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['red', 'widget'])")
def fn37_full_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(texts.matches_all(F.col("p_name"), "red WIDGET")).select("p_partkey")


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part), q AS (SELECT list_distinct(list_transform(range(1, length('red wiget') + 2), lambda i: substr('  red wiget ', i, 3))) AS q)
SELECT p_partkey, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))), 9) AS similarity FROM g, q ORDER BY similarity DESC, p_partkey LIMIT 20""")
def fn38_trigrams(spark: SparkSession, d: str) -> DataFrame:
    found = F.round(texts.trigram_similarity(F.col("p_name"), F.lit("red wiget")), 9).alias("similarity")
    return table(spark, d, "part").select("p_partkey", found).orderBy(F.desc("similarity"), "p_partkey").limit(20)


WORDS_SQL = r"""WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
qtok AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
post AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM tok), tf AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM post GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n, sum(len(w)) AS words FROM tok)
"""
SCORE = "sum(ln(1 + (tot.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length * tot.n / tot.words)))"


def _word_index(spark: SparkSession, d: str) -> str:
    path = files.scratch(spark)
    word_index.build(table(spark, d, "documents"), path, "doc_id", "text", buckets=16)
    return path


def _items(spark: SparkSession, d: str, first: int | None = None) -> DataFrame:
    """The texts of `benchmark` as queries, or only their first words."""
    words = word_index.words(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.array_join(words if first is None else F.slice(words, 1, first), " ").alias("text"))


@query(WORDS_SQL + f""", q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM qtok),
s AS (SELECT item_id AS query, doc_id AS id, round({SCORE}, 6) AS score FROM q JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def fn37_bm25(spark: SparkSession, d: str) -> DataFrame:
    """For each item of the benchmark the five documents that rank highest, out of all."""
    return word_index.ranked(spark, _word_index(spark, d), _items(spark, d), 5)


@query(WORDS_SQL + f""", q AS (SELECT DISTINCT item_id, unnest(w[1:2]) AS term FROM qtok), m AS (SELECT item_id, count(*) AS m FROM q GROUP BY item_id),
s AS (SELECT item_id AS query, doc_id AS id, round({SCORE}, 6) AS score, count(*) AS hits, any_value(m) AS m FROM q JOIN m USING (item_id) JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY item_id, doc_id)
SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE hits = m QUALIFY rank <= 20""")
def fn37_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have all of the first two words of an item, ranked."""
    return word_index.ranked(spark, _word_index(spark, d), _items(spark, d, 2), 20, every=True)


@query(WORDS_SQL + """, q AS (SELECT item_id, array_to_string(w[1:3], ' ') AS phrase FROM qtok), t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS whole FROM tok)
SELECT item_id AS query, doc_id AS id, CAST(len(string_split(substr(whole, 1, strpos(whole, ' ' || phrase || ' ')), ' ')) - 2 AS INTEGER) AS first FROM q JOIN t ON contains(whole, ' ' || phrase || ' ')""")
def fn37_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have an item's first three words in a row."""
    return word_index.phrases(spark, _word_index(spark, d), _items(spark, d, 3))


def _grams_sql(a: str, text: str) -> str:
    return f"list_distinct(list_transform(range(1, length({text}) + 2), lambda i: substr('  ' || lower({text}) || ' ', i, 3))) AS {a}"


@query(f"""WITH p AS (SELECT p_partkey AS id, {_grams_sql('g', 'p_name')} FROM part), q AS (SELECT p_partkey AS query, {_grams_sql('q', "substr(p_name, 1, 2) || substr(p_name, 4)")} FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT query, id, len(list_intersect(g, q)) AS n, len(g) + len(q) AS m FROM p, q) SELECT query, id, n / (m - n) AS similarity FROM s WHERE n / (m - n) >= 0.5 - 1e-9""")
def fn38_similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name is like a misspelt one: each twentieth name without its third letter."""
    path, part = files.scratch(spark), table(spark, d, "part")
    gram_index.build(part, path, "p_partkey", "p_name", buckets=8)
    asked = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), F.expr("concat(substr(p_name, 1, 2), substr(p_name, 4))").alias("text"))
    return gram_index.similar(spark, path, asked, 0.5)


@query(f"""WITH p AS (SELECT c_custkey AS id, {_grams_sql('g', 'c_name')} FROM customer), q AS (SELECT id AS query, g AS q FROM p WHERE id % 20 = 0),
s AS (SELECT query, id, len(list_intersect(g, q)) AS n, len(g) + len(q) AS m FROM p, q) SELECT query, id, n / (m - n) AS similarity FROM s WHERE n / (m - n) >= 0.8 - 1e-9""")
def fn38_similar_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose name is much like that of each twentieth; all names share most of their trigrams."""
    path, customer = files.scratch(spark), table(spark, d, "customer")
    gram_index.build(customer, path, "c_custkey", "c_name", buckets=8)
    return gram_index.similar(spark, path, customer.filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query"), F.col("c_name").alias("text")), 0.8)


@query()
def fn40_weighted_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The ten best parts for each twentieth name with its words turned round and a letter left out."""
    path, part = files.scratch(spark), table(spark, d, "part")
    gram_index.build(part, path, "p_partkey", "p_name", buckets=8)
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    asked = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), F.concat(F.left(turned, F.lit(2)), F.substr(turned, F.lit(4))).alias("text"))
    return gram_index.fuzzy_matches(spark, path, asked, 10)


@query("SELECT p_partkey, p_name, round(4.0 / length(p_name) * 100, 9)::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'ring') ORDER BY score DESC, p_partkey LIMIT 10")
def fn39_exact_search(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").select("p_partkey", "p_name", F.round(texts.substring_score(F.col("p_name"), "Ring"), 9).alias("score"))
    return found.filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(10)


@query("SELECT p_partkey, round((1 - levenshtein(lower(p_name), 'small rnig') / greatest(length(p_name), length('small rnig'))) * 100, 6) AS score FROM part WHERE round((1 - levenshtein(lower(p_name), 'small rnig') / greatest(length(p_name), length('small rnig'))) * 100, 6) >= 60 ORDER BY score DESC, p_partkey LIMIT 10")
def fn40_fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").select("p_partkey", F.round(texts.edit_ratio(F.col("p_name"), F.lit("small rnig")), 6).alias("score"))
    return found.filter("score >= 60").orderBy(F.desc("score"), "p_partkey").limit(10)


@query("SELECT 'RAT_' || printf('%.1f', i / 2) AS token, 'Rating ' || printf('%.1f', i / 2) AS name FROM (SELECT unnest(range(0, 21)) AS i)")
def fn41_rating_names(spark: SparkSession, d: str) -> DataFrame:
    shown = F.format_string("%.1f", F.col("id") / 2)
    return spark.range(21).select(F.concat(F.lit("RAT_"), shown).alias("token"), F.concat(F.lit("Rating "), shown).alias("name"))


# ---- quality and governance


@query("""SELECT level, passed, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 400000 THEN 'CRITICAL' WHEN o_orderstatus = 'P' THEN 'HIGH' WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'LOW' END AS level,
NOT (o_totalprice > 400000 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AS passed FROM orders) GROUP BY ALL""")
def ql01_rule_reports(spark: SparkSession, d: str) -> DataFrame:
    rules = {"price": (F.col("o_totalprice") <= 400000, "CRITICAL"), "status": (F.col("o_orderstatus") != "P", "HIGH"), "priority": (F.col("o_orderpriority") != "5-LOW", "LOW")}
    return governance.quality_reports(table(spark, d, "orders"), rules, "o_orderkey").groupBy("level", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'o_orderkey' AS \"column\", count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (o_orderstatus IS NULL) FROM orders")
def ql02_profile(spark: SparkSession, d: str) -> DataFrame:
    from strandline.operators.statistics import null_profile

    return null_profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


@query("SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value, 10.0::DOUBLE AS threshold, 'gt' AS comparison FROM orders HAVING count(*) > 10 UNION ALL SELECT 'min_price', min(o_totalprice), 1000000.0, 'lt' FROM orders HAVING min(o_totalprice) < 1000000")
def ql03_threshold_alerts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.min("o_totalprice").alias("min_price"), F.lit(3.0).alias("three"))
    metrics = orders.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rows", "min_price", "three")))))
    thresholds = spark.createDataFrame([("rows", 10.0, "gt"), ("min_price", 1e6, "lt"), ("three", 4.0, "eq")], "metric string, threshold double, comparison string")
    return governance.alerts(metrics, thresholds)


@query("SELECT r_name AS name FROM region WHERE contains(lower(r_name), '1') OR r_regionkey = 2")
def gv01_catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.when(F.col("r_regionkey") == 2, F.lit("holds 1 table")).otherwise(F.lit(""))
    datasets = table(spark, d, "region").select(F.col("r_name").alias("name"), tagged.alias("description"), F.array(F.lit("geo")).alias("tags"))
    return governance.search_catalogue(datasets, "1", "geo").select("name")


@query("SELECT r_name AS node, CAST(1 AS INTEGER) AS distance FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name = 'NATION_1' UNION ALL SELECT 'world', CAST(2 AS INTEGER)")
def gv02_lineage(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region")
    named = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    edges = named.unionByName(regions.select(F.lit("world").alias("source"), F.col("r_name").alias("target")))
    start = table(spark, d, "nation").filter("n_name = 'NATION_1'").select("n_name")
    return governance.lineage(edges, start, 2)


@query("SELECT c_custkey AS user_id, c_custkey % 3 <> 0 AS allowed FROM customer")
def gv03_access(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("sales").alias("dataset"))
    held = F.when(F.col("user_id") % 3 == 1, F.array(F.lit("read"))).when(F.col("user_id") % 3 == 2, F.array(F.lit("admin"))).otherwise(F.array(F.lit("write")))
    requests = users.withColumn("permission", F.lit("read"))
    return governance.allowed(requests, users.withColumn("permissions", held)).select("user_id", "allowed")


# ---- what the streams compute, over the table as a batch


@query(EV + "SELECT action, seconds // 3600 * 3600 AS start, seconds // 3600 * 3600 + 3600 AS \"end\", count(*) AS n, count(*) / 3600 AS rate FROM ev GROUP BY ALL")
def st03_rates(spark: SparkSession, d: str) -> DataFrame:
    return windows.rates(behaviours(spark, d), "action", length="1 hour")


@query(EV + ", s AS (SELECT action, unnest([seconds // 1800 * 1800, seconds // 1800 * 1800 - 1800]) AS start FROM ev) SELECT action, start, start + 3600 AS \"end\", count(*) AS n, count(*) / 3600 AS rate FROM s GROUP BY ALL")
def st03_sliding_rates(spark: SparkSession, d: str) -> DataFrame:
    return windows.rates(behaviours(spark, d), "action", length="1 hour", slide="30 minutes")


@query(EV + ", c AS (SELECT seconds // 3600 * 3600 AS start, count(*) FILTER (action = 'click') AS part, count(*) FILTER (action = 'view') AS whole FROM ev GROUP BY 1) SELECT start, start + 3600 AS \"end\", part, whole, CASE WHEN whole > 0 THEN part / whole ELSE 0.0 END AS ratio FROM c")
def st04_ctr_ratio(spark: SparkSession, d: str) -> DataFrame:
    return windows.ratios(behaviours(spark, d), F.col("action") == "click", F.col("action") == "view")


@query(EV + """, c AS (SELECT seconds // 86400 * 86400 AS start, count(*) AS n, count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 25) AS b, count(*) FILTER (value <= 50) AS c, count(*) FILTER (value <= 100) AS d FROM ev GROUP BY 1)
SELECT start, start + 86400 AS "end", round(CASE WHEN a >= n * 0.9 THEN 0 + 10 * (n * 0.9 - 0) / greatest(a, 1) WHEN b >= n * 0.9 THEN 10 + 15 * (n * 0.9 - a) / (b - a) WHEN c >= n * 0.9 THEN 25 + 25 * (n * 0.9 - b) / (c - b)
WHEN d >= n * 0.9 THEN 50 + 50 * (n * 0.9 - c) / (d - c) ELSE 100 END, 6)::DOUBLE AS quantile FROM c""")
def st05_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return windows.histogram_quantile(behaviours(spark, d), "value", [10, 25, 50, 100], 0.9, length="1 day").withColumn("quantile", F.round("quantile", 6))


@query(EV + "SELECT seconds // 86400 * 86400 AS start, seconds // 86400 * 86400 + 86400 AS \"end\", count(*) AS n, count(*) FILTER (value <= 20) / count(*) AS share FROM ev GROUP BY ALL")
def st06_share_under(spark: SparkSession, d: str) -> DataFrame:
    return windows.share_under(behaviours(spark, d), "value", 20, length="1 day")


@query(EV + "SELECT seconds // 3600 * 3600 AS start, seconds // 3600 * 3600 + 3600 AS \"end\", count(DISTINCT user_id) AS users FROM ev GROUP BY ALL")
def st07_active_users(spark: SparkSession, d: str) -> DataFrame:
    return windows.active_users(behaviours(spark, d))


@query(EV + """, c AS (SELECT seconds // 86400 * 86400 AS start, count(*) FILTER (action = 'click') / count(*) AS ratio FROM ev GROUP BY 1), m AS (SELECT *, ratio < 0.25 AS low, lag(start, 1) OVER (ORDER BY start) AS before, lag(ratio < 0.25, 1) OVER (ORDER BY start) AS low_before FROM c)
SELECT start, ratio FROM m WHERE low AND low_before AND start - before = 86400""")
def st08_sustained_alert(spark: SparkSession, d: str) -> DataFrame:
    daily = windows.ratios(behaviours(spark, d), F.col("action") == "click", F.lit(True), length="1 day")
    return alerts.sustained(daily, F.col("ratio") < 0.25, 2, step=86400).select("start", "ratio")


@query(EV + ", c AS (SELECT seconds // 3600 * 3600 AS start, count(*) AS n FROM ev GROUP BY 1) SELECT a.start, a.n, b.n AS n_before FROM c a JOIN c b ON b.start = a.start - 3600 WHERE a.n < 0.5 * b.n")
def st08_traffic_drop(spark: SparkSession, d: str) -> DataFrame:
    hourly = windows.rates(behaviours(spark, d), length="1 hour").select("start", "n")
    return alerts.dropped(hourly, "n", 0.5, 3600)


@query(EV + "SELECT action, seconds // 86400 * 86400 AS start, seconds // 86400 * 86400 + 86400 AS \"end\", count(*) FILTER (CAST(value AS VARCHAR) LIKE '1%') AS ones, count(*) FILTER (regexp_matches(CAST(value AS VARCHAR), '[.]5')) AS halves FROM ev GROUP BY ALL")
def st09_log_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = behaviours(spark, d).withColumn("line", F.format_string("%.2f", "value"))
    return windows.log_counts(lines, {"ones": "^1", "halves": r"\.5"}, "line", "action", length="1 day")


@query(EV + "SELECT h AS start FROM (SELECT unnest(range(min(seconds) // 3600, max(seconds) // 3600 + 1)) * 3600 AS h FROM ev) WHERE h NOT IN (SELECT seconds // 3600 * 3600 FROM ev)")
def st10_absent(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    span = ev.agg(F.min("seconds").alias("a"), F.max("seconds").alias("b"))
    hours = span.select(F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))).alias("h")).select((F.col("h") * 3600).alias("start"))
    return alerts.absent(hours, windows.rates(ev, length="1 hour"), ["start"])


@query(EV + """, f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, min(seconds) AS start, max(seconds) + 1800 AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def st12_session_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(behaviours(spark, d))


@query(EV + "SELECT event_id, action FROM ev WHERE action IN ('click', 'purchase')")
def st11_action_stream(spark: SparkSession, d: str) -> DataFrame:
    return validate.by_action(behaviours(spark, d), ["click", "purchase"]).select("event_id", "action")
