"""Queries on catalogue work: walks, clean-up, tabular features, skip-grams. Orders play titles and suppliers play people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays, times, tokens
from strandline.operators import catalogue, statistics
from strandline.operators.sequences import digits_sql, draw_sql, picked_sql
from strandline.plans.registry import query
from strandline.sources.tables import table


#: Order lines that meet in one task.
TASK_LINES = 1 << 20


def shown(array: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")


def _branded(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return _lines(spark, d).join(parts, "l_partkey")


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS movie FROM lineitem),
r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY person ORDER BY movie) <= 100)
SELECT person, string_agg(CAST(movie AS VARCHAR), ',' ORDER BY movie) AS movies FROM r GROUP BY person""")
def sq01_person_movies(spark: SparkSession, d: str) -> DataFrame:
    pairs = _lines(spark, d).select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("movie"))
    return catalogue.walk(pairs, "person", "movie", 1, 100, [F.col("movie")]).select("person", shown("members").alias("movies"))


CONTEXT_SQL = """WITH t AS (SELECT o_orderkey AS title, o_orderstatus AS kind, year(o_orderdate) AS y, o_totalprice / 50000 AS rating FROM orders),
dd AS (SELECT title, string_agg('DIR_' || p, ',' ORDER BY 'DIR_' || p) AS d, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS title, l_suppkey AS p FROM lineitem WHERE l_returnflag = 'R' QUALIFY dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) <= 5) GROUP BY title),
aa AS (SELECT title, string_agg('ACT_' || p, ',' ORDER BY 'ACT_' || p) AS a, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS title, l_suppkey AS p FROM lineitem WHERE l_returnflag <> 'R' QUALIFY dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) <= 20) GROUP BY title)
SELECT title, concat_ws(',', 'TYP_' || kind, 'ERA_' || (y // 10 * 10) || 's', 'RAT_' || printf('%.1f', round_even(rating * 2, 0) / 2), d, a) AS tokens
FROM t LEFT JOIN dd USING (title) LEFT JOIN aa USING (title)"""


@query(CONTEXT_SQL)
def sq02_movie_context(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("title"),
        F.col("o_orderstatus").alias("kind"),
        F.array().cast("array<string>").alias("genres"),
        times.era(F.year("o_orderdate").cast("string")).alias("era"),
        (F.col("o_totalprice") / 50000).alias("rating"),
    )
    people = _lines(spark, d).select(F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("person"), "l_returnflag")
    found = catalogue.context_tokens(titles, people.filter("l_returnflag = 'R'"), people.filter("l_returnflag <> 'R'"))
    return found.select("title", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT o_custkey AS series, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS episodes FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 2")
def sq03_series_episodes(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("episode"))
    return catalogue.walk(pairs, "series", "episode", 2).select("series", shown("members").alias("episodes"))


@query("SELECT l_orderkey AS title, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS people FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 20")
def sq04_co_supplier(spark: SparkSession, d: str) -> DataFrame:
    pairs = _lines(spark, d).select(F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("person"))
    return catalogue.groups_between(pairs, "title", "person", 2, 20).select("title", shown("members").alias("people"))


@query("SELECT genre, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS movies FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS genre, p_partkey FROM part) GROUP BY genre HAVING count(*) >= 5")
def sq05_genre_movies(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("genre"), "p_partkey")
    return catalogue.walk(pairs, "genre", "p_partkey", 5).select("genre", shown("members").alias("movies"))


@query("SELECT 'ERA_' || (year(o_orderdate) // 10 * 10) || 's' AS era, count(DISTINCT o_orderkey) AS movies, min(o_orderkey) AS first_movie FROM orders GROUP BY 1 HAVING count(*) >= 5")
def sq06_era_movies(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select(times.era(F.year("o_orderdate").cast("string")).alias("era"), "o_orderkey").filter("era != 'ERA_UNKNOWN'")
    found = catalogue.walk(pairs, "era", "o_orderkey", 5)
    return found.select("era", F.size("members").cast("long").alias("movies"), F.array_min("members").alias("first_movie"))


@query("SELECT 'RAT_' || printf('%.1f', round_even(l_discount * 200, 0) / 2) AS rating, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS movies FROM (SELECT DISTINCT l_discount, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) >= 5")
def sq07_rating_movies(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.concat(F.lit("RAT_"), tokens.rating_bucket(F.col("l_discount") * 100))
    return catalogue.walk(_lines(spark, d).select(bucket.alias("rating"), "l_partkey"), "rating", "l_partkey", 5).select("rating", shown("members").alias("movies"))


@query("SELECT l_suppkey AS director, string_agg(p_brand, ',' ORDER BY p_brand) AS genres FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R') GROUP BY l_suppkey HAVING count(*) >= 2")
def sq08_supplier_brands(spark: SparkSession, d: str) -> DataFrame:
    pairs = _branded(spark, d).filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("director"), "p_brand")
    return catalogue.walk(pairs, "director", "p_brand", 2).select("director", F.array_join("members", ",").alias("genres"))


@query("SELECT l_suppkey AS actor, string_agg(p_type, ',' ORDER BY p_type) AS genres FROM (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R') GROUP BY l_suppkey HAVING count(*) >= 2")
def sq09_actor_genres(spark: SparkSession, d: str) -> DataFrame:
    pairs = _branded(spark, d).filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("actor"), "p_type")
    return catalogue.walk(pairs, "actor", "p_type", 2).select("actor", F.array_join("members", ",").alias("genres"))


@query("SELECT p_brand AS director, o_orderpriority AS genre, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def jo12_explode_join(spark: SparkSession, d: str) -> DataFrame:
    # tasks by rows: shuffled pairs are so few bytes that as many as fill a partition would need gigabytes when they are told apart
    tasks = max(1, -(-table(spark, d, "lineitem").count() // TASK_LINES))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("genre")).repartition(tasks, "l_orderkey")
    brands = _branded(spark, d).select("l_orderkey", F.col("p_brand").alias("director")).repartition(tasks, "l_orderkey").distinct()
    # an order counts once for each brand and priority
    return brands.join(orders.distinct(), "l_orderkey").groupBy("director", "genre").agg(F.count(F.lit(1)).alias("n"))


def _walks(spark: SparkSession, d: str) -> DataFrame:
    pairs = _branded(spark, d).select("l_suppkey", F.concat(F.lit("GEN_"), "p_brand").alias("token"))
    return catalogue.walk(pairs, "l_suppkey", "token")


VOCAB = """WITH w AS (SELECT l_suppkey, 'GEN_' || p_brand AS token FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)),
v AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS BIGINT) AS id FROM (SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 8))"""


@query(VOCAB + " SELECT token, n, id FROM v")
def sq10_ranked_vocab(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.ranked_vocab(_walks(spark, d), "members", 10)


@query(VOCAB + """, l AS (SELECT l_suppkey, list(coalesce(id, 1) ORDER BY token) AS ids FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY token) <= 12) LEFT JOIN v USING (token) GROUP BY l_suppkey)
SELECT l_suppkey, array_to_string(list_concat(ids, list_transform(range(0, 12 - len(ids)), lambda x: 0)), ',') AS ids FROM l""")
def sq10_id_matrix(spark: SparkSession, d: str) -> DataFrame:
    walks = _walks(spark, d)
    found = catalogue.id_matrix(walks, "l_suppkey", "members", catalogue.ranked_vocab(walks, "members", 10), 12)
    return found.select("l_suppkey", shown("ids").alias("ids"))


TABULAR = """WITH h AS (SELECT l_orderkey, max((l_returnflag = 'A')::INTEGER) AS region_A, max((l_returnflag = 'N')::INTEGER) AS region_N, max((l_returnflag = 'R')::INTEGER) AS region_R FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, count(*) AS num_actors FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey), r AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS num_role_types FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS votes_log, coalesce(num_actors, 0) AS num_actors, coalesce(num_role_types, 0) AS num_role_types, coalesce(region_A, 0) AS region_A, coalesce(region_N, 0) AS region_N, coalesce(region_R, 0) AS region_R
FROM orders LEFT JOIN h ON h.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey"""


@query(TABULAR)
def sq11_tabular(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    # all three come from one grouping on the title, so the join needs one shuffle of it
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_quantity") > 25).alias("num_actors"),
        F.count_distinct("l_returnflag").alias("num_role_types"),
        *(F.max((F.col("l_returnflag") == f).cast("int")).alias(f"region_{f}") for f in "ANR"),
    )
    titles = table(spark, d, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 9).alias("votes_log"))
    return titles.join(per, "o_orderkey", "left").fillna(0)


@query("""SELECT o_orderkey, coalesce(q, 0) AS quantity, coalesce(n, 0) AS returned, c_name FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) b ON b.l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def jo02_left_chain(spark: SparkSession, d: str) -> DataFrame:
    per = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    whole = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(per, "o_orderkey", "left").join(people, "o_custkey", "left")
    return whole.select("o_orderkey", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("returned", F.lit(0)).alias("returned"), "c_name")


@query("SELECT p_partkey, coalesce(n, 0) AS n, coalesce(has_r, 0) AS has_r, coalesce(suppliers, 0) AS suppliers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max((l_returnflag = 'R')::INTEGER) AS has_r, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def jo03_tabular_join(spark: SparkSession, d: str) -> DataFrame:
    per = _lines(spark, d).groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("has_r"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    return table(spark, d, "part").select("p_partkey").join(per, "p_partkey", "left").fillna(0)


@query("""WITH s AS (SELECT 'PER_' || s_suppkey AS token, s_name AS name, 0 AS p FROM supplier UNION ALL SELECT 'MOV_' || p_partkey, p_name, 1 FROM part UNION ALL SELECT 'PER_' || c_custkey, c_name, 2 FROM customer)
SELECT token, arg_min(name, (p, name)) AS name FROM s GROUP BY token""")
def jo18_name_dictionary(spark: SparkSession, d: str) -> DataFrame:
    def source(name: str, prefix: str, key: str, label: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("token"), F.col(label).alias("name"))

    return catalogue.name_dictionary(source("supplier", "PER_", "s_suppkey", "s_name"), source("part", "MOV_", "p_partkey", "p_name"), source("customer", "PER_", "c_custkey", "c_name"))


@query("SELECT lower(p_name) AS name, min('MOV_' || p_partkey) AS token FROM part GROUP BY 1")
def jo18_reverse_names(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.reverse_names(table(spark, d, "part").select(F.concat(F.lit("MOV_"), F.col("p_partkey").cast("string")).alias("token"), F.col("p_name").alias("name")))


@query("""WITH c AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_type) AS r FROM c)
SELECT l_suppkey, coalesce(max(p_type) FILTER (r = 1), '\\N') AS role_1, coalesce(max(p_type) FILTER (r = 2), '\\N') AS role_2, coalesce(max(p_type) FILTER (r = 3), '\\N') AS role_3 FROM r GROUP BY l_suppkey""")
def ag20_role_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.role_columns(_branded(spark, d), "l_suppkey", "p_type", 3)


@query("SELECT c_nationkey, max((c_mktsegment = 'MACHINERY')::INTEGER) AS seg_MACHINERY, max((c_mktsegment = 'HOUSEHOLD')::INTEGER) AS seg_HOUSEHOLD FROM customer GROUP BY c_nationkey")
def ag21_pivot(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.one_hot(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["MACHINERY", "HOUSEHOLD"], "seg")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag IN ('A', 'R')) AS num_actors, count(DISTINCT l_returnflag) AS num_roles FROM lineitem GROUP BY l_orderkey")
def ag22_actor_counts(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag").isin("A", "R")).alias("num_actors"), F.count_distinct("l_returnflag").alias("num_roles"))


@query("SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_brand HAVING count(*) >= 5")
def ag23_group_members(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.walk(table(spark, d, "part"), "p_brand", "p_partkey", 5).select("p_brand", shown("members").alias("members"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END, (SELECT median(p_size) FROM part WHERE p_size > 10)) AS size FROM part")
def ag24_median_impute(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("size"))
    return statistics.impute_median(sized, "size")


@query("SELECT p_size AS id, count(*) AS n FROM part WHERE p_size > 1 GROUP BY p_size")
def ag25_bincount(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list("p_size").alias("ids"))
    return lists.select(F.explode("ids").alias("id")).filter("id > 1").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split_part(token, '_', 1) AS kind, count(*) AS n FROM (SELECT 'MOV_' || p_partkey AS token FROM part UNION ALL SELECT 'PER_' || s_suppkey FROM supplier UNION ALL SELECT 'plain' || n_nationkey FROM nation) WHERE contains(token, '_') GROUP BY 1 UNION ALL SELECT 'OTHER', count(*) FROM nation")
def ag31_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    def tokens_of(name: str, key: str, prefix: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("token"))

    all_tokens = tokens_of("part", "p_partkey", "MOV_").unionByName(tokens_of("supplier", "s_suppkey", "PER_")).unionByName(tokens_of("nation", "n_nationkey", "plain"))
    return all_tokens.groupBy(tokens.entity_type(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN y IS NULL THEN 'ERA_UNKNOWN' WHEN y < 1920 THEN 'ERA_SILENT' WHEN y >= 2020 THEN 'ERA_2020s' ELSE 'ERA_' || (y // 10 * 10) || 's' END AS era, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE year(o_orderdate) - CASE WHEN o_orderkey % 3 = 0 THEN 85 ELSE 0 END END AS y FROM orders) GROUP BY 1")
def fn06_era(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate") - F.when(F.col("o_orderkey") % 3 == 0, 85).otherwise(0)
    text = F.when(F.col("o_orderkey") % 50 == 0, "\\N").otherwise(year.cast("string"))
    return table(spark, d, "orders").groupBy(times.era(text).alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT printf('%.1f', round_even(l_discount * 100 * 2, 0) / 2) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def fn07_rating_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(tokens.rating_bucket(F.col("l_discount") * 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'GEN_' || p_brand END AS token FROM part")
def fn08_prefixed(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 10 == 0, "\\N").when(F.col("p_partkey") % 5 == 0, "UNKNOWN").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", tokens.prefixed(value, "genre").alias("token"))


@query("SELECT DISTINCT p_brand, CASE WHEN contains(t, '_') THEN split_part(t, '_', 1) ELSE 'OTHER' END AS kind FROM (SELECT p_brand, CASE WHEN p_brand < 'Brand#2' THEN 'GEN_' || p_brand ELSE p_brand END AS t FROM part)")
def fn09_entity_type(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("p_brand") < "Brand#2", F.concat(F.lit("GEN_"), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_brand", tokens.entity_type(token).alias("kind")).distinct()


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS part_1, coalesce(string_split(p_name, ' ')[2], '\\N') AS part_2, coalesce(string_split(p_name, ' ')[3], '\\N') AS part_3 FROM part")
def fn22_split_columns(spark: SparkSession, d: str) -> DataFrame:
    parts = arrays.parts(F.col("p_name"), " ", 3)
    return table(spark, d, "part").select("p_partkey", *(p.alias(f"part_{i + 1}") for i, p in enumerate(parts)))


@query("""WITH e AS (SELECT o_custkey, o_orderkey FROM orders), v AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)
SELECT o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderkey IN (SELECT o_orderkey FROM v)), '\\N') AS known FROM e GROUP BY o_custkey""")
def fn23_keep_members(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    lists = catalogue.walk(orders, "o_custkey", "o_orderkey").select("o_custkey", shown("members").alias("known"))
    return catalogue.keep_members(lists, "o_custkey", "known", orders.filter("o_totalprice > 250000").select("o_orderkey"))


@query("SELECT p_partkey, round(ln(1 + p_retailprice), 9) AS log_price FROM part")
def fn24_log1p(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(F.log1p("p_retailprice"), 9).alias("log_price"))


@query("SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 0) + coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS number FROM part")
def fn25_to_number(spark: SparkSession, d: str) -> DataFrame:
    def number(c: F.Column) -> F.Column:
        return F.coalesce(c.try_cast("double"), F.lit(0.0))

    return table(spark, d, "part").select("p_partkey", (number(F.substring_index("p_brand", "#", -1)) + number(F.col("p_name"))).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, least(o_totalprice / 100000, 3.0) AS capped, coalesce(nullif(o_orderstatus, 'P'), 'open') AS status FROM orders")
def fn26_conditionals(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(price > 300000, "big").when(price > 100000, "mid").otherwise("small").alias("size"),
        F.least(price / 100000, F.lit(3.0)).alias("capped"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("open")).alias("status"),
    )


@query("SELECT p_partkey AS item_id, (p_partkey % 3 = 1)::INTEGER + (p_partkey % 3 = 1 AND p_partkey % 5 = 2)::INTEGER + (p_partkey % 3 = 1 AND p_partkey % 5 = 2 AND p_partkey % 7 = 3)::INTEGER AS level FROM part WHERE p_partkey % 3 = 1 ORDER BY level DESC, item_id LIMIT 100")
def fn34_semantic_match(spark: SparkSession, d: str) -> DataFrame:
    sid = F.array(*(F.col("p_partkey") % m for m in (3, 5, 7)))
    level = F.when(F.slice(sid, 1, 3) == F.array(*(F.lit(x).cast("long") for x in (1, 2, 3))), 3).when(F.slice(sid, 1, 2) == F.array(*(F.lit(x).cast("long") for x in (1, 2))), 2).otherwise(1)
    return table(spark, d, "part").filter(F.get(sid, F.lit(0)) == 1).select(F.col("p_partkey").alias("item_id"), level.alias("level")).orderBy(F.desc("level"), "item_id").limit(100)


@query("SELECT token, n, round(least(1.0, sqrt(0.02 / f) + 0.02 / f), 9) AS keep FROM (SELECT p_brand AS token, count(*) AS n, count(*) / sum(count(*)) OVER () AS f FROM part GROUP BY p_brand)")
def sl17_keep_probability(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return catalogue.keep_probability(counts, threshold=0.02).withColumn("keep", F.round("keep", 9))


@query("SELECT token, n, round(pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 9) AS p FROM (SELECT p_brand AS token, count(*) AS n FROM part GROUP BY p_brand)")
def sl16_negative_distribution(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return catalogue.negative_distribution(counts).withColumn("p", F.round("p", 9))


def _id_sequences(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("l"))
    return lists.select("l_orderkey", F.col("l.l_suppkey").alias("ids"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i FROM lineitem WHERE l_suppkey > 1)
SELECT a.l_orderkey, a.id AS target, b.id AS context FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i AND abs(a.i - b.i) <= 2""")
def ar11_skip_grams_fixed(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.skip_grams(_id_sequences(spark, d), "l_orderkey", "ids", 2, dynamic=False)


@query(f"""WITH s AS (SELECT l_orderkey, l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS i FROM lineitem WHERE l_suppkey > 1),
w AS (SELECT *, floor({draw_sql('l_orderkey', 'i')} * 3) + 1 AS w FROM s)
SELECT a.l_orderkey, a.id AS target, b.id AS context FROM w a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i AND abs(a.i - b.i) <= a.w""")
def ar11_skip_grams_dynamic(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.skip_grams(_id_sequences(spark, d), "l_orderkey", "ids", 3)


@query(f"""WITH s AS (SELECT l_orderkey, l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i FROM lineitem WHERE l_suppkey > 1),
pairs AS (SELECT a.l_orderkey, a.id AS target, b.id AS context FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND abs(a.i - b.i) = 1), c AS (SELECT l_suppkey AS id, pow(count(*), 0.75) AS w FROM lineitem GROUP BY l_suppkey),
shares AS (SELECT id, sum(w) OVER o / sum(w) OVER () AS hi, (sum(w) OVER o - w) / sum(w) OVER () AS lo FROM c WINDOW o AS (ORDER BY {digits_sql('id')} % 64, {digits_sql('id')}, id)),
drawn AS (SELECT *, {picked_sql('target', 'context', 'k')} AS spot FROM pairs, (SELECT unnest([1, 2]) AS k))
SELECT l_orderkey, target, context, context AS candidate, 1 AS label FROM pairs UNION ALL SELECT l_orderkey, target, context, id, 0 FROM drawn JOIN shares ON lo <= spot AND spot < hi""")
def ar12_negative_samples(spark: SparkSession, d: str) -> DataFrame:
    pairs = catalogue.skip_grams(_id_sequences(spark, d), "l_orderkey", "ids", 1, dynamic=False)
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return catalogue.with_negatives(pairs, catalogue.negative_distribution(counts), "id", 2)


@query("SELECT 'genre' AS grp, count(*) AS n FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey) UNION ALL SELECT 'series', count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 2)")
def so10_sequence_groups(spark: SparkSession, d: str) -> DataFrame:
    genre = _walks(spark, d).select(F.lit("genre").alias("grp"), F.col("members").alias("tokens"))
    series = sq03_series_episodes(spark, d).select(F.lit("series").alias("grp"), F.split("episodes", ",").alias("tokens"))
    return genre.unionByName(series).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, list_aggregate(list_sort(list(p_size)), 'min') AS least, count(*) AS n FROM part GROUP BY p_brand")
def ud02_grouped_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_min(F.sort_array(F.collect_list("p_size"))).alias("least"), F.count(F.lit(1)).alias("n"))


# ---- arrays


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "p_size")))
    return table(spark, d, "part").groupBy("p_brand").agg(listed.alias("l")).select("p_brand", F.col("l.p_size").alias("a"), F.transform(F.slice("l.p_size", 1, 3), lambda x: x).alias("b"))


SIZES = "WITH s AS (SELECT p_brand, list(p_size ORDER BY p_partkey) AS a FROM part GROUP BY p_brand) "


@query("SELECT p_brand, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY f) AS sizes FROM (SELECT p_brand, p_size, min(p_partkey) AS f FROM part GROUP BY ALL) GROUP BY p_brand")
def so05_unique_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).withColumn("u", arrays.unique(F.col("a"))).select("p_brand", shown("u").alias("sizes"))


@query(SIZES + "SELECT p_brand, array_to_string(list_filter(a, lambda x: NOT list_contains(a[1:3], x)), ',') AS sizes FROM s")
def so06_difference(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).withColumn("u", arrays.difference(F.col("a"), F.col("b"))).select("p_brand", shown("u").alias("sizes"))


@query(SIZES + "SELECT p_brand, array_to_string(list_filter(a, lambda x: list_contains(a[1:3], x)), ',') AS sizes FROM s")
def so07_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).withColumn("u", arrays.intersection(F.col("a"), F.col("b"))).select("p_brand", shown("u").alias("sizes"))


@query(SIZES + ", e AS (SELECT p_brand, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS place FROM s) SELECT p_brand, string_agg(place || ':' || v, ',' ORDER BY v DESC, place) AS top FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, place) <= 4) GROUP BY p_brand")
def sl07_top_k_array(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(arrays.top_k(F.col("a"), 4), lambda t: F.concat(t["place"].cast("string"), F.lit(":"), t["value"].cast("string")))
    return _sizes(spark, d).select("p_brand", F.array_join(found, ",").alias("top"))


@query(SIZES + "SELECT p_brand, round(exp(a[1] - list_max(a)) / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 9) AS first_share FROM s")
def fn30_softmax(spark: SparkSession, d: str) -> DataFrame:
    from strandline.functions import vectors

    return _sizes(spark, d).select("p_brand", F.round(F.get(vectors.softmax(F.col("a")), F.lit(0)), 9).alias("first_share"))


@query("SELECT c_custkey, concat('a', c_nationkey) AS country, CAST(0 AS INTEGER) AS age, c_mktsegment AS segment FROM customer")
def ar18_map_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("country"), F.concat(F.lit("a"), F.col("c_nationkey").cast("string")), F.lit("segment"), F.col("c_mktsegment"), F.lit("age"), F.lit("n/a"))
    return table(spark, d, "customer").select("c_custkey", m.alias("m")).select(
        "c_custkey", F.col("m")["country"].alias("country"), F.coalesce(F.col("m")["age"].try_cast("int"), F.lit(0)).alias("age"), F.col("m")["segment"].alias("segment")
    )
