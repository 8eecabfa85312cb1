"""SQL functions that return tables, for `spark.sql` users: SELECT … FROM users u, LATERAL candidates(u.user_id, NULL, NULL, 10).

Catalyst inlines a function's body and turns the lateral call into joins, so one call runs for all rows that it is called with. They read
temporary views of fixed names, which `views` makes from DataFrames. What a user has already seen is one array for each user asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors

#: Arguments, returned columns and body of each function.
FUNCTIONS = {
    "cosine_of": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        """aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
           / sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x))""",
    ),
    "candidates": (
        "u BIGINT, wanted_type STRING, wanted_category STRING, k INT",
        "TABLE (item_id BIGINT, title STRING, popularity DOUBLE, rank INT)",
        """SELECT item_id, title, popularity, rank FROM (
             SELECT i.*, CAST(row_number() OVER (ORDER BY i.popularity DESC NULLS LAST, i.rating DESC NULLS LAST, i.item_id) AS INT) AS rank
             FROM tf_items i JOIN (SELECT collect_set(item_id) AS seen FROM tf_seen_month WHERE user_id = u) s
             WHERE i.active AND (wanted_type IS NULL OR i.type = wanted_type) AND (wanted_category IS NULL OR i.category = wanted_category)
               AND NOT array_contains(s.seen, i.item_id)
           ) WHERE rank <= k""",
    ),
    "similar_by_behaviour": (
        "item BIGINT, k INT",
        "TABLE (similar_item_id BIGINT, users BIGINT, score DOUBLE, rank INT)",
        """SELECT item_id, users, score, rank FROM (
             SELECT item_id, users, weighted / max(weighted) OVER () AS score, CAST(row_number() OVER (ORDER BY weighted DESC, item_id) AS INT) AS rank FROM (
               SELECT b.item_id, count(*) AS users, sum(b.weight) AS weighted FROM tf_weights a JOIN tf_weights b ON a.user_id = b.user_id
               WHERE a.item_id = item AND b.item_id <> item GROUP BY b.item_id HAVING count(*) >= 3
             )
           ) WHERE rank <= k""",
    ),
    "items_for_user": (
        "u BIGINT, wanted_type STRING, k INT, least DOUBLE",
        "TABLE (item_id BIGINT, similarity DOUBLE, rank INT)",
        """SELECT item_id, similarity, rank FROM (
             SELECT i.item_id, round(cosine_of(v.embedding, i.embedding), 6) AS similarity,
                    CAST(row_number() OVER (ORDER BY round(cosine_of(v.embedding, i.embedding), 6) DESC, i.item_id) AS INT) AS rank
             FROM tf_items i JOIN tf_users v JOIN (SELECT collect_set(item_id) AS seen FROM tf_seen_week WHERE user_id = u) s
             WHERE v.user_id = u AND i.active AND i.embedding IS NOT NULL AND (wanted_type IS NULL OR i.type = wanted_type)
               AND round(cosine_of(v.embedding, i.embedding), 6) >= least AND NOT array_contains(s.seen, i.item_id)
           ) WHERE rank <= k""",
    ),
    "similar_items": (
        "item BIGINT, k INT, same_type BOOLEAN",
        "TABLE (similar_item_id BIGINT, similarity DOUBLE, rank INT)",
        """SELECT item_id, similarity, rank FROM (
             SELECT i.item_id, round(cosine_of(o.embedding, i.embedding), 6) AS similarity,
                    CAST(row_number() OVER (ORDER BY round(cosine_of(o.embedding, i.embedding), 6) DESC, i.item_id) AS INT) AS rank
             FROM tf_items i JOIN tf_items o
             WHERE o.item_id = item AND i.item_id <> item AND i.active AND i.embedding IS NOT NULL AND o.embedding IS NOT NULL AND (NOT same_type OR i.type = o.type)
           ) WHERE rank <= k""",
    ),
    "similar_users": (
        "u BIGINT, k INT",
        "TABLE (similar_user_id BIGINT, similarity DOUBLE, rank INT)",
        """SELECT user_id, similarity, rank FROM (
             SELECT o.user_id, round(cosine_of(v.embedding, o.embedding), 6) AS similarity,
                    CAST(row_number() OVER (ORDER BY round(cosine_of(v.embedding, o.embedding), 6) DESC, o.user_id) AS INT) AS rank
             FROM tf_users v JOIN tf_users o WHERE v.user_id = u AND o.user_id <> u
           ) WHERE rank <= k""",
    ),
    "items_by_semantic_id": (
        "sid ARRAY<INT>, k INT",
        "TABLE (item_id BIGINT, level INT, rank INT)",
        """SELECT item_id, level, rank FROM (
             SELECT item_id, level, CAST(row_number() OVER (ORDER BY level DESC, item_id DESC) AS INT) AS rank FROM (
               SELECT item_id, CASE WHEN semantic_id = sid THEN 3 WHEN slice(semantic_id, 1, 2) = slice(sid, 1, 2) THEN 2 ELSE 1 END AS level
               FROM tf_items WHERE active AND semantic_id[0] = sid[0]
             )
           ) WHERE rank <= k""",
    ),
}


def views(behaviours: DataFrame, items: DataFrame) -> None:
    """The views that the functions read.

    `behaviours` has user_id, item_id, action and ts; `items` has item_id, title, type, category, popularity, rating, active, semantic_id and
    embedding, each of which may be null. Months and weeks are counted back from the newest behaviour. A user's vector is the mean of
    those of the different items with a weight.
    """
    newest = behaviours.agg(F.max("ts").alias("_max"))
    dated = behaviours.join(F.broadcast(newest))  # one row
    kinds = ("click", "buy", "purchase")
    for name, days, actions in (("tf_seen_month", 30, (*kinds, "like")), ("tf_seen_week", 7, kinds)):
        seen = dated.filter(F.col("action").isin(*actions) & (F.col("ts") > F.col("_max") - F.expr(f"INTERVAL {days} DAYS")))
        seen.select("user_id", F.col("item_id").cast("long").alias("item_id")).distinct().createOrReplaceTempView(name)
    weight = F.when(F.col("action").isin("buy", "purchase"), 5.0).when(F.col("action") == "like", 3.0).otherwise(1.0)
    used = dated.filter(F.col("action").isin(*kinds, "like") & (F.col("ts") > F.col("_max") - F.expr("INTERVAL 90 DAYS")))
    weights = used.groupBy("user_id", F.col("item_id").cast("long").alias("item_id")).agg(F.sum(weight).alias("weight"))
    weights.createOrReplaceTempView("tf_weights")
    whole = items.withColumns({"item_id": F.col("item_id").cast("long"), "embedding": vectors.as_doubles(F.col("embedding"))})
    whole.createOrReplaceTempView("tf_items")
    each = weights.join(whole.select("item_id", F.posexplode("embedding").alias("i", "x")), "item_id").groupBy("user_id", "i").agg(F.avg("x").alias("x"))
    users = each.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("user_id", F.col("v.x").alias("embedding"))
    users.createOrReplaceTempView("tf_users")


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session, in place of any of the same names. The views must be there."""
    for name, (arguments, returned, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returned} RETURN {body}")
