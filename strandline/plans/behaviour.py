"""Queries on the behaviour log: filters, time features, sequences, sessions, samples, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays, times, tokens
from strandline.operators import sequences, tokenizer, validate, vocabulary
from strandline.plans.registry import query
from strandline.sources.tables import BEHAVIOURS_SQL as EV
from strandline.sources.tables import behaviours, table

TYPES = ("view", "click", "purchase", "signup")


def joined(array: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


# ---- projections and filters


@query(EV + """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week,
       CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_bucket,
       dayofweek(ts) IN (0, 6) AS is_weekend FROM ev""")
def pf01_time_features(spark: SparkSession, d: str) -> DataFrame:
    return sequences.time_features(behaviours(spark, d)).select("event_id", "hour", "day_of_week", "time_bucket", "is_weekend")


@query(EV + "SELECT user_id, count(*) AS seq_length FROM ev GROUP BY user_id HAVING count(*) >= 5")
def pf02_min_length(spark: SparkSession, d: str) -> DataFrame:
    return sequences.user_sequences(behaviours(spark, d), most=1 << 30, least=5, fields=("item_id",)).select("user_id", "seq_length")


@query(EV + "SELECT event_id, action FROM ev WHERE action IN ('view', 'click', 'purchase') AND action NOT IN ('view')")
def pf03_action_filter(spark: SparkSession, d: str) -> DataFrame:
    return validate.by_action(behaviours(spark, d), ["view", "click", "purchase"], ["view"]).select("event_id", "action")


@query(EV + "SELECT event_id, seconds FROM ev WHERE seconds BETWEEN 1704585600 AND 1705190400")
def pf04_time_range(spark: SparkSession, d: str) -> DataFrame:
    return validate.by_time(behaviours(spark, d), 1704585600, 1705190400).select("event_id", "seconds")


@query("SELECT p_partkey, p_name FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 30)")
def pf05_semi_filters(spark: SparkSession, d: str) -> DataFrame:
    parts = validate.by_action(table(spark, d, "part"), exclude=["PROMO", "SMALL"], action="p_type")
    sold = table(spark, d, "lineitem").filter("l_quantity >= 30").select(F.col("l_partkey").alias("p_partkey"))
    return validate.semi(parts, sold, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey AS item_id, p_name AS title, p_brand AS category FROM part")
def pf06_prune_rename(spark: SparkSession, d: str) -> DataFrame:
    gone = ["p_type", "p_size", "p_retailprice", "not_there"]
    return validate.prune(table(spark, d, "part"), gone, {"p_partkey": "item_id", "p_name": "title", "p_brand": "category"})


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderstatus, '\\N') AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def pf07_fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_orderstatus")
    left = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return validate.fill(left, {"o_orderkey": -1, "o_orderstatus": "\\N"}).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#2'")
def pf08_optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.optional_filter(table(spark, d, "part"), p_brand="Brand#2", p_type=None).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def pf09_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 17, 99, 100000000)")
def pf10_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_partkey").isin(1, 5, 17, 99, 100000000)).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IN (1, 2, 3)")
def pf11_json_containment(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,int>")
    return table(spark, d, "events").filter(F.arrays_overlap(F.map_values(props), F.array(F.lit(1), F.lit(2), F.lit(3)))).select("event_id")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small'])")
def pf12_array_overlap(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").filter(F.arrays_overlap(words, F.array(F.lit("red"), F.lit("small")))).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid')")
def pf13_substring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.lower("p_name").contains("WID".lower())).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def pf14_multi_select(spark: SparkSession, d: str) -> DataFrame:
    return validate.by_action(table(spark, d, "part"), ["ECONOMY", "STANDARD"], action="p_type").select("p_partkey", "p_type")


@query("SELECT p_partkey, CAST((SELECT count(*) FROM part) AS BIGINT) AS total FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def pf15_page_slice(spark: SparkSession, d: str) -> DataFrame:
    return validate.page(table(spark, d, "part").select("p_partkey"), [F.col("p_partkey")], 3, 20)


@query("SELECT p_partkey, p_type, CAST((SELECT count(*) FROM part WHERE p_type = 'ECONOMY') AS BIGINT) AS total FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey DESC LIMIT 10 OFFSET 10")
def pf16_list_with_total(spark: SparkSession, d: str) -> DataFrame:
    chosen = validate.optional_filter(table(spark, d, "part"), p_type="ECONOMY", p_brand=None).select("p_partkey", "p_type")
    return validate.page(chosen, [F.desc("p_partkey")], 2, 10)


@query(EV + """
SELECT concat_ws(',', CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN item_id IS NULL THEN 'item_id' END,
                 CASE WHEN action NOT IN ('view', 'click', 'purchase', 'signup') THEN 'event_type' END) AS errors, count(*) AS n
FROM ev GROUP BY 1""")
def pf17_validation(spark: SparkSession, d: str) -> DataFrame:
    rules = validate.event_rules(types=TYPES)
    return behaviours(spark, d).groupBy(F.array_join(validate.failures(rules), ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + """
SELECT 'value_range' AS rule, count(*) FILTER (NOT (value BETWEEN 0 AND 100)) AS violations FROM ev
UNION ALL SELECT 'known_action', count(*) FILTER (action NOT IN ('view', 'click', 'purchase', 'signup')) FROM ev
UNION ALL SELECT 'item_range', count(*) FILTER (NOT (item_id BETWEEN 0 AND 98)) FROM ev""")
def pf18_check_constraints(spark: SparkSession, d: str) -> DataFrame:
    checks = {"value_range": F.col("value").between(0, 100), "known_action": F.col("action").isin(*TYPES), "item_range": F.col("item_id").between(0, 98)}
    return validate.violations(behaviours(spark, d), checks)


@query("""SELECT s_suppkey, CAST(s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS INTEGER) AS is_returned,
                CAST(s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS INTEGER) AS is_bulk FROM supplier""")
def pf19_membership_flags(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    sets = {"is_returned": lines.filter("l_returnflag = 'R'").select("l_suppkey"), "is_bulk": lines.filter("l_quantity > 49").select("l_suppkey")}
    return validate.membership_flags(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", **sets)


@query(EV + """
SELECT 'active_30d' AS filter, count(DISTINCT user_id) AS n FROM ev WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 30 DAY
UNION ALL SELECT 'cold', count(*) FROM (SELECT user_id FROM ev GROUP BY user_id HAVING count(*) < 10)
UNION ALL SELECT 'valued_items', count(*) FROM (SELECT item_id FROM ev WHERE action = 'purchase' GROUP BY item_id HAVING count(*) >= 10 AND avg(value) >= 4)""")
def pf20_named_filters(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    last = ev.agg(F.max("ts").alias("last"))
    active = ev.join(F.broadcast(last)).filter(F.col("ts") > F.col("last") - F.expr("INTERVAL 30 DAYS")).select("user_id").distinct()
    cold = ev.groupBy("user_id").count().filter("count < 10")
    valued = ev.filter("action = 'purchase'").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")).filter("n >= 10 AND v >= 4")
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n") for name, x in (("active_30d", active), ("cold", cold), ("valued_items", valued))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey, p_name, p_brand FROM part")
def pf21_strip_strings(spark: SparkSession, d: str) -> DataFrame:
    padded = table(spark, d, "part").select("p_partkey", F.concat(F.lit("\t "), "p_name", F.lit(" \n")).alias("p_name"), F.concat("p_brand", F.lit("  ")).alias("p_brand"))
    return validate.strip_strings(padded)


@query(EV + "SELECT count(*) AS extracted, count(*) FILTER (action <> 'error') AS loaded, count(*) FILTER (action = 'error') AS failed FROM ev")
def pf22_transform_chain(spark: SparkSession, d: str) -> DataFrame:
    chained = behaviours(spark, d).transform(validate.strip_strings).transform(lambda x: x.withColumn("errors", validate.failures(validate.event_rules(types=TYPES))))
    return chained.agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.size("errors") == 0).alias("loaded"), F.count_if(F.size("errors") > 0).alias("failed"))


# ---- sequences


@query(EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev)
SELECT user_id, count(*) AS seq_length, min(seconds) AS first_seconds, max(seconds) AS last_seconds,
       string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY n) AS items, string_agg(action, ',' ORDER BY n) AS actions
FROM r WHERE n <= 500 GROUP BY user_id""")
def ag01_user_sequences(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.user_sequences(behaviours(spark, d), 500)
    return found.select("user_id", "seq_length", "first_seconds", "last_seconds", joined("events.item_id").alias("items"), F.array_join("events.action", ",").alias("actions"))


@query(EV + "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM ev")
def wn01_row_number(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select("event_id", F.row_number().over(sequences.in_order()).cast("long").alias("position"))


@query(EV + """, f AS (SELECT *, CASE WHEN seconds - lag(seconds) OVER w > 1800 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(seconds) AS started, max(seconds) AS ended FROM s GROUP BY user_id, session""")
def wn03_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.sessions(behaviours(spark, d)).groupBy("user_id", F.col("session").cast("long").alias("session"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("seconds").alias("started"), F.max("seconds").alias("ended"))


@query(EV + "SELECT user_id, item_id, max_by(event_id, (ts, event_id)) AS event_id FROM ev WHERE item_id IS NOT NULL GROUP BY user_id, item_id")
def wn04_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return sequences.deduplicated(behaviours(spark, d)).select("user_id", "item_id", "event_id")


@query(EV + """SELECT event_id, item_id AS target, string_agg(CAST(item_id AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history
FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1""")
def wn05_next_item(spark: SparkSession, d: str) -> DataFrame:
    return sequences.next_item_samples(behaviours(spark, d), 5).select("event_id", F.col("item_id").alias("target"), joined("history").alias("history"))


@query(EV + """, f AS (SELECT *, CASE WHEN seconds - lag(seconds) OVER w > 1800 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f),
p AS (SELECT user_id, session, count(*) AS n, arg_min(item_id, (ts, event_id)) AS first_item FROM s GROUP BY ALL)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS BIGINT) AS history_length, first_item AS target_item
FROM p QUALIFY session > 0""")
def wn10_session_samples(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.session_samples(behaviours(spark, d))
    return found.select("user_id", F.col("session").cast("long").alias("session"), F.size("history").cast("long").alias("history_length"), "target_item")


@query(EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
starts AS (SELECT user_id, i AS first, least(i + 10, n - 1) AS last FROM r WHERE i % 5 = 0 AND i <= n - 2)
SELECT s.user_id, CAST(s.first AS INTEGER) AS start, CAST(s.last AS INTEGER) AS "end",
       string_agg(CAST(r.item_id AS VARCHAR), ',' ORDER BY r.i) FILTER (r.i < s.last) AS input, max(r.item_id) FILTER (r.i = s.last) AS target
FROM starts s JOIN r ON r.user_id = s.user_id AND r.i BETWEEN s.first AND s.last GROUP BY s.user_id, s.first, s.last""")
def ar04_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.sliding_samples(sequences.user_sequences(behaviours(spark, d), 1 << 30), 10, 5)
    return found.select("user_id", "start", "end", joined("input.item_id").alias("input"), F.col("target.item_id").alias("target"))


@query(EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ev)
SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM r WHERE n <= 20 GROUP BY user_id""")
def ar19_newest_ascending(spark: SparkSession, d: str) -> DataFrame:
    return sequences.user_sequences(behaviours(spark, d), 20, keep="last").select("user_id", F.col("seq_length").alias("n"), joined("events.item_id").alias("items"))


@query(EV + """SELECT user_id, event_id, string_agg(CAST(item_id AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS anchor, item_id AS positive
FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1""")
def ar05_contrastive(spark: SparkSession, d: str) -> DataFrame:
    return sequences.contrastive(behaviours(spark, d), 10).select("user_id", "event_id", joined("anchor").alias("anchor"), "positive")


def _negatives_sql(weight: str, positive: str = "action = 'purchase'") -> str:
    """The twin of `sequences.negatives` with four draws out of all items, as the table `ranked`."""
    digits = sequences.digits_sql("item_id")
    return EV + f""", pool AS (SELECT item_id, CAST({weight} AS DOUBLE) AS w FROM ev WHERE item_id IS NOT NULL GROUP BY item_id), wanted AS (SELECT DISTINCT user_id, item_id FROM ev WHERE {positive}),
shares AS (SELECT item_id AS negative, sum(w) OVER o / sum(w) OVER () AS hi, (sum(w) OVER o - w) / sum(w) OVER () AS lo, row_number() OVER o - 1 AS place FROM pool WINDOW o AS (ORDER BY {digits} % 64, {digits}, item_id)),
tried AS (SELECT *, {sequences.picked_sql('user_id', 'item_id', 'try')} AS spot FROM wanted, (SELECT unnest(range(0, 16)) AS try)),
fresh AS (SELECT user_id, item_id, negative, min(try) AS try FROM tried t JOIN shares ON lo <= spot AND spot < hi WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.user_id = t.user_id AND w.item_id = negative) GROUP BY ALL),
short AS (SELECT w.user_id, w.item_id FROM wanted w LEFT JOIN fresh f USING (user_id, item_id) GROUP BY ALL HAVING count(f.negative) < 4),
free AS (SELECT user_id, negative, place FROM (SELECT DISTINCT user_id FROM short) s, shares WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.user_id = s.user_id AND w.item_id = negative) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) <= 4),
whole AS (SELECT * FROM fresh UNION ALL SELECT user_id, item_id, negative, place + 16 FROM short JOIN free USING (user_id)), best AS (SELECT user_id, item_id, negative, min(try) AS try FROM whole GROUP BY ALL),
ranked AS (SELECT user_id, item_id, negative, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY try, negative) AS INTEGER) AS rank FROM best QUALIFY rank <= 4)
"""


@query(_negatives_sql("1", "item_id IS NOT NULL") + """, lists AS (SELECT user_id, item_id, string_agg(CAST(negative AS VARCHAR), ',' ORDER BY rank) AS negatives FROM ranked GROUP BY user_id, item_id),
anchors AS (SELECT user_id, event_id, string_agg(CAST(item_id AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS anchor, item_id AS positive
FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1)
SELECT a.user_id, event_id, anchor, positive, coalesce(negatives, '') AS negatives FROM anchors a LEFT JOIN lists l ON l.user_id = a.user_id AND l.item_id = positive""")
def ar05_contrastive_triples(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and positives with items that the user never touched."""
    ev = behaviours(spark, d)
    triples = sequences.contrastive_triples(ev, ev.select("item_id").filter("item_id is not null").distinct(), 10, 4)
    return triples.select("user_id", "event_id", joined("anchor").alias("anchor"), "positive", joined("negatives").alias("negatives"))


@query(EV + "SELECT event_id, user_id, CAST(seconds AS BIGINT) AS seconds FROM ev WHERE action IN ('view', 'click')")
def ar01_explode_events(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.user_sequences(behaviours(spark, d), 1 << 30).select("user_id", F.explode("events").alias("event"))
    return found.filter(F.col("event.action").isin("view", "click")).select("event.event_id", "user_id", "event.seconds")


@query(EV + "SELECT event_id, coalesce(CAST(item_id AS VARCHAR), 'unknown') AS item, coalesce(action, 'view') AS action, 'unknown' AS device FROM ev")
def ar02_struct_defaults(spark: SparkSession, d: str) -> DataFrame:
    event = F.struct(
        F.coalesce(F.col("item_id").cast("string"), F.lit("unknown")).alias("item"),
        F.coalesce("action", F.lit("view")).alias("action"),
        F.coalesce(F.lit(None).cast("string"), F.lit("unknown")).alias("device"),
    )
    return behaviours(spark, d).select("event_id", event.alias("e")).select("event_id", "e.*")


@query(EV + "SELECT user_id, string_agg(action || ':' || CAST(item_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS trail FROM ev GROUP BY user_id")
def ar03_transform_structs(spark: SparkSession, d: str) -> DataFrame:
    trail = F.transform("events", lambda e: F.concat(e["action"], F.lit(":"), e["item_id"].cast("string")))
    return sequences.user_sequences(behaviours(spark, d), 1 << 30).select("user_id", F.array_join(trail, " ").alias("trail"))


AUGMENTED_SQL = EV + """, r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS seq_length FROM ev),
d AS (SELECT *, """ + sequences.draw_sql("user_id", "i") + """ AS draw, """ + sequences.draw_sql("user_id", "0") + " AS d0, " + sequences.draw_sql("user_id", "1") + " AS d1 FROM r) "


def _augmented(spark: SparkSession, d: str, how) -> DataFrame:
    found = sequences.user_sequences(behaviours(spark, d), 1 << 30)
    return found.select("user_id", "seq_length", joined(how("events.item_id", F.col("user_id"))).alias("items"))


@query(AUGMENTED_SQL + """SELECT user_id, seq_length, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY i) FILTER (draw >= 0.1), CAST(any_value(item_id) FILTER (i = 0) AS VARCHAR)) AS items
FROM d GROUP BY user_id, seq_length""")
def ar06_augment_dropout(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, sequences.dropout)


@query(AUGMENTED_SQL + """, c AS (SELECT *, CAST(greatest(least(seq_length, 2), ceil(seq_length * (CAST(0.5 AS DOUBLE) + (1 - CAST(0.5 AS DOUBLE)) * d0))) AS INTEGER) AS size FROM d),
p AS (SELECT *, CAST(floor(d1 * (seq_length - size + 1)) AS INTEGER) AS start FROM c)
SELECT user_id, seq_length, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY i) AS items FROM p WHERE i >= start AND i < start + size GROUP BY user_id, seq_length""")
def ar06_augment_crop(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, lambda e, k: sequences.crop(F.col(e), k))


@query(AUGMENTED_SQL + "SELECT user_id, seq_length, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY i // 3, draw, item_id) AS items FROM d GROUP BY user_id, seq_length")
def ar06_augment_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, sequences.shuffled)


# ---- splits and samples


@query("""SELECT CASE WHEN (event_id * 7919 + 17) % 10 < 8 THEN 'train' WHEN (event_id * 7919 + 17) % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM events GROUP BY 1""")
def sl14_split_counts(spark: SparkSession, d: str) -> DataFrame:
    bucket = (F.col("event_id") * 7919 + 17) % 10
    return table(spark, d, "events").groupBy(sequences.split_of(bucket).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + """, b AS (SELECT event_id, user_id, CAST('0x' || left(md5(CAST(user_id AS VARCHAR)), 7) AS BIGINT) % 10 AS b FROM ev)
SELECT event_id, user_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'val' ELSE 'test' END AS split FROM b""")
def sl13_hash_split(spark: SparkSession, d: str) -> DataFrame:
    split = sequences.split_of(sequences.by_hash("user_id"))
    return behaviours(spark, d).select("event_id", "user_id", split.alias("split"))


@query(_negatives_sql("1") + "SELECT * FROM ranked")
def sl15_negatives_uniform(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d).filter("action = 'purchase'")
    pool = behaviours(spark, d).select("item_id").distinct()
    return sequences.negatives(ev, pool, 4)


@query(_negatives_sql("count(*)") + "SELECT * FROM ranked")
def sl15_negatives_popularity(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    pool = ev.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))
    return sequences.negatives(ev.filter("action = 'purchase'"), pool, 4, weight="popularity")


@query(EV + """, r AS (SELECT user_id, item_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7919 + 17) % 1000003, event_id) AS n FROM ev)
SELECT user_id, item_id, event_id FROM r WHERE n <= 3""")
def sl11_sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy((F.col("event_id") * 7919 + 17) % 1000003, "event_id")
    return behaviours(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("user_id", "item_id", "event_id")


@query("SELECT vec_id FROM embeddings ORDER BY (vec_id * 7919 + 17) % 1000003, vec_id LIMIT 50")
def sl12_sample_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id").orderBy((F.col("vec_id") * 7919 + 17) % 1000003, "vec_id").limit(50)


@query(EV + "SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, event_id) AS chunk_items, CAST((n - 1) // 4 AS INTEGER) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev) GROUP BY user_id, (n - 1) // 4")
def sl18_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.user_sequences(behaviours(spark, d), 1 << 30).select("user_id", F.posexplode(arrays.chunks(F.col("events.item_id"), 4)))
    return found.select("user_id", joined("col").alias("chunk_items"), F.col("pos").alias("chunk"))


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) WHERE n <= 100")
def sl08_recent_history(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    last = ev.agg(F.max("ts").alias("last"))
    recent = ev.join(F.broadcast(last)).filter(F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return recent.withColumn("n", F.row_number().over(w)).filter("n <= 100").select("event_id", "user_id", "value")


# ---- vocabulary and tokens

VOCAB_SQL = EV + """, tokens AS (
  SELECT 'ACTION_' || lower(trim(action)) AS token FROM ev UNION ALL SELECT 'ITEM_' || CAST(item_id AS VARCHAR) FROM ev
  UNION ALL SELECT 'TIME_' || CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END FROM ev
  UNION ALL SELECT 'TIME_' || CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END FROM ev
), counted AS (SELECT token, count(*) AS n FROM tokens GROUP BY token HAVING count(*) >= 5),
vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 4 AS BIGINT) AS id FROM counted)
"""


def event_tokens(ev: DataFrame) -> DataFrame:
    """One scan gives all four streams of tokens."""
    each = F.concat(F.array(tokens.action(F.col("action")), F.concat(F.lit("ITEM_"), F.col("item_id").cast("string"))), tokens.time_tokens("ts"))
    return ev.select("event_id", "user_id", "ts", F.posexplode(each).alias("pos", "token"))


@query(VOCAB_SQL + "SELECT token, n, id FROM vocab")
def so01_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5)


@query(VOCAB_SQL + "SELECT token, n FROM counted")
def ag02_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.counts(event_tokens(behaviours(spark, d)), least=5)


@query(VOCAB_SQL + "SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS rank FROM (SELECT * FROM counted ORDER BY n DESC, token LIMIT 40)")
def wn02_global_rank(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5, most=40, first_id=1).select("token", F.col("id").alias("rank"))


@query(VOCAB_SQL + "SELECT token, n FROM counted ORDER BY n DESC, token LIMIT 25")
def sl01_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.counts(event_tokens(behaviours(spark, d)), least=5).orderBy(F.desc("n"), "token").limit(25)


@query(VOCAB_SQL + ", top AS (SELECT token, id FROM vocab WHERE id < 30) SELECT event_id, 'ITEM_' || CAST(item_id AS VARCHAR) AS token, coalesce(top.id, 4) AS id FROM ev LEFT JOIN top ON top.token = 'ITEM_' || CAST(item_id AS VARCHAR)")
def jo17_encode(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    vocab = vocabulary.vocabulary(event_tokens(ev), 5).filter("id < 30")
    return vocabulary.encode(ev.select("event_id", F.concat(F.lit("ITEM_"), F.col("item_id").cast("string")).alias("token")), vocab)


@query(VOCAB_SQL + "SELECT i.id, coalesce(token, '[UNK]') AS token FROM (SELECT unnest(range(0, 60)) AS id) i LEFT JOIN vocab USING (id)")
def jo17_decode(spark: SparkSession, d: str) -> DataFrame:
    vocab = vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5)
    return vocabulary.decode(spark.range(60), vocab).select("id", "token")


TOKENISED_SQL = VOCAB_SQL + """, each AS (
  SELECT user_id, ts, event_id, 0 AS pos, 'ACTION_' || lower(trim(action)) AS token FROM ev
  UNION ALL SELECT user_id, ts, event_id, 1, 'ITEM_' || CAST(item_id AS VARCHAR) FROM ev
  UNION ALL SELECT user_id, ts, event_id, 2, 'TIME_' || CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END FROM ev
  UNION ALL SELECT user_id, ts, event_id, 3, 'TIME_' || CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END FROM ev
), numbered AS (
  SELECT user_id, coalesce(id, 4) AS id, CASE WHEN token LIKE 'ITEM%' THEN 1 WHEN token LIKE 'ACTION%' THEN 2 ELSE 3 END AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, pos DESC) AS back FROM each LEFT JOIN vocab USING (token)
)"""


def _tokenised(spark: SparkSession, d: str, length: int) -> DataFrame:
    ev = behaviours(spark, d)
    vocab = vocabulary.vocabulary(event_tokens(ev), 5)
    return tokenizer.tokenised(event_tokens(ev), vocab, length)


@query(TOKENISED_SQL + """, framed AS (SELECT user_id, list(id ORDER BY back DESC) AS ids, list(kind ORDER BY back DESC) AS kinds FROM numbered WHERE back <= 62 GROUP BY user_id),
whole AS (SELECT user_id, list_concat([1], ids, [2]) AS ids, list_concat([3], kinds, [3]) AS kinds FROM framed)
SELECT user_id, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(kinds, list_transform(range(0, 64 - len(kinds)), lambda x: 0)), ',') AS token_types,
       len(ids) AS valid FROM whole""")
def ar07_tokenise(spark: SparkSession, d: str) -> DataFrame:
    """The first token stays [CLS]; a long sequence keeps its last tokens, [SEP] included."""
    found = _tokenised(spark, d, 64)
    return found.select("user_id", joined("input_ids").alias("input_ids"), joined("token_types").alias("token_types"), tokenizer.total(F.col("attention_mask")).cast("long").alias("valid"))


@query(TOKENISED_SQL + """, framed AS (SELECT user_id, count(*) FILTER (back <= 62) + 2 AS n FROM numbered GROUP BY user_id)
SELECT user_id, CAST(n - 1 AS INTEGER) AS label_at, CAST(64 - 1 AS BIGINT) AS ignored FROM framed""")
def ar08_labels(spark: SparkSession, d: str) -> DataFrame:
    found = _tokenised(spark, d, 64).withColumn("labels", tokenizer.labels(F.col("attention_mask"), F.lit(7)))
    return found.select("user_id", (F.array_position("labels", 7) - 1).cast("int").alias("label_at"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("ignored"))


@query(TOKENISED_SQL + """, framed AS (SELECT user_id, count(*) FILTER (back <= 62) AS n, count(*) FILTER (back <= 62 AND id = 4) AS unk FROM numbered GROUP BY user_id)
SELECT user_id, CAST(64 - n + unk AS BIGINT) AS specials FROM framed""")
def ar09_special_mask(spark: SparkSession, d: str) -> DataFrame:
    return _tokenised(spark, d, 64).select("user_id", tokenizer.total(tokenizer.special_mask(F.col("input_ids"))).cast("long").alias("specials"))


@query(TOKENISED_SQL + f""", framed AS (SELECT user_id, list(id ORDER BY back DESC) AS ids FROM numbered WHERE back <= 62 GROUP BY user_id),
whole AS (SELECT user_id, list_concat([1], ids, [2], list_transform(range(0, 62 - len(ids)), lambda x: 0)) AS ids FROM framed),
flat AS (SELECT user_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM whole),
m AS (SELECT user_id, x, i, x >= 5 AND {sequences.draw_sql('user_id', 'i')} < 0.15 AS chosen, {sequences.draw_sql('user_id', 'i', seed=43)} AS how, 5 + floor({sequences.draw_sql('user_id', 'i', seed=44)} * (120 - 5)) AS other FROM flat)
SELECT user_id, string_agg(CAST(CAST(CASE WHEN NOT chosen THEN x WHEN how < 0.8 THEN 3 WHEN how < 0.9 THEN other ELSE x END AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS input_ids,
       string_agg(CAST(CASE WHEN chosen THEN x ELSE -100 END AS VARCHAR), ',' ORDER BY i) AS labels FROM m GROUP BY user_id""")
def ar10_mlm_mask(spark: SparkSession, d: str) -> DataFrame:
    found = _tokenised(spark, d, 64).withColumn("m", tokenizer.mlm(F.col("input_ids"), F.col("user_id"), vocab_size=120))
    return found.select("user_id", joined("m.input_ids").alias("input_ids"), joined("m.labels").alias("labels"))


@query(TOKENISED_SQL + "SELECT count(DISTINCT user_id) AS samples, count(DISTINCT user_id) AS valid, CAST(0 AS BIGINT) AS issues FROM numbered")
def ag26_sample_validation(spark: SparkSession, d: str) -> DataFrame:
    found = tokenizer.issues(_tokenised(spark, d, 64), 64)
    return found.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("issues") == 0).alias("valid"), F.sum(F.size("issues")).cast("long").alias("issues"))


@query(TOKENISED_SQL + "SELECT DISTINCT user_id, '' AS issues FROM numbered")
def ar17_array_issues(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.issues(_tokenised(spark, d, 64), 64).select("user_id", F.array_join("issues", ",").alias("issues"))


@query(TOKENISED_SQL + """SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY back DESC) AS ids FROM numbered WHERE back <= 15 GROUP BY user_id""")
def sl09_keep_last(spark: SparkSession, d: str) -> DataFrame:
    kept = arrays.head_and_last(F.col("ids"), 16)
    found = tokenizer.id_sequences(event_tokens(behaviours(spark, d)), vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5)).withColumn("ids", F.concat(F.array(F.lit(1).cast("long")), "ids"))
    return found.select("user_id", joined(F.slice(kept, 2, 15)).alias("ids"))


@query(TOKENISED_SQL + """, firsts AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS n FROM numbered),
l AS (SELECT user_id, list(id ORDER BY n) AS ids FROM firsts WHERE n <= 24 GROUP BY user_id)
SELECT user_id, array_to_string(list_concat(ids, list_transform(range(0, 24 - len(ids)), lambda x: 0)), ',') AS ids FROM l""")
def sl10_pad_first(spark: SparkSession, d: str) -> DataFrame:
    found = tokenizer.id_sequences(event_tokens(behaviours(spark, d)), vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5))
    return found.select("user_id", joined(arrays.padded(F.col("ids"), 24, F.lit(0).cast("long"))).alias("ids"))


@query("SELECT DISTINCT p_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM part")
def fn12_stable_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name").distinct().select("p_name", tokens.stable_hash(F.col("p_name")).alias("h"))


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM part)
SELECT p_partkey, 'ITEM_' || (h % 1024) || '_' || (h // 1024 % 4096) || '_' || (h // 4194304 % 16384) AS token FROM h""")
def fn11_item_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tokens.item(F.col("p_partkey")).alias("token"))


@query("SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS l1, CAST(p_partkey % 11 AS INTEGER) AS l2, CAST(p_size AS INTEGER) AS l3 FROM part")
def fn16_parse_item(spark: SparkSession, d: str) -> DataFrame:
    sid = F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 11, F.col("p_size").cast("long"))
    found = table(spark, d, "part").select("p_partkey", tokens.parse_item(tokens.item(F.col("p_partkey"), sid)).alias("s"))
    return found.select("p_partkey", *(F.get("s", F.lit(i)).alias(f"l{i + 1}") for i in range(3)))


@query(EV + "SELECT event_id, 'ACTION_' || lower(trim(action)) AS token FROM ev")
def fn10_action_token(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select("event_id", tokens.action(F.col("action")).alias("token"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'DEVICE_desktop' ELSE 'DEVICE_other' END AS token FROM customer")
def fn13_device_token(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" Desktop ")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", tokens.device(named).alias("token"))


@query("""SELECT event_id, concat_ws(',', 'CONTEXT_' || lower(event_type), CASE WHEN user_id <= 3 THEN 'CONTEXT_top' WHEN user_id <= 10 THEN 'CONTEXT_mid' ELSE 'CONTEXT_bottom' END,
CASE WHEN value > 50 THEN 'CONTEXT_has_keyword' END) AS tokens FROM events""")
def fn14_context_tokens(spark: SparkSession, d: str) -> DataFrame:
    keyword = F.when(F.col("value") > 50, "word")
    found = tokens.context_tokens(F.col("event_type"), F.col("user_id").cast("string"), keyword)
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("tokens"))


@query("""SELECT c_custkey, 'USER_age_' || CASE WHEN a < 18 THEN 'teen' WHEN a < 25 THEN 'young' WHEN a < 35 THEN 'adult' WHEN a < 50 THEN 'middle' ELSE 'senior' END
 || ',USER_gender_' || CASE c_custkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'u' END || ',USER_level_' || c_nationkey AS tokens FROM (SELECT *, c_custkey % 80 AS a FROM customer)""")
def fn15_user_tokens(spark: SparkSession, d: str) -> DataFrame:
    sex = F.get(F.array(F.lit("Male"), F.lit("女"), F.lit("x")), (F.col("c_custkey") % 3).cast("int"))
    found = tokens.user_tokens((F.col("c_custkey") % 80).cast("string"), sex, F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, ",").alias("tokens"))


@query(VOCAB_SQL + "SELECT token, CASE WHEN token LIKE 'ITEM%' THEN 'ITEM' WHEN token LIKE 'ACTION%' THEN 'ACTION' ELSE 'CONTEXT' END AS kind, CASE WHEN token LIKE 'ITEM%' THEN 1 WHEN token LIKE 'ACTION%' THEN 2 ELSE 3 END AS kind_id FROM vocab")
def fn17_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    vocab = vocabulary.vocabulary(event_tokens(behaviours(spark, d)), 5)
    return vocab.select("token", tokens.kind(F.col("token")).alias("kind"), tokens.kind_id(F.col("token")).alias("kind_id"))


@query(EV + "SELECT user_id, count(*) AS items, count(*) AS actions FROM ev GROUP BY user_id")
def fn18_extract_tokens(spark: SparkSession, d: str) -> DataFrame:
    all_tokens = event_tokens(behaviours(spark, d)).groupBy("user_id").agg(F.collect_list("token").alias("t"))
    items, actions = (F.size(F.filter("t", lambda x: tokens.kind(x) == k)).cast("long") for k in ("ITEM", "ACTION"))
    return all_tokens.select("user_id", items.alias("items"), actions.alias("actions"))


@query("""SELECT c_custkey, CAST(1000 + CASE WHEN a < 18 THEN 0 WHEN a < 26 THEN 1 WHEN a < 36 THEN 2 WHEN a < 46 THEN 3 WHEN a < 56 THEN 4 ELSE 5 END AS BIGINT) AS age_token,
CAST(1100 + CASE WHEN a % 3 = 0 THEN 0 WHEN a % 3 = 1 THEN 1 ELSE 2 END AS BIGINT) AS gender_token, CAST(2000 + CASE WHEN a % 24 < 6 THEN 0 WHEN a % 24 < 12 THEN 1 WHEN a % 24 < 18 THEN 2 ELSE 3 END AS BIGINT) AS hour_token
FROM (SELECT c_custkey, c_custkey % 80 AS a FROM customer)""")
def fn19_service_tokens(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("c_custkey") % 80
    sex = F.get(F.array(F.lit("male"), F.lit("F"), F.lit("?")), (a % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", tokens.service_age(a).alias("age_token"), tokens.service_gender(sex).alias("gender_token"), tokens.service_hour(a % 24).alias("hour_token"))


@query("SELECT p_partkey, 'TYPE_' || p_type || ',CAT_' || p_brand || ',TAG_' || array_to_string(string_split(p_name, ' '), ',TAG_') AS tokens FROM part")
def fn20_item_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.item_description(F.col("p_type"), F.col("p_brand"), F.lit(""), F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("tokens"))


@query(EV + """SELECT user_id, string_agg('ACTION_' || action || ' ITEM_' || item_id || ' TIME_' || CASE WHEN hour(ts) < 6 THEN 'NIGHT' WHEN hour(ts) < 12 THEN 'MORNING' WHEN hour(ts) < 18 THEN 'AFTERNOON' ELSE 'EVENING' END, ' ' ORDER BY ts, event_id) AS tokens FROM ev GROUP BY user_id""")
def fn21_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return sequences.user_sequences(behaviours(spark, d), 1 << 30).select("user_id", F.array_join(tokens.interleaved(F.col("events")), " ").alias("tokens"))


@query(EV + "SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS bucket, count(*) AS n FROM ev GROUP BY 1")
def fn01_time_buckets(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy(times.bucket(F.hour("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS kind, count(*) AS n FROM ev GROUP BY 1")
def fn02_weekday(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy(times.weekday_token("ts").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT event_id, seconds, CAST(hour(make_timestamp(seconds * 1000000)) AS INTEGER) AS hour, CAST(dayofweek(make_timestamp(seconds * 1000000)) + 1 AS INTEGER) AS weekday FROM ev")
def fn03_from_seconds(spark: SparkSession, d: str) -> DataFrame:
    back = F.expr(f"timestampadd(SECOND, seconds, {times.EPOCH})")
    return behaviours(spark, d).select("event_id", "seconds", F.hour(back).alias("hour"), F.dayofweek(back).alias("weekday"))


@query(EV + "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y_%m') AS next_month, count(*) AS n FROM ev GROUP BY 1, 2")
def fn04_calendar(spark: SparkSession, d: str) -> DataFrame:
    after = F.add_months(F.trunc(F.to_date("ts"), "month"), 1)
    return behaviours(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(after, "yyyy_MM").alias("next_month")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT count(*) FILTER (ts > m - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (ts > m - INTERVAL 7 DAY) AS last_week FROM ev, (SELECT max(ts) AS m FROM ev)")
def fn05_as_of(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    whole = ev.join(F.broadcast(ev.agg(F.max("ts").alias("m"))))
    return whole.agg(F.count_if(F.col("ts") > F.col("m") - F.expr("INTERVAL 24 HOURS")).alias("last_day"), F.count_if(F.col("ts") > F.col("m") - F.expr("INTERVAL 7 DAYS")).alias("last_week"))
