"""Queries on statistics, profiles, candidates and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import profiles, recommend, sequences, statistics, validate
from strandline.plans.registry import query
from strandline.sources.tables import BEHAVIOURS_SQL as EV
from strandline.sources.tables import behaviours, purchases, table

# ---- aggregations


@query(EV + ", p AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length, round(stddev_samp(n), 9) AS std_length FROM p")
def ag03_length_stats(spark: SparkSession, d: str) -> DataFrame:
    per = behaviours(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("avg_length"), F.round(F.stddev_samp("n"), 9).alias("std_length"))


@query(EV + "SELECT min(seconds) AS first_seconds, max(seconds) AS last_seconds FROM ev")
def ag04_time_range(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).agg(F.min("seconds").alias("first_seconds"), F.max("seconds").alias("last_seconds"))


@query(EV + "SELECT action, count(*) AS n FROM ev GROUP BY action")
def ag05_action_distribution(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT count(DISTINCT item_id) AS items, count(*) / count(DISTINCT user_id) AS events_per_user FROM ev")
def ag06_distinct_items(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).agg(F.count_distinct("item_id").alias("items"), (F.count(F.lit(1)) / F.count_distinct("user_id")).alias("events_per_user"))


ITEM_STATS = """SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks,
count(*) FILTER (action IN ('purchase', 'buy')) AS purchases FROM ev GROUP BY item_id"""


@query(EV + f"SELECT *, CASE WHEN views > 0 THEN clicks / views ELSE 0.0 END AS click_rate, CASE WHEN clicks > 0 THEN purchases / clicks ELSE 0.0 END AS conversion_rate FROM ({ITEM_STATS})")
def ag07_item_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.item_stats(behaviours(spark, d))


@query(EV + """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT item_id) AS items, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks,
count(*) FILTER (action IN ('purchase', 'buy')) AS purchases, round(avg(value) FILTER (action IN ('purchase', 'buy')), 9) AS avg_value FROM ev GROUP BY ALL""")
def ag08_user_daily(spark: SparkSession, d: str) -> DataFrame:
    return statistics.user_daily(behaviours(spark, d)).withColumn("avg_value", F.round("avg_value", 9))


@query(EV + """SELECT *, CASE WHEN views > 0 THEN clicks / views ELSE 0.0 END AS ctr FROM (SELECT item_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users,
count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks FROM ev GROUP BY ALL)""")
def ag09_item_daily_ctr(spark: SparkSession, d: str) -> DataFrame:
    return statistics.item_daily(behaviours(spark, d))


@query(EV + """, c AS (SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (action = 'click') AS clicks, count(*) FILTER (action = 'like') AS likes,
count(*) FILTER (action IN ('purchase', 'buy')) AS purchases FROM ev WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 7 DAY GROUP BY item_id HAVING count(*) >= 10)
SELECT *, n + 2 * clicks + 3 * likes + 5 * purchases AS score FROM c ORDER BY score DESC, item_id LIMIT 100""")
def ag10_trending_items(spark: SparkSession, d: str) -> DataFrame:
    return statistics.trending(behaviours(spark, d), most=100)


@query(EV + f"SELECT item_id, round(0.3 * views + 0.5 * clicks + 20 * coalesce(r, 0), 6) AS score FROM ({ITEM_STATS}) LEFT JOIN (SELECT item_id, avg(value) AS r FROM ev WHERE action = 'purchase' GROUP BY item_id) USING (item_id) ORDER BY score DESC, item_id LIMIT 1000")
def ag11_hot_items(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    rated = ev.filter("action = 'purchase'").groupBy("item_id").agg(F.avg("value").alias("rating"))
    found = statistics.scored(statistics.item_stats(ev).join(rated, "item_id", "left"), statistics.HOT)
    return found.select("item_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(1000)


@query(EV + """SELECT p_partkey AS item_id, count(event_id) AS n, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks,
CAST(count(*) FILTER (action = 'view') + 2 * count(*) FILTER (action = 'click') + 5 * count(*) FILTER (action = 'purchase') AS DOUBLE) AS popularity FROM part LEFT JOIN ev ON item_id = p_partkey GROUP BY p_partkey""")
def ag12_stats_rebuild(spark: SparkSession, d: str) -> DataFrame:
    stats = statistics.item_stats(behaviours(spark, d)).select("item_id", "n", "views", "clicks", "purchases")
    whole = table(spark, d, "part").select(F.col("p_partkey").alias("item_id")).join(stats, "item_id", "left").fillna(0)
    return statistics.scored(whole, {"views": 1.0, "clicks": 2.0, "purchases": 5.0}, "popularity").drop("purchases")


@query(EV + """SELECT user_id, count(*) AS total, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks, count(*) FILTER (action IN ('purchase', 'buy')) AS purchases,
max(seconds) AS last_active, count(*) < 10 AS is_cold_start, least(count(*) / 100, 10.0) AS activity FROM ev GROUP BY user_id""")
def ag13_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profiles(behaviours(spark, d))


@query("""SELECT 'items' AS kind, CAST(label AS VARCHAR) AS model, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 'all', 'all', count(*) FROM embeddings""")
def ag14_embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    per = e.groupBy(F.col("label").cast("string").alias("model")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("items").alias("kind"), "model", "n")
    return per.unionByName(e.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("kind"), F.lit("all").alias("model"), "n"))


COUNTED = ("customer", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED))
def ag15_row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in COUNTED:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(EV + """, h AS (SELECT user_id, hour(ts) AS hour, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS n FROM ev GROUP BY user_id, hour(ts)),
p AS (SELECT user_id, coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (c > n / 24), '') AS preferred_hours FROM h GROUP BY user_id)
SELECT user_id, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'click') AS clicks, count(*) FILTER (action IN ('purchase', 'buy')) AS purchases,
count(DISTINCT CAST(ts AS DATE)) AS active_days, max(seconds) AS last_active, any_value(preferred_hours) AS preferred_hours FROM ev JOIN p USING (user_id) GROUP BY user_id""")
def ag16_behaviour_features(spark: SparkSession, d: str) -> DataFrame:
    return profiles.behaviour_features(behaviours(spark, d)).withColumn("preferred_hours", F.array_join(F.transform("preferred_hours", lambda h: h.cast("string")), ","))


PREFERENCE_SQL = EV + """, w AS (SELECT user_id, item_id, CASE action WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END::DOUBLE AS w FROM ev)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("item_id"), F.col("p_brand").alias("category"), F.split("p_name", " ").alias("tags"), F.col("p_retailprice").alias("price"))


@query(PREFERENCE_SQL + """, s AS (SELECT user_id, p_brand AS category, sum(w) AS score FROM w JOIN part ON p_partkey = item_id GROUP BY ALL)
SELECT user_id, category, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, category) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def ag17_category_preferences(spark: SparkSession, d: str) -> DataFrame:
    return profiles.preferences(behaviours(spark, d), _items(spark, d), "category", 10)


@query(PREFERENCE_SQL + """, s AS (SELECT user_id, tag AS tags, sum(w) AS score FROM w JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) ON p_partkey = item_id GROUP BY ALL)
SELECT user_id, tags, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, tags) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""")
def ag17_tag_preferences(spark: SparkSession, d: str) -> DataFrame:
    return profiles.preferences(behaviours(spark, d), _items(spark, d), "tags", 20)


@query(EV + "SELECT user_id, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM ev JOIN part ON p_partkey = item_id GROUP BY user_id")
def ag17_price_range(spark: SparkSession, d: str) -> DataFrame:
    return profiles.price_range(behaviours(spark, d), _items(spark, d))


@query(EV + """, a AS (SELECT user_id, string_agg(action || '=' || c, ',' ORDER BY action) AS actions FROM (SELECT user_id, action, count(*) AS c FROM ev GROUP BY ALL) GROUP BY user_id),
h AS (SELECT user_id, string_agg(hour || '=' || c, ',' ORDER BY hour) AS hours FROM (SELECT user_id, hour(ts) AS hour, count(*) AS c FROM ev GROUP BY ALL) GROUP BY user_id)
SELECT user_id, actions, hours FROM a JOIN h USING (user_id)""")
def ag18_action_hour_maps(spark: SparkSession, d: str) -> DataFrame:
    def shown(name: str) -> F.Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")

    return profiles.action_counts(behaviours(spark, d)).select("user_id", shown("action_counts").alias("actions"), shown("active_hours").alias("hours"))


@query(EV + ", p AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS events, avg(n) AS avg_events, max(n) AS max_events, min(n) AS min_events, (SELECT count(DISTINCT item_id) FROM ev) AS items FROM p")
def ag19_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequences.statistics(behaviours(spark, d))


@query(EV + "SELECT item_id, count(*) AS n FROM ev GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10")
def ag19_top_items(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(10)


@query("SELECT c.column_name AS \"column\", (SELECT count(*) FROM events) AS rows, CAST(0 AS BIGINT) AS nulls FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name) c")
def ag27_null_profile(spark: SparkSession, d: str) -> DataFrame:
    return statistics.null_profile(table(spark, d, "events"))


@query(EV + """, b AS (SELECT least(CAST(floor(value / 10) AS INTEGER), 9) AS bucket, seconds < 1705190400 AS early FROM ev),
c AS (SELECT bucket, count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS a FROM b GROUP BY bucket),
s AS (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM c)
SELECT round(sum((a - e) * ln(a / e)), 9) AS psi FROM s""")
def ag28_drift_psi(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d).withColumn("bucket", F.least(F.floor(F.col("value") / 10).cast("int"), F.lit(9)))
    found = statistics.population_stability(ev.filter("seconds < 1705190400"), ev.filter("seconds >= 1705190400"), "bucket")
    return found.select(F.round("psi", 9).alias("psi"))


@query(EV + "SELECT item_id, max_by(value, (ts, event_id)) AS value FROM ev GROUP BY item_id")
def wn07_latest_per_item(spark: SparkSession, d: str) -> DataFrame:
    return statistics.latest_per(behaviours(spark, d), "item_id").select("item_id", "value")


@query(EV + """, i AS (SELECT count(*) FILTER (action = 'view') AS impressions, count(*) FILTER (action = 'click') AS clicks, count(*) FILTER (action = 'purchase') AS conversions,
avg(value) FILTER (action = 'view') AS dwell, coalesce(sum(value) FILTER (action = 'purchase'), 0) AS revenue FROM ev)
SELECT clicks / impressions AS ctr, conversions / clicks AS cvr, round(dwell, 9) AS avg_dwell, round(revenue, 4) AS revenue FROM i""")
def ag32_online_counters(spark: SparkSession, d: str) -> DataFrame:
    views, clicks, bought = statistics.n_of("view"), statistics.n_of("click"), statistics.n_of("purchase")
    return behaviours(spark, d).agg(
        statistics.ratio(clicks, views).alias("ctr"),
        statistics.ratio(bought, clicks).alias("cvr"),
        F.round(F.avg(F.when(F.col("action") == "view", F.col("value"))), 9).alias("avg_dwell"),
        F.round(F.coalesce(F.sum(F.when(F.col("action") == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("revenue"),
    )


@query(EV + """SELECT user_id % 3 AS experiment_group, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (action = 'click') AS clicks, count(DISTINCT user_id) AS users,
CASE WHEN count(*) FILTER (action = 'view') > 0 THEN count(*) FILTER (action = 'click') / count(*) FILTER (action = 'view') ELSE 0.0 END AS ctr FROM ev GROUP BY 1, 2""")
def ag33_experiment_hourly(spark: SparkSession, d: str) -> DataFrame:
    grouped = behaviours(spark, d).groupBy((F.col("user_id") % 3).alias("experiment_group"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), statistics.n_of("click").alias("clicks"), F.count_distinct("user_id").alias("users"), statistics.ratio(statistics.n_of("click"), statistics.n_of("view")).alias("ctr")
    )


LATENCY_SQL = EV + """, s AS (SELECT action, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_pop(value) AS std FROM ev GROUP BY action)
SELECT action, n, round(mean, 9) AS mean, min, max, round(std, 9) AS std, v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99 FROM s"""


@query(LATENCY_SQL)
def ag34_latency_stats(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.latency(behaviours(spark, d), "value", "action")
    return found.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(EV + ", s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM ev), m AS (SELECT v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99, CAST(n AS DOUBLE) AS n FROM s) SELECT 'p50' AS metric, 50.0::DOUBLE AS target, p50 AS actual, p50 <= 50 AS passed FROM m UNION ALL SELECT 'p99', 200.0, p99, p99 <= 200 FROM m UNION ALL SELECT 'n', 100.0, n, n >= 100 FROM m")
def ag35_sla(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sla(statistics.latency(behaviours(spark, d), "value"), {"p50": ("le", 50), "p99": ("le", 200), "n": ("ge", 100)})


@query(EV + "SELECT user_id, action, count(*) AS n, round(avg(value), 9) AS avg_value FROM ev GROUP BY user_id, action")
def ag36_user_action(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("avg_value"))


@query(EV + "SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS users FROM ev WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 24 HOUR GROUP BY item_id ORDER BY n DESC, item_id LIMIT 100")
def ag37_popular_last_day(spark: SparkSession, d: str) -> DataFrame:
    recent = statistics.since(behaviours(spark, d), "24 HOURS").groupBy("item_id")
    return recent.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("n"), "item_id").limit(100)


@query(EV + "SELECT p_partkey AS item_id, p_brand AS category, CAST(count(*) FILTER (action = 'view') + 2 * count(*) FILTER (action = 'click') + 3 * count(*) FILTER (action = 'like') AS DOUBLE) AS score FROM part LEFT JOIN ev ON item_id = p_partkey WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY ALL ORDER BY score DESC, item_id LIMIT 20")
def ag38_popular_by_category(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d).groupBy("item_id").agg(statistics.n_of("view").alias("v"), statistics.n_of("click").alias("c"), statistics.n_of("like").alias("l"))
    items = table(spark, d, "part").filter(F.col("p_brand").isin("Brand#2", "Brand#17")).select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"))
    return statistics.scored(items.join(ev, "item_id", "left"), {"v": 1.0, "c": 2.0, "l": 3.0}).select("item_id", "category", "score").orderBy(F.desc("score"), "item_id").limit(20)


@query(EV + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users, CASE WHEN count(*) FILTER (action = 'view') > 0 THEN count(*) FILTER (action = 'click') / count(*) FILTER (action = 'view') ELSE 0.0 END AS ctr, round(avg(value), 9) AS avg_value FROM ev GROUP BY 1")
def ag39_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    grouped = behaviours(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return grouped.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), statistics.ratio(statistics.n_of("click"), statistics.n_of("view")).alias("ctr"), F.round(F.avg("value"), 9).alias("avg_value")
    )


@query(EV + "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1")
def ag39_hour_distribution(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS segment, CAST(floor(c_acctbal / 2000) AS INTEGER) AS band, count(*) AS n FROM customer GROUP BY 1, 2")
def ag39_segment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 2000).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (action = 'signup') AS signup, count(*) FILTER (action = 'purchase') AS purchase, count(*) FILTER (action = 'view') AS view FROM ev GROUP BY 1")
def ag39_growth_pivot(spark: SparkSession, d: str) -> DataFrame:
    days = behaviours(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.pivot("action", ["signup", "purchase", "view"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM events) AS events,
(SELECT count(DISTINCT user_id) FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS active_users""")
def ag39_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    daily = ev.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    last = daily.agg(F.sum("n").alias("events"), F.max_by("users", "day").alias("active_users"))
    rows = (table(spark, d, t).agg(F.count(F.lit(1)).alias(c)) for t, c in (("customer", "users"), ("part", "items")))
    return next(rows).join(next(rows)).join(last)  # single rows


@query(EV + """, f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM ev GROUP BY user_id), a AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS active FROM ev GROUP BY 1), n AS (SELECT day, count(*) AS fresh FROM f GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, active, coalesce(fresh, 0) AS fresh, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY day) AS BIGINT) AS total FROM a LEFT JOIN n USING (day)""")
def ag39_user_trend(spark: SparkSession, d: str) -> DataFrame:
    """Active and first-seen users of each day, and all users so far."""
    days = behaviours(spark, d).select("user_id", F.to_date("ts").alias("day")).distinct()
    first = days.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("fresh"))
    daily = days.groupBy("day").agg(F.count(F.lit(1)).alias("active")).join(first, "day", "left").fillna(0, ["fresh"])
    so_far = F.sum("fresh").over(Window.orderBy("day"))  # a row a day
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "active", "fresh", so_far.alias("total"))


@query(EV + """SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, max(value) AS worst FROM ev GROUP BY 1""")
def ag39_latency_trend(spark: SparkSession, d: str) -> DataFrame:
    grouped = behaviours(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    points = (F.round(F.percentile("value", q), 9).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return grouped.agg(F.round(F.avg("value"), 9).alias("mean"), *points, F.max("value").alias("worst"))


@query("""SELECT p_type AS category, count(DISTINCT l_orderkey) AS orders, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 9) AS share
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type ORDER BY revenue DESC, category LIMIT 10""")
def ag39_top_categories(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    per = sold.groupBy(F.col("p_type").alias("category")).agg(F.count_distinct("l_orderkey").alias("orders"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("r"))
    total = per.agg(F.sum("r").alias("t"))
    found = per.join(F.broadcast(total)).select("category", "orders", "quantity", F.round("r", 2).alias("revenue"), F.round(F.col("r") / F.col("t"), 9).alias("share"))  # one row
    return found.orderBy(F.desc("revenue"), "category").limit(10)


@query(EV + """SELECT item_id, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (action = 'purchase') AS purchases FROM ev GROUP BY item_id ORDER BY events DESC, item_id LIMIT 10""")
def ag39_top_items(spark: SparkSession, d: str) -> DataFrame:
    per = behaviours(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), statistics.n_of("purchase").alias("purchases"))
    return per.orderBy(F.desc("events"), "item_id").limit(10)


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders GROUP BY 1, 2")
def ag39_status_distribution(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("status")), 9))  # a row for each pair


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS users, count(*) FILTER (c_acctbal < 0) AS overdrawn, GROUPING(n_name) AS whole FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY GROUPING SETS ((r_name, n_name), (r_name))""")
def ag39_region_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Users of each nation, and of each region as a whole."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    users = table(spark, d, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "c_acctbal")
    sets = users.groupingSets([["region", "nation"], ["region"]], "region", "nation")
    return sets.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"), F.grouping("nation").cast("long").alias("whole"))


@query("SELECT p_brand AS brand, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2")
def ag39_type_distribution(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@query(EV + "SELECT action, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY ROLLUP (action, CAST(ts AS DATE))")
def ag08_rollup(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).withColumn("day", F.to_date("ts")).rollup("action", "day").agg(F.count(F.lit(1)).alias("n"))


# ---- windows


@query(EV + ", u AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT user_id, n / max(n) OVER () AS score FROM u")
def wn06_max_normalised(spark: SparkSession, d: str) -> DataFrame:
    u = behaviours(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return u.join(F.broadcast(u.agg(F.max("n").alias("m")))).select("user_id", (F.col("n") / F.col("m")).alias("score"))


@query("SELECT p_partkey, p_brand, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def wn08_rank_per_group(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_per(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3).drop("p_retailprice")


@query(EV + ", i AS (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id ORDER BY n DESC, item_id LIMIT 50) SELECT item_id, CAST(row_number() OVER (ORDER BY n DESC, item_id) AS INTEGER) AS rank, round(1.0 - 0.01 * (row_number() OVER (ORDER BY n DESC, item_id) - 1), 6)::DOUBLE AS score FROM i")
def wn09_positional_score(spark: SparkSession, d: str) -> DataFrame:
    i = behaviours(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return recommend.popular(i, [F.desc("n"), F.col("item_id")], 50).select("item_id", "rank", F.round("score", 6).alias("score"))


@query(EV + ", u AS (SELECT user_id, action, count(*) AS n FROM ev GROUP BY user_id, action) SELECT user_id, action, n, n / sum(n) OVER (PARTITION BY user_id) AS share FROM u")
def wn11_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return statistics.share_of_total(behaviours(spark, d).groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n")), "n", "user_id")


@query(EV + """, c AS (SELECT user_id, item_id, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
u AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS upto, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS r FROM p)
SELECT user_id, item_id FROM u WHERE upto * 10 <= total * 3 OR r = 1""")
def wn12_nucleus(spark: SparkSession, d: str) -> DataFrame:
    """The most probable items up to three tenths of the mass; the first in any case."""
    c = behaviours(spark, d).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "item_id")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = c.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy("user_id")), "r": F.row_number().over(order)})
    return marked.filter("upto * 10 <= total * 3 OR r = 1").select("user_id", "item_id")


@query(EV + ", c AS (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k FROM c) SELECT round(sum((2 * i - k - 1) * n) / (any_value(k) * sum(n)), 9) AS gini FROM r")
def wn13_gini(spark: SparkSession, d: str) -> DataFrame:
    c = behaviours(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return statistics.gini(c, "n").select(F.round("gini", 9).alias("gini"))


@query(EV + ", h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM ev GROUP BY 1) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, n, n / lag(n) OVER (ORDER BY hour) AS ratio FROM h")
def wn14_period_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each hour against the one before that has events; an hour belongs to one row, so the window is as long as the time covered."""
    h = behaviours(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("ratio", F.col("n") / F.lag("n").over(Window.orderBy("hour")))


# ---- joins


@query(EV + "SELECT event_id, coalesce(p_brand, 'none') AS semantic FROM ev LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 20) ON p_partkey = item_id")
def jo01_left_mapping(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("semantic"))
    return behaviours(spark, d).join(mapping, "item_id", "left").select("event_id", F.coalesce("semantic", F.lit("none")).alias("semantic"))


@query(EV + "SELECT p_brand, count(*) AS n, count(DISTINCT user_id) AS users FROM ev JOIN part ON p_partkey = item_id GROUP BY p_brand")
def jo04_inner_join_agg(spark: SparkSession, d: str) -> DataFrame:
    joined = behaviours(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_brand"), "item_id")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT p_partkey, p_name, coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey ORDER BY quantity DESC, p_partkey LIMIT 50")
def jo05_popular_parts(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("quantity"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(sold, "p_partkey", "left").fillna(0.0).orderBy(F.desc("quantity"), "p_partkey").limit(50)


ANTI_SQL = """WITH pop AS (SELECT l_partkey AS item_id, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey), ranked AS (SELECT item_id, row_number() OVER (ORDER BY q DESC, item_id) AS rank FROM pop ORDER BY rank LIMIT 200),
done AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)
SELECT c_custkey AS user_id, r.item_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY r.rank) AS INTEGER) AS rank FROM customer, ranked r ANTI JOIN done d ON d.user_id = c_custkey AND d.item_id = r.item_id
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY r.rank) <= 10"""


@query(ANTI_SQL)
def jo06_candidates_anti(spark: SparkSession, d: str) -> DataFrame:
    bought = purchases(spark, d)
    ranked = recommend.popular(bought.groupBy("item_id").agg(F.sum("quantity").alias("q")), [F.desc("q"), F.col("item_id")], 200)
    as_of = table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))
    recent = statistics.since(bought, "30 DAYS", as_of=as_of)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.popular_for_users(users, recent, ranked, 10)


@query("SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 48 EXCEPT SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 30")
def jo07_exposure_anti(spark: SparkSession, d: str) -> DataFrame:
    bought = purchases(spark, d)
    exposed = bought.filter("quantity < 30").select("user_id", "item_id")
    return recommend.not_interacted(bought.filter("quantity > 48").select("user_id", "item_id").distinct(), exposed, None)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def jo08_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return validate.semi(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(EV + "SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = item_id AND p_size <= 25)")
def jo09_orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("item_id"))
    return behaviours(spark, d).join(parents, "item_id", "left_anti").select("event_id")


@query(EV + "SELECT l.event_id, arg_max(h.value, (h.ts, h.event_id)) AS feature FROM ev l LEFT JOIN ev h ON h.user_id = l.user_id AND h.action = 'view' AND h.ts <= l.ts WHERE l.action = 'purchase' GROUP BY l.event_id")
def jo10_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    labels = ev.filter("action = 'purchase'").select("event_id", "user_id", "ts")
    history = ev.filter("action = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("feature"))
    found = recommend.as_of_join(labels, statistics.latest_per(history, "user_id", "ts"), "user_id", "ts", ["feature"])
    return found.select("event_id", "feature")


CO_SQL = EV + """, per AS (SELECT user_id, item_id, sum(CASE action WHEN 'purchase' THEN 5.0 WHEN 'buy' THEN 5.0 WHEN 'like' THEN 3.0 ELSE 1.0 END) AS w FROM ev WHERE action IN ('click', 'like', 'buy', 'purchase') GROUP BY ALL),
pairs AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS users, sum(b.w) AS w FROM per a JOIN per b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL HAVING count(*) >= 3)
SELECT item_a, item_b, users, CAST(w / max(w) OVER (PARTITION BY item_a) AS DOUBLE) AS score FROM pairs"""


@query(CO_SQL)
def jo11_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return recommend.cooccurrence(behaviours(spark, d))


@query(CO_SQL + " QUALIFY row_number() OVER (PARTITION BY item_a ORDER BY w DESC, item_b) <= 20")
def rc02_similar_by_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_per(recommend.cooccurrence(behaviours(spark, d)), "item_a", [F.desc("score"), F.col("item_b")], 20).drop("rank")


@query(EV + "SELECT e.event_id, p_name AS title, p_brand AS category FROM ev e LEFT JOIN part ON p_partkey = item_id WHERE action = 'purchase'")
def jo13_enrich(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"))
    return behaviours(spark, d).filter("action = 'purchase'").join(items, "item_id", "left").select("event_id", "title", "category")


@query("""WITH c AS (SELECT o_custkey AS user_id, p_brand AS category, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT user_id, category, n / sum(n) OVER (PARTITION BY user_id) AS share, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def jo15_top_shares(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"))
    counts = purchases(spark, d).join(items, "item_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return statistics.top_per(statistics.share_of_total(counts, "n", "user_id"), "user_id", [F.desc("n"), F.col("category")], 5).drop("n")


# ---- sorts and sets


@query(EV + ", s AS (SELECT user_id, item_id, sum(value) AS v FROM ev GROUP BY ALL) SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(v, 4) DESC, item_id) AS INTEGER) AS position FROM s QUALIFY position <= 10")
def sl02_ranked_positions(spark: SparkSession, d: str) -> DataFrame:
    s = behaviours(spark, d).groupBy("user_id", "item_id").agg(F.sum("value").alias("v"))
    return statistics.top_per(s, "user_id", [F.desc(F.round("v", 4)), F.col("item_id")], 10).select("user_id", "item_id", F.col("rank").alias("position"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def sl03_category_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey").limit(25)


@query("SELECT p_partkey, q FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.09 GROUP BY l_partkey) ON l_partkey = p_partkey ORDER BY q DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 40")
def sl04_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").filter("l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    whole = table(spark, d, "part").join(sold, "p_partkey", "left")
    return whole.orderBy(F.desc_nulls_last("q"), F.desc_nulls_last("p_retailprice"), "p_partkey").select("p_partkey", "q").limit(40)


@query("SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def so03_distinct(spark: SparkSession, d: str) -> DataFrame:
    return purchases(spark, d).select("user_id", "item_id").distinct()


@query("SELECT l_suppkey AS person, l_partkey AS movie FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount < 0.01")
def so04_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    # one scan: a row of any of the three sources counts
    return lines.filter("l_quantity > 45 OR l_returnflag = 'R' OR l_discount < 0.01").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("movie")).distinct()


@query("SELECT DISTINCT unnest([CAST(json_extract_string(props, '$.k') AS INTEGER), CAST(user_id AS INTEGER)]) AS item_id FROM events")
def so08_distinct_unnest(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select(F.explode(F.array(F.col("item_id"), F.col("user_id").cast("int"))).alias("item_id")).distinct()


MERGE_SQL = EV + """, a AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS score FROM ev WHERE action = 'purchase' GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS score FROM ev WHERE action = 'click' GROUP BY ALL HAVING count(*) >= 2),
u AS (SELECT *, 0 AS priority, 'bought' AS source FROM a UNION ALL SELECT *, 1, 'clicked' FROM b),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority, score DESC, item_id) <= 8)
SELECT user_id, item_id, source, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, priority, item_id) AS INTEGER) AS position FROM f"""


@query(MERGE_SQL)
def so09_candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)

    def recall(action: str) -> DataFrame:
        return ev.filter(F.col("action") == action).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score")).filter("score >= 2")

    return recommend.merged([("bought", recall("purchase")), ("clicked", recall("click"))], 8)


# ---- recommendation


@query(ANTI_SQL.replace("LIMIT 200", "LIMIT 400").replace("FROM lineitem GROUP BY l_partkey)", "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY l_partkey)"))
def rc01_candidates(spark: SparkSession, d: str) -> DataFrame:
    bought = purchases(spark, d)
    active = validate.optional_filter(table(spark, d, "part"), p_type="ECONOMY", p_brand=None).select(F.col("p_partkey").alias("item_id"))
    totals = bought.join(active, "item_id").groupBy("item_id").agg(F.sum("quantity").alias("q"))
    ranked = recommend.popular(totals, [F.desc("q"), F.col("item_id")], 400)
    as_of = table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.popular_for_users(users, statistics.since(bought, "30 DAYS", as_of=as_of), ranked, 10)


@query(EV + "SELECT c_custkey AS user_id, coalesce(n, 0) AS n, coalesce(n, 0) < 100 AS is_cold FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) ON user_id = c_custkey")
def rc04_cold_start_gate(spark: SparkSession, d: str) -> DataFrame:
    counts = behaviours(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(counts, "user_id", "left").fillna(0, ["n"])
    return recommend.gate(users, 100)


@query("SELECT c_custkey, CASE WHEN a > 0 AND a < 18 THEN 'comics,games,study' WHEN a >= 18 AND a < 25 THEN 'tech,games,fun,fashion' WHEN a >= 25 AND a < 35 THEN 'business,tech,life,money' WHEN a >= 35 AND a < 50 THEN 'business,news,health,family' WHEN a >= 50 THEN 'health,news,culture,wellness' ELSE 'news' END AS categories FROM (SELECT c_custkey, c_custkey % 80 AS a FROM customer)")
def rc05_demographic_fallback(spark: SparkSession, d: str) -> DataFrame:
    bands = [(18, ["comics", "games", "study"]), (25, ["tech", "games", "fun", "fashion"]), (35, ["business", "tech", "life", "money"]), (50, ["business", "news", "health", "family"]), (1 << 30, ["health", "news", "culture", "wellness"])]
    found = recommend.age_categories(F.col("c_custkey") % 80, bands, ["news"])
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, ",").alias("categories"))


@query(MERGE_SQL.replace("HAVING count(*) >= 2", "HAVING count(*) >= 1").replace("<= 8)", "<= 20)"))
def rc06_multi_source_fill(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    recalls = [(n, ev.filter(F.col("action") == a).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score"))) for n, a in (("bought", "purchase"), ("clicked", "click"))]
    return recommend.merged(recalls, 20)


@query(EV + """, own AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS s FROM ev WHERE action = 'click' GROUP BY ALL), bought AS (SELECT DISTINCT user_id, item_id FROM ev WHERE action = 'purchase'),
top AS (SELECT user_id, item_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS position FROM own ANTI JOIN bought USING (user_id, item_id))
SELECT user_id, item_id, p_name AS title, CAST(position AS INTEGER) AS position FROM top LEFT JOIN part ON p_partkey = item_id WHERE position <= 10""")
def rc07_recommend(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    own = ev.filter("action = 'click'").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score"))
    fresh = recommend.not_interacted(own, ev, ("purchase",))
    lists = recommend.merged([("clicked", fresh)], 10)
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return lists.join(items, "item_id", "left").select("user_id", "item_id", "title", "position")


@query(EV + "SELECT action, CASE action WHEN 'view' THEN 0.1 WHEN 'click' THEN 1.0 ELSE 0.0 END::DOUBLE AS sequence_weight, CASE action WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END::DOUBLE AS preference_weight FROM ev GROUP BY action")
def rc08_action_weights(spark: SparkSession, d: str) -> DataFrame:
    from strandline.functions import tokens

    a = behaviours(spark, d).select("action").distinct()
    return a.select("action", tokens.weight(F.col("action"), tokens.SEQUENCE_WEIGHTS, 0.0).alias("sequence_weight"), tokens.weight(F.col("action"), tokens.PREFERENCE_WEIGHTS, 1.0).alias("preference_weight"))


@query(EV + "SELECT user_id, item_id, count(*) AS n, arg_max(action, (ts, event_id)) AS last_action, max(seconds) AS last_seconds FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY ALL")
def rc09_cross_features(spark: SparkSession, d: str) -> DataFrame:
    return profiles.cross_features(behaviours(spark, d))


@query(EV + "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend, 'unknown' AS device FROM ev WHERE action = 'view'")
def rc10_context_features(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.time_features(behaviours(spark, d).filter("action = 'view'"))
    return found.select("event_id", "hour", "day_of_week", "is_weekend", F.lit("unknown").alias("device"))


@query("SELECT c_custkey, '1,' || (CASE WHEN a = 0 THEN '' ELSE (1000 + CASE WHEN a < 18 THEN 0 WHEN a < 26 THEN 1 WHEN a < 36 THEN 2 WHEN a < 46 THEN 3 WHEN a < 56 THEN 4 ELSE 5 END) || ',' END) || '2001,2' AS token_ids FROM (SELECT c_custkey, c_custkey % 80 AS a FROM customer)")
def rc11_feature_tokens(spark: SparkSession, d: str) -> DataFrame:
    from strandline.functions import tokens

    age = F.col("c_custkey") % 80
    ids = F.array_compact(F.array(F.lit(1).cast("long"), F.when(age > 0, tokens.service_age(age)), tokens.service_hour(F.lit(9)), F.lit(2).cast("long")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("token_ids"))
