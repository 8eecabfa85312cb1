"""Queries on sources and sinks: each writes rows to the shared folder in one form and reads them back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators import validate
from strandline.plans.behaviour import TYPES, event_tokens
from strandline.plans.registry import query
from strandline.sources import features, files, kafka, ranges, views
from strandline.sources.tables import BEHAVIOURS_SQL as EV
from strandline.sources.tables import behaviours, table
from strandline.streaming import ingest, sketches, stateful, windows

EVENT = "event_id long, user_id long, item_id int, action string, seconds long, value double"
ROUND_TRIP = EV + "SELECT event_id, user_id, item_id, action, seconds, value FROM ev"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select("event_id", "user_id", "item_id", "action", "seconds", "value")


def _round_trip(spark: SparkSession, d: str, kind: str) -> DataFrame:
    path = files.scratch(spark)
    files.write(_events(spark, d), path, kind)
    return files.read(spark, path, kind, EVENT)


@query(ROUND_TRIP)
def sc01_json(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "json")


@query(ROUND_TRIP)
def sc02_parquet(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "parquet")


@query(ROUND_TRIP)
def sc03_csv(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "csv")


@query("SELECT 'unknown format tfrecord; there are parquet, json, jsonl, csv, tsv' AS message")
def sc04_unknown_format(spark: SparkSession, d: str) -> DataFrame:
    try:
        files.read(spark, d, "tfrecord")
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "message string")
    raise AssertionError("an unknown format was read")


@query(ROUND_TRIP)
def sc05_overwrite(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write(_events(spark, d).filter("action = 'view'"), path, "parquet")
    files.write(_events(spark, d), path, "parquet")
    return files.read(spark, path, "parquet", EVENT)


@query(EV + "SELECT 'ACTION_' || action AS token, count(*) AS n FROM ev GROUP BY 1")
def sc06_vocab_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    counts = event_tokens(behaviours(spark, d)).filter("token LIKE 'ACTION%'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    files.write(counts, path, "csv")
    return files.read(spark, path, "csv", "token string, n long")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part")
def sc07_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write(table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")), path, "tsv")
    return files.read(spark, path, "tsv", "p_partkey long, p_name string, p_size int")


@query("SELECT count(*) AS n FROM (SELECT * FROM part LIMIT 1000)")
def sc08_gzip_head(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    table(spark, d, "part").write.option("compression", "gzip").option("sep", "\t").option("header", "true").csv(path)
    return files.read(spark, path, "tsv", rows=1000).agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT event_id, action FROM ev WHERE event_id % 5 <> 0")
def sc09_malformed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that aren't JSON are passed over."""
    path = files.scratch(spark)
    line = F.when(F.col("event_id") % 5 == 0, '{"event_id": 1, broken').otherwise(F.to_json(F.struct("event_id", "action")))
    behaviours(spark, d).select(line.alias("value")).write.text(path)
    return files.read(spark, path, "jsonl", "event_id long, action string", malformed="DROPMALFORMED")


@query(EV + "SELECT user_id, count(*) AS n FROM ev GROUP BY user_id")
def sc10_sample_files(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    nested = behaviours(spark, d).groupBy("user_id").agg(F.collect_list(F.struct("event_id", "item_id")).alias("events"))
    files.write(nested, path, "jsonl")
    back = files.read(spark, path, "jsonl", "user_id long, events array<struct<event_id:long,item_id:int>>")
    return back.select("user_id", F.size("events").cast("long").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def sc11_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of all readers together are the table."""
    ev = _events(spark, d)
    whole = files.shuffled_files(ev, 0, 3).unionByName(files.shuffled_files(ev, 1, 3)).unionByName(files.shuffled_files(ev, 2, 3))
    return whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def sc14_messages(spark: SparkSession, d: str) -> DataFrame:
    return kafka.deserialised(kafka.serialised(table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", "value"))).select("event_id", "user_id", "event_type", "value")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id")
def sc13_keyed_messages(spark: SparkSession, d: str) -> DataFrame:
    return kafka.serialised(table(spark, d, "events").select("event_id", "event_type", "user_id")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def sc16_extract_range(spark: SparkSession, d: str) -> DataFrame:
    start, end = (F.expr(f"TIMESTAMP_NTZ'{y}-01-01 00:00:00'") for y in (1995, 1996))
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)).select("o_orderkey", "o_totalprice")


@query(EV + "SELECT count(*) FILTER (action <> 'error') AS loaded, count(*) FILTER (action = 'error') AS failed FROM ev")
def sc17_load_counts(spark: SparkSession, d: str) -> DataFrame:
    return files.load_counts(behaviours(spark, d), F.size(validate.failures(validate.event_rules(types=TYPES))) == 0)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("action").alias("feature"), "value", "ts")


@query("SELECT feature, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max FROM (SELECT event_type AS feature, value FROM events WHERE event_type IN ('view', 'click')) GROUP BY feature")
def sc18_offline_features(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    features.write_features(_features(spark, d), path)
    found = features.statistics(features.read_features(spark, path, "user", ["view", "click"]))
    return found.select("feature", "n", F.round("mean", 9).alias("mean"), "min", "max")


@query("SELECT user_id AS entity_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def sc19_online_features(spark: SparkSession, d: str) -> DataFrame:
    return features.online(_features(spark, d)).select("entity_id", F.size("features").cast("long").alias("n"))


@query("SELECT count(DISTINCT user_id) AS synced FROM events")
def sc20_feature_sync(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    features.write_features(_features(spark, d), f"{path}/offline")
    return spark.createDataFrame([(features.sync(spark, f"{path}/offline", f"{path}/online", "user"),)], "synced long")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def sc21_monthly_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Only the folders of one year are read back."""
    path = files.scratch(spark)
    files.write_monthly(table(spark, d, "orders"), path, "o_orderdate")
    return spark.read.parquet(path).filter("year = 1996").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(EV + "SELECT item_id, count(*) AS n FROM ev GROUP BY item_id")
def sc22_materialised_view(spark: SparkSession, d: str) -> DataFrame:
    return files.stage(spark, files.scratch(spark), lambda: behaviours(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))


@query(EV + "SELECT event_id, user_id, item_id, action, seconds, value FROM ev WHERE seconds >= 1704600000 AND seconds < 1705000000")
def sc16_data_source(spark: SparkSession, d: str) -> DataFrame:
    """A time range through the data source, which opens the days that overlap it and no others."""
    path = files.scratch(spark)
    ranges.land(_events(spark, d), path)
    return ranges.read(spark, path, start=1704600000).filter("seconds < 1705000000")


@query(EV + """SELECT CAST(seconds // 86400 AS INTEGER) AS day, action, count(*) AS n, round(sum(value), 6) AS value FROM ev
WHERE NOT (event_id % 5 < 4 AND event_id % 3 = 0) GROUP BY ALL""")
def sc22_incremental_view(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums kept up over five batches: each inserts a fifth of the events and deletes a third of those of the batch before."""
    ev = behaviours(spark, d).withColumn("day", F.floor(F.col("seconds") / 86400).cast("int"))
    view = views.SumView(spark, files.scratch(spark), ["day", "action"], {"value": "value"})
    for k in range(5):
        fresh = ev.filter(F.col("event_id") % 5 == k).withColumn(views.OP, F.lit(1))
        gone = ev.filter((F.col("event_id") % 5 == k - 1) & (F.col("event_id") % 3 == 0)).withColumn(views.OP, F.lit(-1))
        view.apply(fresh.unionByName(gone), k + 1)
    return view.read().withColumn("value", F.round("value", 6))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT -1, 'new'")
def sc23_json_upsert(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.lit(0).alias("version"))
    changed = parts.filter("p_partkey % 10 = 0").select("p_partkey").unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS p_partkey"))
    each = changed.select(F.col("p_partkey"), F.explode(F.array(F.struct(F.lit("old").alias("p_name"), F.lit(1).alias("version")), F.struct(F.lit("new").alias("p_name"), F.lit(2).alias("version")))).alias("c"))
    payload = each.groupBy(F.col("p_partkey") % 4).agg(F.to_json(F.collect_list(F.struct("p_partkey", "c.p_name", "c.version"))).alias("j"))
    return files.upsert_json(parts, payload, "j", "struct<p_partkey:long,p_name:string,version:int>", ["p_partkey"]).select("p_partkey", "p_name")


@query(EV + "SELECT item_id, 2 * count(*) + count(*) FILTER (action = 'click') AS n FROM ev GROUP BY item_id")
def sc24_counter_upsert(spark: SparkSession, d: str) -> DataFrame:
    ev = behaviours(spark, d)
    counters = ev.groupBy("item_id").agg((F.count(F.lit(1)) * 2).alias("n"))
    return files.increment(counters, ev.filter("action = 'click'").select("item_id", F.lit(1).cast("long").alias("n")), ["item_id"], "n")


@query("SELECT vec_id, label + CASE WHEN vec_id < 50 THEN 100 ELSE 0 END AS label FROM embeddings")
def sc25_row_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    changes = e.filter("vec_id < 50").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    return files.upsert(e, changes, ["vec_id"]).select("vec_id", "label")


@query("SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings")
def sc26_vector_append(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    e = table(spark, d, "embeddings")
    files.write(e.filter("vec_id < 100"), path, "parquet", mode="append")
    files.write(e.filter("vec_id >= 100"), path, "parquet", mode="append")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("numbers"))


@query("SELECT 'MOV_' || vec_id AS token, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id > 0")
def sc27_export_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as TSV lines, without the padding row."""
    path = files.scratch(spark)
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("string")), "\t")
    rows = table(spark, d, "embeddings").filter("vec_id > 0").select(F.concat_ws("\t", F.concat(F.lit("MOV_"), F.col("vec_id").cast("string")), shown).alias("value"))
    rows.write.text(path)
    back = F.split("value", "\t")
    return spark.read.text(path).select(F.get(back, F.lit(0)).alias("token"), (F.size(back) - 1).alias("dims"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')")
def sc28_browse_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write(table(spark, d, "part").filter(F.col("p_name").contains("red")).select("p_partkey", "p_name"), path, "csv")
    return files.read(spark, path, "csv", "p_partkey long, p_name string")


@query("SELECT count(*) AS rows, 1::BIGINT AS made FROM part")
def sc29_result_cache(spark: SparkSession, d: str) -> DataFrame:
    """The second reader finds what the first one made."""
    path, made = files.scratch(spark), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, d, "part")

    files.stage(spark, path, make)
    return files.stage(spark, path, make).agg(F.count(F.lit(1)).alias("rows")).withColumn("made", F.lit(len(made)).cast("long"))


@query(EV + "SELECT action, count(*) AS n FROM ev WHERE action IN ('view', 'click') GROUP BY action")
def sc30_resumed_stages(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    parts = [files.stage(spark, f"{path}/{a}", lambda a=a: behaviours(spark, d).filter(F.col("action") == a).select("action")) for a in ("view", "click", "view")]
    return parts[2].unionByName(parts[1]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS ids")
def sc31_generated(spark: SparkSession, d: str) -> DataFrame:
    return files.generated(spark, 5000).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def sc32_retention(spark: SparkSession, d: str) -> DataFrame:
    return files.retained(behaviours(spark, d), 7).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id * 60 >= 6000")
def sc33_vector_expiry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("ts", F.col("vec_id") * 60).filter("ts >= 6000").select("vec_id")


# ---- streams over files


def _landed(spark: SparkSession, d: str) -> str:
    path = files.scratch(spark)
    behaviours(spark, d).repartition(4, "event_id").write.parquet(path)
    return path


STREAM = "event_id long, user_id long, item_id int, action string, ts timestamp_ntz, seconds long, value double"


@query(EV + "SELECT event_id, action FROM ev WHERE action <> 'error'")
def st01_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A file stream read to its end in small batches; rows that break a rule go to the dead letters."""
    path = files.scratch(spark)
    stream = ingest.files(spark, _landed(spark, d), STREAM, "parquet", 2)
    ingest.start_ingest(stream, validate.event_rules(types=TYPES), f"{path}/good", f"{path}/dead", f"{path}/offsets").awaitTermination()
    return spark.read.parquet(f"{path}/good").select("event_id", "action")


@query(EV + "SELECT event_id, 'event_type' AS errors FROM ev WHERE action = 'error'")
def st02_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    stream = ingest.files(spark, _landed(spark, d), STREAM, "parquet", 2)
    ingest.start_ingest(stream, validate.event_rules(types=TYPES), f"{path}/good", f"{path}/dead", f"{path}/offsets").awaitTermination()
    return spark.read.parquet(f"{path}/dead").select("event_id", F.array_join("errors", ",").alias("errors"))


@query(EV + "SELECT action, seconds // 86400 * 86400 AS start, count(*) AS n FROM ev GROUP BY ALL")
def st03_stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windows, complete at its end, are those of the batch."""
    path = files.scratch(spark)
    stream = ingest.files(spark, _landed(spark, d), STREAM, "parquet", 2)
    found = windows.rates(stream, "action", length="1 day", late="60 days").select("action", "start", "n")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/state")

    found.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/state")


@query(EV + "SELECT event_id FROM ev")
def st12_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event lands twice and comes out once."""
    path, landed = files.scratch(spark), files.scratch(spark)
    ev = behaviours(spark, d).withColumn("ts", F.expr(f"timestampadd(SECOND, seconds, {times.EPOCH})").cast("timestamp"))
    ev.unionByName(ev).write.parquet(landed)
    stream = spark.readStream.schema(STREAM.replace("timestamp_ntz", "timestamp")).parquet(landed)
    once = ingest.once_each(stream, late="60 days").select("event_id")
    once.writeStream.format("parquet").option("path", f"{path}/once").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/once").select("event_id")


ORDERED = "event_id long, user_id long, action string, ts timestamp"


def _in_parts(spark: SparkSession, d: str, parts: int = 4) -> Iterator[DataFrame]:
    """Streams over one folder into which events land in time order, a part before each is asked for; last come rows that only move the watermark on.

    Until the last is done, queries deal their state to partitions by the rows of a part.
    """
    landed = files.scratch(spark)
    ev = behaviours(spark, d).select("event_id", "user_id", "action", F.col("ts").cast("timestamp").alias("ts"), "seconds")
    low, high, rows = ev.agg(F.min("seconds"), F.max("seconds"), F.count(F.lit(1))).first()
    with stateful.with_partitions(spark, rows // parts):
        for k in range(parts + 1):
            if k < parts:
                part = ev.filter((F.col("seconds") - low) * parts >= k * (high - low + 1)).filter((F.col("seconds") - low) * parts < (k + 1) * (high - low + 1)).drop("seconds")
            else:  # a user of no events, and the click before the exposure
                part = spark.createDataFrame([(-1, -1, "click", high + 30 * 86400), (-2, -1, "view", high + 30 * 86400 + 1)], "event_id long, user_id long, action string, s long")
                part = part.select("event_id", "user_id", "action", F.timestamp_seconds("s").alias("ts"))
            part.write.mode("append").parquet(landed)
            yield spark.readStream.schema(ORDERED).parquet(landed)


@query(EV + """SELECT e.user_id, e.event_id AS exposure_id, c.event_id AS click_id FROM (SELECT * FROM ev WHERE action = 'view') e
LEFT JOIN (SELECT * FROM ev WHERE action = 'click') c ON c.user_id = e.user_id AND c.ts >= e.ts AND c.ts < e.ts + INTERVAL 30 MINUTE""")
def st12_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Exposures and clicks as two streams, started again from the checkpoint for each part that lands."""
    path = files.scratch(spark)
    for stream in _in_parts(spark, d):
        joined = stateful.attributed(stream.filter("action = 'view'"), stream.filter("action = 'click'"), ["user_id"])
        stateful.to_files(joined, path).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("user_id", "exposure_id", "click_id")


@query(EV + """, f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, session""")
def st12_timed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sessions, each closed by its timer in a stream over several batches."""
    path = files.scratch(spark)
    with stateful.with_rocksdb(spark):
        for stream in _in_parts(spark, d):
            stateful.to_files(stateful.numbered_sessions(stream), path).awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query(EV + """SELECT seconds // 86400 * 86400 AS start, count(*) AS n, true AS distinct_near, true AS median_near, true AS tail_near FROM ev GROUP BY ALL""")
def st07_merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Days read from the sketches of hours: whether the users are within 3 % and the ranks of quantiles within 1 % (and one row) of the exact ones."""
    ev, path = behaviours(spark, d), files.scratch(spark)
    sketches.sketched(ev, "value", "user_id").write.parquet(path)
    days = sketches.report(sketches.merged(spark.read.parquet(path), 86400))
    dated = ev.withColumn("start", F.col("seconds") - F.pmod("seconds", F.lit(86400)))
    ranks = (F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"r{p}") for p in ("p50", "p95"))
    exact = dated.join(days.select("start", "p50", "p95"), "start").groupBy("start").agg(F.count_distinct("user_id").alias("users"), *ranks)

    def near(rank: str, q: float) -> Column:
        return F.abs(F.col(rank) - q) <= 0.01 + 1 / F.col("n")

    found = days.select("start", "n", "distinct").join(exact, "start")
    return found.select("start", "n", (F.abs(F.col("distinct") - F.col("users")) <= 0.03 * F.col("users")).alias("distinct_near"), near("rp50", 0.5).alias("median_near"), near("rp95", 0.95).alias("tail_near"))
