"""Per-user sequences, sessions and samples of a behaviour log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays, times

GAP = 1800
#: Draws of negatives that are looked up in one task, and rows of a table that is sent to every task.
TASK_DRAWS, SENT_ROWS = 1 << 20, 1 << 18


def in_order(user: str = "user_id", *more: str):
    return Window.partitionBy(user, *more).orderBy("ts", "event_id")


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {"hour": F.hour(ts), "day_of_week": times.weekday_number(ts), "time_bucket": times.bucket(F.hour(ts)), "is_weekend": times.is_weekend(ts)}
    )


def user_sequences(df: DataFrame, most: int = 500, keep: str = "first", least: int = 1, fields: tuple[str, ...] = ("item_id", "action", "seconds")) -> DataFrame:
    """(user_id, events, seq_length, first_seconds, last_seconds), events by (ts, event_id), cut to the first or last `most`."""
    by_time = Window.partitionBy("user_id").orderBy(*(["ts", "event_id"] if keep == "first" else [F.desc("ts"), F.desc("event_id")]))
    cut = df.withColumn("_n", F.row_number().over(by_time)).filter(F.col("_n") <= most)
    event = F.struct("ts", "event_id", *(f for f in fields if f not in ("ts", "event_id")))
    grouped = cut.groupBy("user_id").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.count(F.lit(1)).alias("seq_length"),
        F.min("seconds").alias("first_seconds"),
        F.max("seconds").alias("last_seconds"),
    )
    return grouped.filter(F.col("seq_length") >= least)


def sessions(df: DataFrame, gap: int = GAP) -> DataFrame:
    """Adds `session`, from 0: a new one begins where more than `gap` seconds have passed."""
    w = in_order()
    fresh = F.coalesce((F.col("seconds") - F.lag("seconds").over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def deduplicated(df: DataFrame, key: str = "item_id", keep: str = "last") -> DataFrame:
    """One event for each user and key; events without a key go."""
    order = [F.desc("ts"), F.desc("event_id")] if keep == "last" else ["ts", "event_id"]
    w = Window.partitionBy("user_id", key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_item_samples(df: DataFrame, history: int = 100) -> DataFrame:
    """Each event but a user's first, with up to `history` items before it in `history`."""
    w = in_order()
    before = F.collect_list("item_id").over(w.rowsBetween(-history, -1))
    return df.withColumns({"history": before, "_n": F.row_number().over(w)}).filter("_n > 1").drop("_n")


def session_samples(df: DataFrame, most: int = 5, gap: int = GAP) -> DataFrame:
    """(user_id, session, history, target_item): the first item of a session after those of up to `most` sessions before."""
    event = F.struct("ts", "event_id", "item_id")
    per = sessions(df, gap).groupBy("user_id", "session").agg(F.sort_array(F.collect_list(event)).alias("events"))
    before = F.flatten(F.collect_list("events").over(Window.partitionBy("user_id").orderBy("session").rowsBetween(-most, -1)))
    found = per.withColumn("history", before).filter("session > 0")
    return found.select("user_id", "session", F.transform("history", lambda e: e["item_id"]).alias("history"), F.get("events.item_id", F.lit(0)).alias("target_item"))


def sliding_samples(sequences: DataFrame, window: int = 100, stride: int = 50) -> DataFrame:
    """(user_id, start, end, input, target) for each window of each sequence."""
    return sequences.select("user_id", F.inline(arrays.sliding(F.col("events"), window, stride)))


def split_of(bucket: Column, train: float = 0.8, validate: float = 0.1, of: int = 10) -> Column:
    """train, val or test by a bucket from 0 to `of` - 1."""
    return F.when(bucket < train * of, "train").when(bucket < (train + validate) * of, "val").otherwise("test")


def by_hash(*keys: str, of: int = 10) -> Column:
    """A bucket that depends on the keys alone, however rows are partitioned."""
    return F.pmod(_digits(*keys), F.lit(of))


def _digits(*keys: Column | str) -> Column:
    """28 bits of the MD5 of the keys' texts, which any engine can repeat."""
    texts = ((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)
    return F.conv(F.left(F.md5(F.concat_ws("|", *texts)), F.lit(7)), 16, 10).cast("long")


def draw(*keys: Column | str, seed: int = 42) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return (_digits(F.lit(seed), *keys) + 0.5) / (1 << 28)


def draw_sql(*keys: str, seed: int = 42) -> str:
    """The same number in SQL; `keys` are expressions."""
    return f"(({digits_sql(str(seed), *keys)} + CAST(0.5 AS DOUBLE)) / 268435456)"


def digits_sql(*keys: str) -> str:
    """What `draw` and `picked` are made of, in SQL."""
    return f"CAST('0x' || left(md5(concat_ws('|', {', '.join(keys)})), 7) AS BIGINT)"


def picked_sql(*keys: str, seed: int = 42) -> str:
    """The place from 0 to 1 at which `picked` draws."""
    return f"(({digits_sql(str(seed), *keys)} + {digits_sql(repr('fine'), str(seed), *keys)} % 16777216 / CAST(16777216 AS DOUBLE)) / 268435456)"


def with_shares(pool: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows of a weight over 0, with `_from` and `_to`: stretches of 0 to 1, one after the other, as long as the weights' shares.

    Sums are taken in 64 blocks by hash of the key, whose own sums follow one another, so no window holds all rows.
    """
    cut = pool.filter(F.col(weight) > 0).withColumns({"_block": (_digits(key) % 64).cast("int"), "_w": F.col(weight).cast("double")})
    sums = cut.groupBy("_block").agg(F.sum("_w").alias("_sum")).withColumn("_total", F.sum("_sum").over(Window.partitionBy()))  # 64 rows
    before = F.sum("_sum").over(Window.orderBy("_block"))
    stretches = sums.select("_block", "_total", (before / F.col("_total")).alias("_end"))
    stretches = stretches.withColumn("_start", F.lag("_end", 1, 0.0).over(Window.orderBy("_block")))
    own = Window.partitionBy("_block").orderBy(_digits(key), key)
    inner = cut.join(F.broadcast(stretches), "_block").withColumn("_to", F.col("_start") + F.sum("_w").over(own) / F.col("_total"))
    # each stretch begins where the one before it ends, and the last of a block ends with the block
    last = F.lead("_to").over(own).isNull()
    ends = inner.withColumn("_from", F.coalesce(F.lag("_to").over(own), "_start")).withColumn("_to", F.when(last, F.col("_end")).otherwise(F.col("_to")))
    return ends.drop("_block", "_w", "_total", "_end", "_start")


def picked(draws: DataFrame, shares: DataFrame, *keys: Column | str, seed: int = 42) -> DataFrame:
    """Each row of `draws` with a row of `shares` (see `with_shares`), drawn in proportion to its share by a hash of `keys`.

    Draws and stretches meet in as many equal cells as there are shares, so a stretch is copied once more at most than
    the cells it covers.
    """
    cells = max(1, shares.count())
    at = (_digits(F.lit(seed), *keys) + _digits(F.lit("fine"), F.lit(seed), *keys) % (1 << 24) / (1 << 24)) / (1 << 28)
    spread = F.sequence(F.floor(F.col("_from") * cells), F.floor(F.col("_to") * cells))
    near = shares.withColumn("_cell", F.explode(spread))
    drawn = draws.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") * cells))
    return drawn.join(sent(near, cells), "_cell").filter((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to"))).drop("_cell", "_at", "_from", "_to")


def negatives(positives: DataFrame, pool: DataFrame, count: int = 4, weight: str | None = None, seed: int = 42, tries: int = 4) -> DataFrame:
    """(user_id, item_id, negative, rank): `count` items of the pool that a user never touched, for each of their positives.

    Items are drawn by a seeded hash, all alike or by `weight` (one of 0 is never drawn), `tries` times as many as
    needed; items of the user are anti-joined and the first `count` different ones stay. Where too few are left, the
    pool's items follow in a fixed order, so that a list is short only if the pool has no more items for the user.
    """
    own = pool.select(F.col("item_id").alias("negative"), (F.col(weight) if weight else F.lit(1)).alias("_weight")).filter("_weight > 0")
    # all of a user is in one partition, where draws are made and looked up; partitions by rows, since draws are many more than positives
    tasks = max(positives.sparkSession.sparkContext.defaultParallelism, -(-positives.count() * count * tries // TASK_DRAWS))
    wanted = positives.select("user_id", "item_id").repartition(tasks, "user_id").distinct()
    touched = wanted.select("user_id", F.col("item_id").alias("negative"))
    # a draw before the others stands for the positive itself, and tells in its user's partition what the user touched
    tried = wanted.withColumn("try", F.explode(F.sequence(F.lit(-1), F.lit(count * tries - 1))))
    drawn = picked(tried, with_shares(own, "negative", "_weight"), "user_id", "item_id", "try", seed=seed)
    drawn = drawn.withColumn("negative", F.when(F.col("try") < 0, F.col("item_id")).otherwise(F.col("negative")))
    mine = F.max((F.col("try") < 0) & F.col("user_id").isNotNull()).over(Window.partitionBy("user_id", "negative"))
    known = drawn.withColumn("_own", mine).filter("try >= 0")
    each = known.groupBy("user_id", "item_id", "negative").agg(F.min("try").alias("try"), F.max("_own").alias("_own"))
    fresh = F.sort_array(F.collect_list(F.when(~F.col("_own"), F.struct("try", "negative"))))
    kind = pool.schema["item_id"].dataType
    lists = each.groupBy("user_id", "item_id").agg(F.transform(F.slice(fresh, 1, count), lambda x: x["negative"].cast(kind)).alias("_fresh"))
    # the first `count` items of the fixed order that a user hasn't touched fill any of their lists; no more places can be lost than items touched
    lost = touched.groupBy("user_id").agg(F.count(F.lit(1)).alias("_lost"))
    places = lost.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lost") + count)).alias("place"))
    order = ranks(own.select("negative"), "negative")
    left = places.join(sent(order, order.count()), "place").join(touched, ["user_id", "negative"], "left_anti")
    nth = left.withColumn("_nth", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).filter(F.col("_nth") <= count)
    first = nth.groupBy("user_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("place", "negative"))), lambda x: x["negative"])).alias("_first"))
    rest = F.filter("_first", lambda x: ~F.exists("_fresh", lambda y: y.eqNullSafe(x)))
    whole = F.slice(F.concat("_fresh", F.coalesce(rest, F.slice("_fresh", 1, 0))), 1, count)
    found = lists.join(first, "user_id", "left").select("user_id", "item_id", F.posexplode(whole).alias("rank", "negative"))
    return found.select("user_id", "item_id", "negative", (F.col("rank") + 1).alias("rank"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A table that is joined in every task if it has no more than SENT_ROWS rows, and as Spark sees fit otherwise."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def ranks(df: DataFrame, key: str, blocks: int = 64) -> DataFrame:
    """Adds `place`, from 0 over all rows: within blocks by a hash of the key, after the rows of earlier blocks."""
    cut = df.withColumn("_block", (_digits(key) % blocks).cast("int"))
    sizes = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))  # a row for each block
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(_digits(key), key))
    return cut.withColumn("_own", own).join(F.broadcast(offsets), "_block").withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_block", "_own", "_before")


def contrastive(df: DataFrame, most: int = 100) -> DataFrame:
    """(user_id, event_id, anchor, positive): the items before each event but the first, and its own."""
    return next_item_samples(df, most).select("user_id", "event_id", F.col("history").alias("anchor"), F.col("item_id").alias("positive"))


def contrastive_triples(df: DataFrame, pool: DataFrame, most: int = 100, count: int = 4, seed: int = 42) -> DataFrame:
    """(user_id, event_id, anchor, positive, negatives): `contrastive` with items of the pool that the user never touched, in an array."""
    drawn = negatives(df.filter("item_id is not null"), pool, count, seed=seed)
    lists = drawn.groupBy("user_id", F.col("item_id").alias("positive")).agg(F.sort_array(F.collect_list(F.struct("rank", "negative"))).alias("_l"))
    joined = contrastive(df, most).join(lists, ["user_id", "positive"], "left")
    kind = pool.schema["item_id"].dataType.simpleString()
    return joined.select("user_id", "event_id", "anchor", "positive", F.coalesce(F.col("_l.negative"), F.array().cast(f"array<{kind}>")).alias("negatives"))


def dropout(events: Column, key: Column, rate: float = 0.1, seed: int = 42) -> Column:
    """Elements of an array left after a seeded dropout; the first one if none would be."""
    kept = F.filter(events, lambda e, i: draw(key, i, seed=seed) >= rate)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(events, 1, 1))


def crop(events: Column, key: Column, least: float = 0.5, seed: int = 42) -> Column:
    """A seeded stretch of 50 to 100 % of an array, two elements at least if it has them."""
    size = F.greatest(F.least(F.size(events), F.lit(2)), F.ceil(F.size(events) * (least + (1 - least) * draw(key, F.lit(0), seed=seed)))).cast("int")
    start = F.floor(draw(key, F.lit(1), seed=seed) * (F.size(events) - size + 1)).cast("int")
    return F.slice(events, start + 1, size)


def shuffled(events: Column, key: Column, window: int = 3, seed: int = 42) -> Column:
    """Elements in a seeded order within each stretch of `window`; what they are stays the same."""
    placed = F.transform(events, lambda e, i: F.struct(F.floor(i / window).alias("block"), draw(key, i, seed=seed).alias("draw"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda p: p["e"])


def statistics(df: DataFrame) -> DataFrame:
    """One row: users, events, items, and events a user on average, at most and at least."""
    per_user = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    items = df.agg(F.count_distinct("item_id").alias("items"))
    users = per_user.agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"), F.avg("n").alias("avg_events"), F.max("n").alias("max_events"), F.min("n").alias("min_events")
    )
    return users.join(items)  # single rows
