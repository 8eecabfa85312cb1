"""Candidates, co-occurrence and recommendation lists for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.tokens import COOCCURRENCE_WEIGHTS, weight
from strandline.operators.statistics import top_per


def not_interacted(candidates: DataFrame, interactions: DataFrame, actions: tuple[str, ...] | None = ("click", "buy", "like", "purchase")) -> DataFrame:
    """Candidates (user_id, item_id, ...) that the user has no such interaction with."""
    done = interactions if actions is None else interactions.filter(F.col("action").isin(*actions))
    return candidates.join(done.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def popular(items: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first items with `rank` and a score that falls by a hundredth a rank."""
    top = items.orderBy(*order).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("score", 1.0 - 0.01 * (F.col("rank") - 1))


def popular_for_users(users: DataFrame, interactions: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, item_id, rank): each user's k best items of a ranked list that they haven't touched.

    A user can lose no more items than they touched on the list, so each user is paired with that many more
    places than k, not with the whole list.
    """
    listed = ranked.select("item_id", "rank")
    touched = interactions.select("user_id", "item_id").distinct().join(listed, "item_id")
    lost = touched.groupBy("user_id").agg(F.count(F.lit(1)).alias("lost"))
    places = users.select("user_id").distinct().join(lost, "user_id", "left").select(
        "user_id", F.explode(F.sequence(F.lit(1), (F.coalesce("lost", F.lit(0)) + k).cast("int"))).alias("rank")
    )
    left = places.join(listed, "rank").join(touched.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("rank")
    return left.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("user_id", "item_id", F.col("place").alias("rank"))


def cooccurrence(df: DataFrame, least: int = 3, most_items: int | None = None, actions: tuple[str, ...] = ("click", "like", "buy", "purchase")) -> DataFrame:
    """(item_a, item_b, users, score): item pairs that `least` users share; the score is b's weighted events by a's users over the greatest.

    All items of all users count, unless `most_items` is given: then a user's newest ones. Items of fewer than `least` users are
    left out first. A user costs half the square of their other items; the join is one that can be split where a user has very many.
    """
    used = df.filter(F.col("action").isin(*actions) & F.col("item_id").isNotNull())
    per = used.withColumn("w", weight(F.col("action"), COOCCURRENCE_WEIGHTS, 0.5)).groupBy("user_id", "item_id").agg(F.sum("w").alias("w"), F.max("ts").alias("ts"))
    kept = per if most_items is None else top_per(per, "user_id", [F.desc("ts"), F.col("item_id")], most_items)
    kept = kept.select("user_id", "item_id", "w")
    # an item of fewer users is in no result
    enough = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("item_id")
    kept = kept.join(enough, "item_id")
    a = kept.select("user_id", F.col("item_id").alias("item_a"), F.col("w").alias("wa"))
    b = kept.select("user_id", F.col("item_id").alias("item_b"), F.col("w").alias("wb"))
    # each pair once, counted, and only then both ways
    once = a.join(b, "user_id").filter("item_a < item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("users"), F.sum("wb").alias("wb"), F.sum("wa").alias("wa"))
    ways = (F.struct(F.col(x).alias("item_a"), F.col(y).alias("item_b"), "users", F.col(w).alias("weighted")) for x, y, w in (("item_a", "item_b", "wb"), ("item_b", "item_a", "wa")))
    pairs = once.select(F.inline(F.array(*ways)))
    shared = pairs.filter(F.col("users") >= least)
    greatest = shared.groupBy("item_a").agg(F.max("weighted").alias("m"))
    return shared.join(greatest, "item_a").select("item_a", "item_b", "users", (F.col("weighted") / F.col("m")).alias("score"))


def merged(sources: list[tuple[str, DataFrame]], size: int) -> DataFrame:
    """(user_id, item_id, source, score, position): recalls one after the other until a list is full; no item is dropped as a repeat.

    A later recall only fills what the earlier ones leave short of `size`.
    """
    each = None
    for priority, (name, df) in enumerate(sources):
        part = df.select("user_id", "item_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("source"), F.lit(priority).alias("priority"))
        each = part if each is None else each.unionByName(part)
    w = Window.partitionBy("user_id").orderBy("priority", F.desc("score"), "item_id")
    full = each.withColumn("_fill", F.row_number().over(w)).filter(F.col("_fill") <= size)
    final = Window.partitionBy("user_id").orderBy(F.desc("score"), "priority", "item_id")
    return full.withColumn("position", F.row_number().over(final)).drop("_fill", "priority")


def gate(sequence_lengths: DataFrame, least: int = 5) -> DataFrame:
    """Adds `is_cold`: users with fewer events than `least` get the popular list."""
    return sequence_lengths.withColumn("is_cold", F.coalesce("n", F.lit(0)) < least)


def age_categories(age: Column, bands: list[tuple[int, list[str]]], default: list[str]) -> Column:
    """The categories of the first band whose upper bound is above the age; ages of 0 or less get the default."""
    out = F.array(*(F.lit(c) for c in default))
    for upper, categories in reversed(bands):
        out = F.when(age < upper, F.array(*(F.lit(c) for c in categories))).otherwise(out)
    return F.when(age > 0, out).otherwise(F.array(*(F.lit(c) for c in default)))


def as_of_join(labels: DataFrame, history: DataFrame, key: str, ts: str, features: list[str], order: str | None = None) -> DataFrame:
    """Each label row with the newest features of its key at or before its time.

    Both sides are put on one time line; the newest features are carried forward.
    """
    side = history.select(key, ts, *features).withColumns({"_is_label": F.lit(0), "_there": F.lit(1)})
    base = labels.withColumn("_is_label", F.lit(1))
    line = base.unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "_is_label", *([order] if order else [])).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_there") == 1, F.struct(*features)), ignorenulls=True).over(w)
    found = line.withColumn("_f", packed).filter("_is_label = 1")
    return found.select(*labels.columns, *(F.col(f"_f.{f}").alias(f) for f in features))
