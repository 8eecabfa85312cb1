"""User profiles: behaviour features, preferences, cross features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.tokens import PREFERENCE_WEIGHTS, weight
from strandline.operators.statistics import n_of, top_per


def behaviour_features(df: DataFrame) -> DataFrame:
    """Counts, active days, last active second, and the hours with more than a 24th of a user's events."""
    per_hour = df.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    hours = per_hour.groupBy("user_id").agg(F.sum("c").alias("n"), F.collect_list(F.struct("hour", "c")).alias("h"))
    liked = F.array_sort(F.transform(F.filter("h", lambda x: x["c"] > F.col("n") / 24), lambda x: x["hour"]))
    sums = df.groupBy("user_id").agg(
        n_of("view").alias("views"), n_of("click").alias("clicks"), n_of("purchase", "buy").alias("purchases"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.max("seconds").alias("last_active")
    )
    return sums.join(hours.select("user_id", liked.alias("preferred_hours")), "user_id")


def profiles(df: DataFrame) -> DataFrame:
    """Totals first, then what derives from them: cold below ten events, activity a hundredth of the events, ten at most."""
    n = F.count(F.lit(1))
    sums = df.groupBy("user_id").agg(
        n.alias("total"), n_of("view").alias("views"), n_of("click").alias("clicks"), n_of("purchase", "buy").alias("purchases"), F.max("seconds").alias("last_active")
    )
    return sums.withColumns({"is_cold_start": F.col("total") < 10, "activity": F.least(F.col("total") / 100, F.lit(10.0))})


def action_counts(df: DataFrame) -> DataFrame:
    """A map of counts by action and one by hour for each user."""
    actions = df.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id")
    hours = df.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("c")).groupBy("user_id")
    a = actions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "c")))).alias("action_counts"))
    h = hours.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "c")))).alias("active_hours"))
    return a.join(h, "user_id")


def preferences(interactions: DataFrame, items: DataFrame, feature: str, k: int = 10) -> DataFrame:
    """(user_id, feature, score, rank): summed action weights of a user's items by a feature of the item (arrays are exploded)."""
    weighted = interactions.withColumn("w", weight(F.col("action"), PREFERENCE_WEIGHTS, 1.0)).join(items, "item_id")
    if dict(items.dtypes)[feature].startswith("array"):
        weighted = weighted.withColumn(feature, F.explode(feature))
    scores = weighted.groupBy("user_id", feature).agg(F.sum("w").alias("score"))
    return top_per(scores, "user_id", [F.desc("score"), F.col(feature)], k)


def price_range(interactions: DataFrame, items: DataFrame) -> DataFrame:
    return interactions.join(items, "item_id").groupBy("user_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def cross_features(df: DataFrame, newest: int = 1000) -> DataFrame:
    """(user_id, item_id, n, last_action, last_seconds) over each user's newest events."""
    recent = top_per(df, "user_id", [F.desc("ts"), F.desc("event_id")], newest)
    return recent.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("action", F.struct("ts", "event_id")).alias("last_action"), F.max("seconds").alias("last_seconds")
    )
