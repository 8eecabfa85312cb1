"""Counts, rates and scores of items, users and days."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the trending and hot scores.
TRENDING = {"click": 2, "like": 3, "purchase": 5, "buy": 5}
HOT = {"views": 0.3, "clicks": 0.5, "rating": 20.0}


def n_of(*actions: str, action: str = "action") -> Column:
    return F.count_if(F.col(action).isin(*actions))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def last_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the time as of which windows look back: that of the last row."""
    return df.agg(F.max(ts).alias("as_of"))


def since(df: DataFrame, interval: str, ts: str = "ts", as_of: DataFrame | None = None) -> DataFrame:
    """Rows less than an interval before the time as of which one looks back."""
    when = as_of if as_of is not None else last_time(df, ts)
    return df.join(F.broadcast(when)).filter(F.col(ts) > F.col("as_of") - F.expr(f"INTERVAL {interval}")).drop("as_of")


def item_stats(df: DataFrame) -> DataFrame:
    views, clicks, bought = n_of("view"), n_of("click"), n_of("purchase", "buy")
    counted = df.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), views.alias("views"), clicks.alias("clicks"), bought.alias("purchases")
    )
    return counted.withColumns({"click_rate": ratio(F.col("clicks"), F.col("views")), "conversion_rate": ratio(F.col("purchases"), F.col("clicks"))})


def user_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("item_id").alias("items"),
        n_of("view").alias("views"),
        n_of("click").alias("clicks"),
        n_of("purchase", "buy").alias("purchases"),
        F.avg(F.when(F.col("action").isin("purchase", "buy"), F.col("value"))).alias("avg_value"),
    )


def item_daily(df: DataFrame) -> DataFrame:
    counted = df.groupBy("item_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), n_of("view").alias("views"), n_of("click").alias("clicks")
    )
    return counted.withColumn("ctr", ratio(F.col("clicks"), F.col("views")))


def trending(df: DataFrame, interval: str = "7 DAYS", least: int = 10, most: int = 1000) -> DataFrame:
    """Items of the last days with at least `least` events, by n + 2 clicks + 3 likes + 5 purchases."""
    counted = since(df, interval).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), n_of("click").alias("clicks"), n_of("like").alias("likes"), n_of("purchase", "buy").alias("purchases")
    )
    score = F.col("n") + 2 * F.col("clicks") + 3 * F.col("likes") + 5 * F.col("purchases")
    return counted.filter(F.col("n") >= least).withColumn("score", score).orderBy(F.desc("score"), "item_id").limit(most)


def scored(df: DataFrame, weights: Mapping[str, float], name: str = "score") -> DataFrame:
    """A weighted sum of columns; nulls count as 0."""
    total: Column = F.lit(0.0)
    for column, weight in weights.items():
        total = total + F.coalesce(F.col(column), F.lit(0)) * weight
    return df.withColumn(name, total)


def share_of_total(df: DataFrame, value: str, *by: str, name: str = "share") -> DataFrame:
    """Each row's part of the sum over its group, the sums taken first and joined back."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(by)).withColumn(name, ratio(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def top_per(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def latest_per(df: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, by (ts, event_id)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls), from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(df.columns)))
    return counts.select(F.inline(rows))


def impute_median(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls become the median of their column."""
    medians = df.agg(*(F.median(c).alias(f"_m_{c}") for c in columns))
    return df.join(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, min, max, population deviation and nearest-rank p50, p90, p95, p99: element int(n q) of the sorted values.

    Ranks come from counts of equal values, so no group's values are gathered in one array.
    """
    sums = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std")
    )
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    joined = upto.join(sums.select(*by, "n"), list(by)) if by else upto.join(F.broadcast(sums.select("n")))
    picks = [
        F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("_v"))).alias(name)
        for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    ]
    ranked = joined.groupBy(*by).agg(*picks)
    return sums.join(ranked, list(by)) if by else sums.join(F.broadcast(ranked))


def sla(measured: DataFrame, targets: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(metric, target, actual, passed) of a one-row table; a target is ('le' or 'ge', value)."""
    rows = []
    for name, (how, value) in targets.items():
        actual = F.col(name).cast("double")
        ok = actual <= value if how == "le" else actual >= value
        rows.append(F.struct(F.lit(name).alias("metric"), F.lit(float(value)).alias("target"), actual.alias("actual"), ok.alias("passed")))
    return measured.select(F.inline(F.array(*rows)))


def population_stability(expected: DataFrame, actual: DataFrame, bucket: str) -> DataFrame:
    """One row with the population stability index of a bucketed column: the sum of (a - e) ln(a / e) over shares."""
    e = expected.groupBy(bucket).agg(F.count(F.lit(1)).alias("e"))
    a = actual.groupBy(bucket).agg(F.count(F.lit(1)).alias("a"))
    both = e.join(a, bucket, "full").fillna(0, ["e", "a"])
    totals = both.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    shares = both.join(F.broadcast(totals)).select(
        F.greatest(F.col("e") / F.col("te"), F.lit(1e-6)).alias("e"), F.greatest(F.col("a") / F.col("ta"), F.lit(1e-6)).alias("a")
    )
    return shares.agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def gini(counts: DataFrame, value: str) -> DataFrame:
    """One row: Gini index of the counts, 0 without rows. Ranks are taken over the counts of equal values."""
    per = counts.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # ranks b+1 .. b+c of equal values add up to c b + c (c + 1) / 2
    parts = placed.agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("total"), F.sum(F.col("v") * (F.col("c") * F.col("b") + F.col("c") * (F.col("c") + 1) / 2)).alias("ranked")
    )
    return parts.select(
        F.coalesce(F.when(F.col("total") > 0, (2 * F.col("ranked") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))), F.lit(0.0)).alias("gini")
    )
