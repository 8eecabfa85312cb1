"""Rates, ratios, quantiles and sessions over event-time windows, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.statistics import ratio


def _windowed(df: DataFrame, ts: str, length: str, slide: str | None, late: str | None):
    stamped = df.withColumn("_t", F.col(ts).cast("timestamp"))
    if late and df.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    return stamped, F.window("_t", length, slide).alias("w") if slide else F.window("_t", length).alias("w")


def _flat(df: DataFrame) -> DataFrame:
    """Window bounds in seconds."""
    return df.withColumns({"start": F.unix_timestamp("w.start"), "end": F.unix_timestamp("w.end")}).drop("w")


def rates(df: DataFrame, *labels: str, length: str = "5 minutes", slide: str | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(labels, start, end, n, rate): events a second in each window."""
    stamped, w = _windowed(df, ts, length, slide, late)
    found = _flat(stamped.groupBy(w, *labels).agg(F.count(F.lit(1)).alias("n")))
    return found.withColumn("rate", F.col("n") / (F.col("end") - F.col("start")))


def ratios(df: DataFrame, part: Column, whole: Column, *labels: str, length: str = "1 hour", slide: str | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(labels, start, end, part, whole, ratio) from two conditional counts in one aggregation."""
    stamped, w = _windowed(df, ts, length, slide, late)
    found = stamped.groupBy(w, *labels).agg(F.count_if(part).alias("part"), F.count_if(whole).alias("whole"))
    return _flat(found).withColumn("ratio", ratio(F.col("part"), F.col("whole")))


def share_under(df: DataFrame, value: str, bound: float, length: str = "5 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(start, end, n, share) of events whose value is within a bound."""
    stamped, w = _windowed(df, ts, length, None, late)
    found = stamped.groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) <= bound).alias("_u"))
    return _flat(found).withColumn("share", ratio(F.col("_u"), F.col("n"))).drop("_u")


def histogram_quantile(df: DataFrame, value: str, bounds: list[float], q: float, *labels: str, length: str = "1 hour", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(labels, start, end, quantile): interpolated in the bucket where the cumulative count reaches q of all.

    The first bucket begins at 0; beyond the last bound the quantile is that bound.
    """
    stamped, w = _windowed(df, ts, length, None, late)
    counts = [F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    found = _flat(stamped.groupBy(w, *labels).agg(F.count(F.lit(1)).alias("_n"), *counts))
    rank: Column = F.lit(q) * F.col("_n")
    out: Column = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (float(bounds[i - 1]), F.col(f"_le{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"_le{i}") - below
        point = F.lit(low) + (bounds[i] - low) * ratio(rank - below, inside)
        out = F.when(F.col(f"_le{i}") >= rank, point).otherwise(out)
    return found.withColumn("quantile", out).drop("_n", *(f"_le{i}" for i in range(len(bounds))))


def active_users(df: DataFrame, user: str = "user_id", length: str = "1 hour", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(start, end, users): exact in batch, approximate in a stream."""
    stamped, w = _windowed(df, ts, length, None, late)
    users = F.approx_count_distinct(user) if df.isStreaming else F.count_distinct(user)
    return _flat(stamped.groupBy(w).agg(users.alias("users")))


def sessions(df: DataFrame, user: str = "user_id", gap: str = "30 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n) of session windows; unlike the batch rule, a gap of exactly `gap` begins a new one."""
    stamped, _ = _windowed(df, ts, gap, None, late)
    found = stamped.groupBy(user, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return _flat(found)


def log_counts(df: DataFrame, patterns: dict[str, str], text: str, app: str, length: str = "5 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(app, start, end, one column a pattern): lines that match each pattern."""
    stamped, w = _windowed(df, ts, length, None, late)
    return _flat(stamped.groupBy(w, app).agg(*(F.count_if(F.col(text).rlike(p)).alias(n) for n, p in patterns.items())))
