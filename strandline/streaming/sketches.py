"""Quantiles and distinct counts of long windows from the sketches of short ones.

A short window is stored once, as one row with a KLL sketch of a value and a HyperLogLog sketch of a key. Longer windows merge
those rows, so a month of any service is read from hours, and never from its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch (rank error of about 0.5 %) and, as a power of two, that of the distinct one (error of about 0.8 %).
KLL, HLL = 600, 14


def sketched(df: DataFrame, value: str, key: str, *labels: str, length: str = "1 hour", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(labels, start, end, n, values, keys): one row for each window with rows, of a batch or a stream.

    `start` and `end` are seconds. Null values and keys aren't counted in their sketches; n counts all rows.
    """
    stamped = df.withColumn("_t", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    found = stamped.groupBy(F.window("_t", length).alias("w"), *labels).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL).alias("values"), F.hll_sketch_agg(key, HLL).alias("keys")
    )
    return found.select(*labels, F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "n", "values", "keys")


def merged(stored: DataFrame, seconds: int, *labels: str) -> DataFrame:
    """The same rows for windows of so many seconds, a multiple of the stored ones' length, aligned to the epoch."""
    start = F.col("start") - F.pmod("start", F.lit(seconds))
    found = stored.groupBy(*labels, start.alias("start")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("keys").alias("keys"))
    return found.select(*labels, "start", (F.col("start") + seconds).alias("end"), "n", "values", "keys")


def quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("values", F.lit(q))


def distinct() -> Column:
    return F.hll_sketch_estimate("keys")


def report(windows: DataFrame, *labels: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(labels, start, end, n, distinct, p50, …) of stored or merged rows."""
    named = (quantile(q).alias(f"p{round(q * 100)}") for q in quantiles)
    return windows.select(*labels, "start", "end", "n", distinct().alias("distinct"), *named)
