"""Alerts over windowed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sustained(metrics: DataFrame, condition: Column, windows: int, *labels: str, start: str = "start", step: int | None = None) -> DataFrame:
    """Rows where a condition has held for `windows` windows in a row, this one included.

    With `step`, the windows must also be that many seconds apart, so a gap in the metrics breaks the run.
    """
    w = Window.partitionBy(*labels).orderBy(start)
    last = w.rowsBetween(-(windows - 1), 0)
    marked = metrics.withColumns({"_ok": F.coalesce(condition, F.lit(False)).cast("int")})
    held = (F.sum("_ok").over(last) == windows) & (F.count(F.lit(1)).over(last) == windows)
    if step is not None:
        held = held & (F.col(start) - F.lag(start, windows - 1).over(w) == step * (windows - 1)) if windows > 1 else held
    return marked.withColumn("_held", held).filter("_held").drop("_ok", "_held")


def dropped(metrics: DataFrame, value: str, factor: float, back: int, start: str = "start") -> DataFrame:
    """Windows whose value is below `factor` times that of the window `back` seconds before."""
    before = metrics.select((F.col(start) + back).alias(start), F.col(value).alias("_before"))
    return metrics.join(before, start).filter(F.col(value) < factor * F.col("_before")).withColumnRenamed("_before", f"{value}_before")


def absent(expected: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """What was expected and isn't there."""
    return expected.join(observed.select(*on).distinct(), on, "left_anti")
