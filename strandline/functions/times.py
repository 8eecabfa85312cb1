"""Time of day, week and calendar. Timestamps without a zone are read as they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")


def unix_seconds(ts: str) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def from_seconds(seconds: Column) -> Column:
    """A timestamp without a zone from seconds since 1970."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def bucket(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def weekday_number(ts: Column | str) -> Column:
    """1 for Sunday to 7 for Saturday."""
    return F.dayofweek(ts)


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def weekday_token(ts: Column | str) -> Column:
    return F.when(is_weekend(ts), "weekend").otherwise("weekday")


def era(year: Column) -> Column:
    """Film era of a year given as text or number: SILENT before 1920, then decades, 2020s on, else UNKNOWN."""
    y = year.try_cast("int")
    return (
        F.when(y.isNull(), "ERA_UNKNOWN")
        .when(y < 1920, "ERA_SILENT")
        .when(y >= 2020, "ERA_2020s")
        .otherwise(F.concat(F.lit("ERA_"), (F.floor(y / 10) * 10).cast("int").cast("string"), F.lit("s")))
    )
