"""Filters and validation of behaviour events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of raw events.
EVENT_TYPES = ("view", "click", "like", "dislike", "purchase", "share", "rating", "search", "add_to_cart")


def by_action(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, action: str = "action") -> DataFrame:
    if include:
        df = df.filter(F.col(action).isin(include))
    if exclude:
        df = df.filter(~F.coalesce(F.col(action).isin(exclude), F.lit(False)))
    return df


def by_time(df: DataFrame, start: int | None = None, end: int | None = None, seconds: str = "seconds") -> DataFrame:
    """Both ends included. A missing time counts as 0 against the start and passes the end."""
    when = F.coalesce(F.col(seconds), F.lit(0))
    if start is not None:
        df = df.filter(when >= start)
    if end is not None:
        df = df.filter(when <= end)
    return df


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality with each value that isn't None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def failures(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a null outcome is a failure."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def event_rules(user: str = "user_id", item: str = "item_id", action: str = "action", types: tuple[str, ...] = EVENT_TYPES) -> dict[str, Column]:
    return {
        "user_id": F.col(user).isNotNull() & (F.length(F.col(user).cast("string")) > 0),
        "item_id": F.col(item).isNotNull() & (F.length(F.col(item).cast("string")) > 0),
        "event_type": F.col(action).isin(*types),
    }


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters with the names of the broken rules)."""
    marked = df.withColumn("errors", failures(rules))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for each CHECK; as in SQL, a null outcome passes."""
    counts = df.agg(*(F.count_if(~ok).alias(name) for name, ok in checks.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in checks))
    return counts.select(F.inline(pairs))


def strip_strings(df: DataFrame) -> DataFrame:
    from strandline.functions.texts import stripped

    return df.withColumns({c: stripped(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def prune(df: DataFrame, drop: list[str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Drops columns that are there and renames others."""
    return df.drop(*(drop or [])).withColumnsRenamed(dict(rename or {}))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20, most: int = 100) -> DataFrame:
    """One page (from 1) with the number of all rows in `total`."""
    size = max(1, min(size, most))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    chosen = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return chosen.join(F.broadcast(total))  # a single row


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def membership_flags(df: DataFrame, key: str, **sets: DataFrame) -> DataFrame:
    """0/1 columns that tell whether a key is in each set (first column of each)."""
    for name, members in sets.items():
        ids = members.select(F.col(members.columns[0]).alias("_k"), F.lit(1).alias(name)).distinct()
        df = df.join(ids, F.col(key) == F.col("_k"), "left").drop("_k").fillna({name: 0})
    return df
