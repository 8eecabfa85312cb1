"""Rules, thresholds, catalogue, lineage, access, erasure and audit as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels from harmless to grave.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def quality_reports(df: DataFrame, rules: Mapping[str, tuple[Column, str]], key: str) -> DataFrame:
    """(key, passed, level, failed): names of the broken rules and the gravest of their levels, LOW if none is."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(LEVELS.index(level)).alias("l"), F.lit(name).alias("name"))) for name, (ok, level) in rules.items())))
    names = F.array(*(F.lit(x) for x in LEVELS))
    worst = F.coalesce(F.array_max(F.transform("b", lambda b: b["l"])), F.lit(0))
    return df.select(key, broken.alias("b")).select(key, (F.size("b") == 0).alias("passed"), F.get(names, worst).alias("level"), F.transform("b", lambda b: b["name"]).alias("failed"))


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics (metric, value) that are beyond their threshold (metric, threshold, comparison of gt, lt, eq)."""
    hit = (
        F.when(F.col("comparison") == "gt", F.col("value") > F.col("threshold"))
        .when(F.col("comparison") == "lt", F.col("value") < F.col("threshold"))
        .otherwise(F.col("value") == F.col("threshold"))
    )
    return metrics.join(F.broadcast(thresholds), "metric").filter(hit)


def search_catalogue(datasets: DataFrame, text: str, tag: str | None = None) -> DataFrame:
    """Datasets (name, description, tags) whose name or description has the text, and the tag if one is asked for."""
    found = datasets.filter(F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower()))
    return found if tag is None else found.filter(F.array_contains("tags", tag))


def lineage(edges: DataFrame, start: DataFrame, depth: int = 1, up: bool = True) -> DataFrame:
    """(node, distance) of what is within `depth` steps of the nodes in `start`, over edges (source, target)."""
    a, b = ("target", "source") if up else ("source", "target")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("_next")).distinct()
    front = start.select(F.col(start.columns[0]).alias("node")).distinct()
    seen = front.withColumn("distance", F.lit(0))
    for n in range(1, depth + 1):
        front = front.join(step, "node").select(F.col("_next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front.withColumn("distance", F.lit(n)))
    return seen.filter("distance > 0")


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds `allowed` to requests (user_id, dataset, permission); a grant of admin holds for every permission.

    `grants` has (user_id, dataset, permissions).
    """
    held = grants.groupBy("user_id", "dataset").agg(F.array_distinct(F.flatten(F.collect_list("permissions"))).alias("_held"))
    joined = requests.join(held, ["user_id", "dataset"], "left")
    has = F.array_contains("_held", F.col("permission")) | F.array_contains("_held", "admin")
    return joined.withColumn("allowed", F.coalesce(has, F.lit(False))).drop("_held")


def revoked(grants: DataFrame, user_id: int, dataset: str, permissions: list[str] | None = None) -> DataFrame:
    """Grants after taking some or all permissions on a dataset from a user."""
    mine = (F.col("user_id") == user_id) & (F.col("dataset") == dataset)
    left = F.array_except("permissions", F.array(*(F.lit(p) for p in permissions))) if permissions else F.array().cast("array<string>")
    return grants.withColumn("permissions", F.when(mine, left).otherwise(F.col("permissions"))).filter(F.size("permissions") > 0)


def erased(tables: Mapping[str, tuple[DataFrame, str]], users: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the users (first column) that asked to be forgotten."""
    ids = users.select(F.col(users.columns[0]).alias("_gone")).distinct()
    return {name: df.join(ids, F.col(key) == F.col("_gone"), "left_anti") for name, (df, key) in tables.items()}


def audit_events(df: DataFrame, source: str, kind: str, subject: str, time: str, data: list[str]) -> DataFrame:
    """CloudEvents-shaped rows; ids depend on the content alone."""
    payload = F.to_json(F.struct(*data))
    return df.select(
        F.lit("1.0").alias("specversion"),
        F.md5(F.concat_ws("|", F.lit(source), F.lit(kind), F.col(subject).cast("string"), F.col(time).cast("string"), payload)).alias("id"),
        F.lit(source).alias("source"),
        F.lit(kind).alias("type"),
        F.col(subject).cast("string").alias("subject"),
        F.col(time).alias("time"),
        payload.alias("data"),
    )
