"""Offline ranking metrics over rows (user, predictions array, truth array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.statistics import gini


def _hits(predictions: Column, truth: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(predictions, 1, k), lambda x: F.array_contains(truth, x)))


def recall(predictions: Column, target: Column, k: int) -> Column:
    """1 if the single truth is among the first k."""
    return F.array_contains(F.slice(predictions, 1, k), target).cast("double")


def ndcg(predictions: Column, target: Column, k: int) -> Column:
    at = F.array_position(F.slice(predictions, 1, k), target)
    return F.when(at > 0, 1 / F.log2(at + 1)).otherwise(0.0)


def reciprocal_rank(predictions: Column, target: Column) -> Column:
    at = F.array_position(predictions, target)
    return F.when(at > 0, 1 / at).otherwise(0.0)


def precision(predictions: Column, truth: Column, k: int) -> Column:
    """Over k, even where the list is shorter; repeats count."""
    return _hits(predictions, truth, k) / k


def average_precision(predictions: Column, truth: Column, k: int) -> Column:
    """Mean of the precisions at the hits, over min(|truth|, k)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.array_contains(truth, x)
        hits = acc["hits"] + hit.cast("int")
        return F.struct((acc["i"] + 1).alias("i"), hits.alias("hits"), F.when(hit, acc["sum"] + hits / (acc["i"] + 1)).otherwise(acc["sum"]).alias("sum"))

    total = F.aggregate(F.slice(predictions, 1, k), start, step, lambda acc: acc["sum"])
    return F.when(F.size(truth) > 0, total / F.least(F.size(truth), F.lit(k))).otherwise(0.0)


def coverage(lists: DataFrame, predictions: str, items: DataFrame, k: int) -> DataFrame:
    """One row: share of the items (first column) that are recommended to anyone."""
    shown = lists.select(F.explode(F.slice(predictions, 1, k)).alias("i")).distinct()
    known = items.select(F.col(items.columns[0]).alias("i")).distinct()
    return known.agg(F.count(F.lit(1)).alias("n")).join(shown.join(known, "i", "left_semi").agg(F.count(F.lit(1)).alias("m"))).select((F.col("m") / F.greatest("n", F.lit(1))).alias("coverage"))


def diversity(lists: DataFrame, user: str, predictions: str, categories: DataFrame, k: int) -> DataFrame:
    """One row: mean over lists of their different categories over their length. `categories` has (item_id, category)."""
    each = lists.select(user, F.explode(F.slice(predictions, 1, k)).alias("item_id")).join(categories, "item_id", "left")
    per = each.groupBy(user).agg((F.count_distinct("category") / F.count(F.lit(1))).alias("d"))
    return per.agg(F.avg("d").alias("diversity"))


def novelty(lists: DataFrame, predictions: str, popularity: DataFrame, k: int) -> DataFrame:
    """One row: mean of -log2(p + 1e-10) over recommended items with p > 0. `popularity` has (item_id, p)."""
    each = lists.select(F.explode(F.slice(predictions, 1, k)).alias("item_id")).join(popularity.filter("p > 0"), "item_id")
    return each.agg(F.avg(-F.log2(F.col("p") + 1e-10)).alias("novelty"))


def metric_table(lists: DataFrame, predictions: str, target: str, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(metric, value): recall and NDCG at each k, and MRR, from one pass."""
    p, t = F.col(predictions), F.col(target)
    values = {f"recall@{k}": F.avg(recall(p, t, k)) for k in ks} | {f"ndcg@{k}": F.avg(ndcg(p, t, k)) for k in ks} | {"mrr": F.avg(reciprocal_rank(p, t))}
    row = lists.agg(*(v.alias(n.replace("@", "_")) for n, v in values.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n.replace("@", "_")).alias("value")) for n in values))))


def recommendation_gini(lists: DataFrame, predictions: str, k: int = 10) -> DataFrame:
    counts = lists.select(F.explode(F.slice(predictions, 1, k)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return gini(counts, "n")


def preference_loss(df: DataFrame, chosen: str, rejected: str, ref_chosen: str, ref_rejected: str, beta: float = 0.1) -> DataFrame:
    """One row: mean DPO loss and accuracy of logged log probabilities."""
    margin = beta * ((F.col(chosen) - F.col(ref_chosen)) - (F.col(rejected) - F.col(ref_rejected)))
    return df.agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"), F.avg((margin > 0).cast("double")).alias("accuracy"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the label (from 0), shifted by the greatest logit."""
    top = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.get(logits, label)
