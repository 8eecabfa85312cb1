"""Beam search over tables of code probabilities, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.statistics import top_per


def log_shares(counted: DataFrame, prefix: list[str], code: str, n: str = "n") -> DataFrame:
    """(prefix, code, logp): the log of each code's share among all with the same prefix columns."""
    total = counted.groupBy(*prefix).agg(F.sum(n).alias("_t"))
    return counted.join(total, prefix).select(*prefix, code, F.ln(F.col(n) / F.col("_t")).alias("logp"))


def search(first: DataFrame, levels: list[DataFrame], width: int, most: int, user: str = "user_id", digits: int = 9) -> DataFrame:
    """(user, codes, score, rank): for each user the `most` code sequences of the highest summed log probability that a beam finds.

    `first` is (user, code, logp); each further level is (prefix, code, logp) with the codes so far as an array. After every level
    but the last the `width` best prefixes of a user go on; sums are rounded to `digits`, and ties go to the smaller codes. A prefix that no
    level continues ends there and is left out.
    """
    state = first.select(user, F.array("code").alias("codes"), F.round("logp", digits).alias("score"))
    for level in levels:
        kept = top_per(state, user, [F.desc("score"), F.col("codes")], width).drop("rank")
        grown = kept.join(level.withColumnRenamed("prefix", "codes"), "codes")
        state = grown.select(user, F.array_append("codes", F.col("code")).alias("codes"), F.round(F.col("score") + F.col("logp"), digits).alias("score"))
    return top_per(state, user, [F.desc("score"), F.col("codes")], most)
