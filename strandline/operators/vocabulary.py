"""Token vocabularies: counting, ids, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.tokens import UNK


def counts(tokens: DataFrame, token: str = "token", least: int = 1) -> DataFrame:
    return tokens.filter(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def vocabulary(tokens: DataFrame, least: int = 5, most: int = 500_000, first_id: int = 5) -> DataFrame:
    """(token, n, id): the `most` most frequent tokens, ids from `first_id` by falling count, then by token.

    The bound comes before the global ranking, so one task ranks `most` rows at most.
    """
    kept = counts(tokens, least=least).orderBy(F.desc("n"), "token").limit(most)
    order = Window.orderBy(F.desc("n"), "token")
    return kept.withColumn("id", (F.row_number().over(order) + first_id - 1).cast("long"))


def encode(tokens: DataFrame, vocab: DataFrame, token: str = "token", unknown: int = UNK) -> DataFrame:
    """Adds `id`; tokens outside the vocabulary get `unknown`."""
    ids = vocab.select(F.col("token").alias("_t"), F.col("id"))
    return tokens.join(ids, F.col(token) == F.col("_t"), "left").drop("_t").withColumn("id", F.coalesce("id", F.lit(unknown).cast("long")))


def decode(ids: DataFrame, vocab: DataFrame, id_: str = "id", unknown: str = "[UNK]") -> DataFrame:
    names = vocab.select(F.col("id").alias("_i"), F.col("token"))
    return ids.join(names, F.col(id_) == F.col("_i"), "left").drop("_i").withColumn("token", F.coalesce("token", F.lit(unknown)))
