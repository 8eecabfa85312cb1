"""Token sequences as padded arrays of ids, masks, types and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import arrays, tokens
from strandline.operators.sequences import draw
from strandline.operators.vocabulary import encode

IGNORE = -100


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x.cast("int"))


def id_sequences(each: DataFrame, vocab: DataFrame) -> DataFrame:
    """(user_id, ids, kinds, levels) of rows (user_id, ts, event_id, pos, token), in that order."""
    coded = encode(each, vocab).withColumns({"kind": tokens.kind_id(F.col("token")), "levels": tokens.parse_item(F.col("token"))})
    rows = coded.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "pos", "id", "kind", "levels"))).alias("t"))
    return rows.select("user_id", F.col("t.id").alias("ids"), F.col("t.kind").alias("kinds"), F.col("t.levels").alias("levels"))


def tokenised(each: DataFrame, vocab: DataFrame, length: int = 1024) -> DataFrame:
    """input_ids, attention_mask, token_types, positions and three arrays of semantic ids, `length` long each.

    [CLS] comes first and [SEP] last; a sequence that is too long keeps [CLS] and its last tokens.
    """
    def framed(body: Column, first: Column, last: Column) -> Column:
        return arrays.head_and_last(F.concat(F.array(first), body, F.array(last)), length)

    zero = F.lit(0)

    def level(n: int) -> Column:
        return F.transform("levels", lambda x: F.coalesce(F.get(x, F.lit(n)), zero))

    rows = id_sequences(each, vocab).withColumns(
        {
            "i": framed(F.col("ids"), F.lit(1).cast("long"), F.lit(2).cast("long")),
            "k": framed(F.col("kinds"), F.lit(3), F.lit(3)),
            **{f"s{n}": framed(level(n), zero, zero) for n in range(3)},
        }
    )
    return rows.select(
        "user_id",
        arrays.padded(F.col("i"), length, F.lit(0).cast("long")).alias("input_ids"),
        arrays.padded(F.transform("i", lambda _: F.lit(1)), length, zero).alias("attention_mask"),
        arrays.padded(F.col("k"), length, zero).alias("token_types"),
        F.sequence(zero, F.lit(length - 1)).alias("positions"),
        F.array(*(arrays.padded(F.col(f"s{n}"), length, zero) for n in range(3))).alias("semantic_ids"),
    )


def labels(mask: Column, target: Column) -> Column:
    """IGNORE everywhere but at the last valid place, which holds the target; nowhere for one valid place or none."""
    valid = total(mask)
    return F.transform(mask, lambda _, i: F.when((i == valid - 1) & (valid > 1), target).otherwise(F.lit(IGNORE)))


def special_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x <= max(tokens.SPECIAL.values())).cast("int"))


def mlm(ids: Column, key: Column, vocab_size: int, rate: float = 0.15, seed: int = 42) -> Column:
    """(input_ids, labels): a seeded share of the ordinary tokens masked (80 %), replaced (10 %) or left (10 %), the rest IGNOREd."""
    first = len(tokens.SPECIAL)

    def chosen(x: Column, i: Column) -> Column:
        return (x >= first) & (draw(key, i, seed=seed) < rate)

    def changed(x: Column, i: Column) -> Column:
        how = draw(key, i, seed=seed + 1)
        other = (F.lit(first) + F.floor(draw(key, i, seed=seed + 2) * (vocab_size - first))).cast("long")
        masked = F.when(how < 0.8, F.lit(tokens.SPECIAL["[MASK]"]).cast("long")).when(how < 0.9, other).otherwise(x)
        return F.when(chosen(x, i), masked).otherwise(x)

    wanted = F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(IGNORE).cast("long")))
    return F.struct(F.transform(ids, changed).alias("input_ids"), wanted.alias("labels"))


def issues(samples: DataFrame, length: int) -> DataFrame:
    """Adds `issues`: names of what is wrong with the parallel arrays of a sample."""
    rules = {
        "length": F.size("input_ids") == length,
        "mask_length": F.size("attention_mask") == F.size("input_ids"),
        "type_length": F.size("token_types") == F.size("input_ids"),
        "semantic_levels": (F.size("semantic_ids") == 3) & F.forall("semantic_ids", lambda s: F.size(s) == F.size("input_ids")),
        "negative_id": ~F.exists("input_ids", lambda x: x < 0),
        "mask_values": ~F.exists("attention_mask", lambda x: ~x.isin(0, 1)),
        "type_values": ~F.exists("token_types", lambda x: ~x.isin(0, 1, 2, 3)),
    }
    return samples.withColumn("issues", F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in rules.items()))))
