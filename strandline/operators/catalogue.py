"""Catalogue tables: cleaning, entity walks, tabular features, skip-gram pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import tokens
from strandline.operators.sequences import draw, picked, with_shares



def walk(pairs: DataFrame, key: str, member: str, least: int = 1, most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """(key, members): the different members of each group, sorted; groups of fewer than `least` go.

    With `most`, the first `most` by `order` (by hash if there is none) stay; the cap is taken by rank
    before members are gathered, so no list grows beyond it.
    """
    unique = pairs.select(key, member).filter(F.col(key).isNotNull() & F.col(member).isNotNull()).distinct()
    if most is not None:
        by = order or [F.xxhash64(member), F.col(member)]
        ranked = unique.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
        unique = ranked.filter(F.col("_n") <= most).drop("_n")
    grouped = unique.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("members"))
    return grouped.filter(F.size("members") >= least)


def groups_between(pairs: DataFrame, key: str, member: str, least: int, most: int) -> DataFrame:
    """Like `walk`, for groups of `least` to `most` different members; larger groups go as a whole, before anything is gathered."""
    unique = pairs.select(key, member).distinct()
    right = unique.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most)).select(key)
    return unique.join(right, key).groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("members"))


def context_tokens(titles: DataFrame, directors: DataFrame, actors: DataFrame, least: int = 3, most_directors: int = 5, most_actors: int = 20) -> DataFrame:
    """(title, tokens): kind, up to five genres, era, rating bucket, directors and actors of each title.

    `titles` has title, kind, genres, era, rating; the others (title, person).
    """

    def people(df: DataFrame, most: int, prefix: str, name: str) -> DataFrame:
        w = Window.partitionBy("title").orderBy("person")
        ranked = df.select("title", "person").distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
        token = tokens.prefixed(F.col("person").cast("string"), prefix)
        return ranked.groupBy("title").agg(F.sort_array(F.collect_list(token)).alias(name))

    whole = titles.join(people(directors, most_directors, "director", "d"), "title", "left").join(people(actors, most_actors, "actor", "a"), "title", "left")
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(tokens.prefixed(F.col("kind"), "title_type")),
        F.transform(F.slice("genres", 1, 5), lambda g: tokens.prefixed(g, "genre")),
        F.array(F.col("era"), F.when(tokens.rating_bucket(F.col("rating")) != "UNKNOWN", F.concat(F.lit("RAT_"), tokens.rating_bucket(F.col("rating"))))),
        F.coalesce("d", none),
        F.coalesce("a", none),
    )
    return whole.select("title", F.array_compact(found).alias("tokens")).filter(F.size("tokens") >= least)


def role_columns(roles: DataFrame, key: str, role: str, columns: int = 10, missing: str = "\\N") -> DataFrame:
    """The most frequent roles of each title as columns role_1 ... role_n."""
    counted = roles.groupBy(key, role).agg(F.count(F.lit(1)).alias("c"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), role))).filter(F.col("r") <= columns)
    lists = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("r", role))).alias("l"))
    return lists.select(key, *(F.coalesce(F.get(F.col(f"l.{role}"), F.lit(i)), F.lit(missing)).alias(f"role_{i + 1}") for i in range(columns)))


def one_hot(df: DataFrame, key: str, value: str, values: list, prefix: str) -> DataFrame:
    """0/1 columns of the values that a key has, by one aggregation."""
    return df.groupBy(key).agg(*(F.max((F.col(value) == v).cast("int")).alias(f"{prefix}_{v}") for v in values))


def keep_members(df: DataFrame, key: str, listed: str, valid: DataFrame, sep: str = ",") -> DataFrame:
    """Comma lists with only the elements that are in the first column of `valid`, in order; an empty list becomes \\N."""
    each = df.select(key, F.posexplode(F.split(listed, sep)).alias("pos", "m"))
    kept = each.join(valid.select(F.col(valid.columns[0]).cast("string").alias("m")).distinct(), "m", "left_semi")
    lists = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("l"))
    return df.join(lists, key, "left").withColumn(listed, F.coalesce(F.array_join(F.col("l.m"), sep), F.lit("\\N"))).drop("l")


def ranked_vocab(sequences: DataFrame, column: str, limit: int = 50_000) -> DataFrame:
    """(token, n, id): ids from 2 by falling frequency, limit - 2 tokens; 0 pads and 1 is unknown."""
    from strandline.operators.vocabulary import vocabulary

    return vocabulary(sequences.select(F.explode(column).alias("token")), least=1, most=limit - 2, first_id=2)


def id_matrix(sequences: DataFrame, key: str, column: str, vocab: DataFrame, width: int = 100) -> DataFrame:
    """(key, ids) with `width` ids each: unknown tokens 1, padding 0, longer sequences cut."""
    each = sequences.select(key, F.posexplode(F.slice(column, 1, width)).alias("pos", "token"))
    coded = each.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(1).cast("long")))
    lists = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("l"))
    pad = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size("l"), F.lit(0)))
    return lists.select(key, F.concat(F.col("l.id"), pad).alias("ids"))


def keep_probability(counts: DataFrame, count: str = "n", threshold: float = 1e-3) -> DataFrame:
    """Adds `keep`: sqrt(t / f) + t / f of each token's share f, 1 at most."""
    total = counts.agg(F.sum(count).alias("_total"))
    f = F.col(count) / F.col("_total")
    return counts.join(F.broadcast(total)).withColumn("keep", F.least(F.lit(1.0), F.sqrt(threshold / f) + threshold / f)).drop("_total")


def negative_distribution(counts: DataFrame, count: str = "n", power: float = 0.75) -> DataFrame:
    """Adds `p`: each token's count to the power, over the sum of all."""
    raised = counts.withColumn("_w", F.pow(F.col(count).cast("double"), F.lit(power)))
    return raised.join(F.broadcast(raised.agg(F.sum("_w").alias("_s")))).withColumn("p", F.col("_w") / F.col("_s")).drop("_w", "_s")


def skip_grams(sequences: DataFrame, key: str, ids: str, window: int = 5, seed: int = 42, dynamic: bool = True) -> DataFrame:
    """(key, target, context) for positions at most w apart, w drawn for each target from 1 to `window` by a hash; ids 0 and 1 go first.

    Pairs are built inside each row, so a long sequence costs its length times the window.
    """
    clean = sequences.select(key, F.filter(ids, lambda x: x > 1).alias("s"))
    place = F.posexplode("s").alias("i", "target")
    each = clean.select(key, "s", place)
    w = (F.floor(draw(F.col(key), F.col("i"), seed=seed) * window) + 1).cast("int") if dynamic else F.lit(window)
    lo = F.greatest(F.col("i") - w, F.lit(0))
    before, after = F.slice("s", lo + 1, F.col("i") - lo), F.slice("s", F.col("i") + 2, w)
    return each.select(key, "target", F.explode(F.concat(before, after)).alias("context"))


def with_negatives(pairs: DataFrame, distribution: DataFrame, id_: str, k: int = 4, seed: int = 42) -> DataFrame:
    """(…, candidate, label): each pair's context with label 1 and k draws from the distribution with label 0.

    A hash of the pair draws tokens by their share `p`, however small.
    """
    shares = with_shares(distribution.select(F.col(id_).alias("candidate"), "p"), "candidate", "p").drop("p")
    drawn = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_k"))
    negative = picked(drawn, shares, "target", "context", "_k", seed=seed).withColumn("label", F.lit(0))
    return pairs.withColumns({"candidate": F.col("context"), "label": F.lit(1)}).unionByName(negative.select(*pairs.columns, "candidate", "label"))


def name_dictionary(*sources: DataFrame) -> DataFrame:
    """(token, name) of several sources (token, name), the earlier ones first where a token is in more."""
    parts = [s.select("token", "name", F.lit(i).alias("_p")) for i, s in enumerate(sources)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("token").agg(F.min_by("name", F.struct("_p", "name")).alias("name"))


def reverse_names(names: DataFrame) -> DataFrame:
    """(name, token) by lower-case name; a name of several tokens gives the least one."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.min("token").alias("token"))
