"""Full text, trigram index and weighted ratio against scans and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import fuzzy, texts
from strandline.operators import gram_index, word_index
from strandline.plans import registry
from strandline.sources import files
from strandline.sources.tables import table

DOCS = [
    (1, "The red fox, the RED dog; and the fox."),
    (2, "red dog red dog red"),
    (3, None),
    (4, ""),
    (5, "!?"),
    (6, "Größe 42 — naïve Straße"),
    (7, "a b a b a c"),
    (8, "fox " * 500 + "end"),
]


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def words_path(spark):
    path = files.scratch(spark)
    word_index.build(spark.createDataFrame(DOCS, "id long, text string").repartition(3), path, "id", "text", buckets=5)
    return path


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query int, text string")


def test_phrases(spark, words_path):
    queries = ["red dog", "a b a c", "a b a", "the fox", "größe 42 naïve", "red", "dog the", "", "end", "fox end", "unknown red"]
    expected = set()
    for n, q in enumerate(queries):
        w = plain_words(q)
        for i, t in DOCS:
            own = plain_words(t)
            at = [k for k in range(len(own) - len(w) + 1) if own[k : k + len(w)] == w]
            if w and at:
                expected.add((n, i, at[0]))
    assert {tuple(r) for r in word_index.phrases(spark, words_path, asked(spark, *queries)).collect()} == expected


def test_all_words_and_repeated_words(spark, words_path):
    found = word_index.ranked(spark, words_path, asked(spark, "Dog RED dog", "dog", "the dog", "zebra", "zebra dog", None), 10, every=True).collect()
    assert {(r["query"], r.id) for r in found} == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)}
    once = {r.id: r.score for r in word_index.ranked(spark, words_path, asked(spark, "red dog"), 10).collect()}
    assert once == {r.id: r.score for r in found if r["query"] == 0}


def test_only_the_buckets_of_the_words_are_read(spark, words_path):
    plan = word_index.ranked(spark, words_path, asked(spark, "dog"), 3)._jdf.queryExecution().toString()
    scans = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert sum("bucket" in s for s in scans) >= 2  # terms and postings


def exchanged(df):
    """The keys by which a plan shuffles."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_postings_are_shuffled_by_text_and_not_by_query_and_text(spark, words_path):
    """F8, F12: what queries times texts are is added up where the texts' postings are."""
    for every in (False, True):
        keys = exchanged(word_index.ranked(spark, words_path, asked(spark, "red dog", "fox"), 3, every=every))
        assert any(k.startswith("id#") for k in keys)
        assert not any("query#" in k and "id#" in k for k in keys)


def test_phrases_are_put_together_without_a_shuffle_of_queries(spark, words_path):
    """the arrays of places stay where the texts' postings are."""
    keys = exchanged(word_index.phrases(spark, words_path, asked(spark, "red dog", "the fox")))
    assert any(k.startswith("id#") for k in keys)
    assert not any("query#" in k and "id#" in k for k in keys)


def test_an_empty_word_index(spark):
    path = files.scratch(spark)
    word_index.build(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), path, "id", "text")
    assert spark.read.parquet(f"{path}/totals").first().texts == 2
    assert word_index.ranked(spark, path, asked(spark, "a b"), 3).collect() == [] and word_index.phrases(spark, path, asked(spark, "a b")).collect() == []


def test_an_empty_trigram_index(spark):
    path = files.scratch(spark)
    gram_index.build(spark.createDataFrame([(1, None)], "id long, name string"), path, "id", "name")
    assert gram_index.similar(spark, path, asked(spark, "a b"), 0.5).collect() == [] and gram_index.fuzzy_matches(spark, path, asked(spark, "a b"), 3).collect() == []


NAMES = [(i, n) for i, n in enumerate(["red gear", "Red Gear", "red gears", "gear red", "blue plate", "", " ", None, "re", "ré gear", "red  gear", "x" * 300, "x" * 299 + "y"])]


@pytest.fixture(scope="module")
def names(spark):
    draw = random.Random(4)
    made = [(100 + i, " ".join(draw.choice(["red", "blue", "old", "gear", "plate", "bolt", "rod"]) for _ in range(draw.randint(1, 3)))[: draw.randint(3, 15)]) for i in range(300)]
    return spark.createDataFrame(NAMES + made, "id long, name string").repartition(3).cache()


@pytest.fixture(scope="module")
def grams_path(spark, names):
    path = files.scratch(spark)
    gram_index.build(names, path, "id", "name", buckets=3)
    return path


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_equals_a_scan(spark, names, grams_path, least):
    queries = names.filter("id % 7 = 0 OR id < 20").select(F.col("id").alias("query"), F.col("name").alias("text"))
    pairs = queries.join(names, names.name.isNotNull() & queries.text.isNotNull())
    scan = pairs.select("query", "id", texts.trigram_similarity(F.col("text"), F.col("name")).alias("s")).filter(F.col("s") >= least - 1e-9)
    got = gram_index.similar(spark, grams_path, queries, least)
    assert {(r["query"], r.id, round(r.similarity, 9)) for r in got.collect()} == {(r["query"], r.id, round(r.s, 9)) for r in scan.collect()}
    items = spark.read.parquet(f"{grams_path}/items").count()
    looked_at = gram_index.candidates(spark, grams_path, queries, least).count()
    assert looked_at <= (0.5, 0.25, 0.06, 0.03)[(0.3, 0.5, 0.8, 1.0).index(least)] * items * queries.count()
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]


def test_similar_refuses_no_threshold(spark, grams_path):
    for least in (0, 1.1):
        with pytest.raises(ValueError):
            gram_index.candidates(spark, grams_path, asked(spark, "x"), least)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            row[j], before = (before + 1 if c == d else max(row[j], row[j - 1])), row[j]
    return row[-1]


def plain_ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    if not a or not b:
        return 0.0 if a or b else 100.0

    def best(s, t):
        return max(plain_ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))


def in_order(words):
    return " ".join(sorted(words))


def plain_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = in_order(x & y), in_order(x - y), in_order(y - x)
    if both and not (p and q):
        return 100.0
    with_p, with_q = (len(both) + (1 if both else 0) + len(s) for s in (p, q))
    found = [100 - 100 * (len(p) + len(q) - 2 * lcs(p, q)) / (with_p + with_q)]
    if both:
        found += [plain_ratio(both, f"{both} {s}") for s in (p, q)]
    return max(found)


def plain_weighted(a, b):
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(plain_ratio(a, b), 0.95 * plain_ratio(in_order(a.split()), in_order(b.split())), 0.95 * plain_token_set(a, b))
    weight = 0.9 if times < 8 else 0.6
    x, y = set(a.split()), set(b.split())
    tokens = 100.0 if x & y else max(plain_partial(in_order(a.split()), in_order(b.split())), plain_partial(in_order(x - y), in_order(y - x)))
    return max(plain_ratio(a, b), weight * plain_partial(a, b), 0.95 * weight * tokens)


def test_weighted_ratio_of_random_texts(spark):
    draw = random.Random(2)

    def text():
        if draw.random() < 0.6:
            return "".join(draw.choice("abc  d") for _ in range(draw.choice([0, 1, 3, 6, 10, 20]))).strip()
        return " ".join(draw.choice(["red", "gear", "old", "bolt", "é😀"]) for _ in range(draw.randint(0, 4)))

    rows = [(text(), text()) for _ in range(400)] + [("a b", "a b"), ("A", "a"), ("x" * 70, "y" + "x" * 80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.weighted_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(plain_weighted(r.a, r.b)), (r.a, r.b)
    none = spark.createDataFrame([(None, "a")], "a string, b string").select(fuzzy.weighted_ratio(F.col("a"), F.col("b"))).first()[0]
    assert none is None


def test_fuzzy_search_equals_scoring_every_part(spark, sf):
    part = [(r.p_partkey, r.p_name) for r in table(spark, sf, "part").collect()]
    expected = set()
    for key, name in part:
        if key % 20 == 0:
            turned = " ".join(reversed(name.split(" ")))
            q = (turned[:2] + turned[3:]).lower()
            scores = sorted((-round(plain_weighted(q, n.lower()), 6), i) for i, n in part)
            expected |= {(key, i, -s, n + 1) for n, (s, i) in enumerate([x for x in scores if -x[0] >= 60][:10])}
    assert {tuple(r) for r in registry.queries()["fn40_weighted_ratio"](spark, sf).select("query", "id", "score", "rank").collect()} == expected


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_pairs_of_trigrams_lose_nothing(spark, monkeypatch, least):
    """Short, long and one-trigram texts against all pairs; names that share single trigrams only are no candidates."""
    monkeypatch.setattr(gram_index, "LONG", 12)
    texts = ["", "a", "ab", "aa", "aaaaaaaa", "abc", "abcd", "abcabc"] + [f"customer#{i * 7919 % 1000:06d}" for i in range(40)] + ["abcd" * n + "xyz" * (n % 3) for n in range(1, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = files.scratch(spark)
    gram_index.build(df, path, "id", "text", buckets=3)
    sets = [{f"  {t} "[i : i + 3] for i in range(len(t) + 1)} for t in texts]
    expected = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) / len(x | y) >= least - 1e-9}
    got = gram_index.similar(spark, path, df.withColumnRenamed("id", "query"), least).select("query", "id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_few_candidates_share_one_trigram(spark):
    df = spark.range(2000).select("id", F.format_string("customer#%09d", F.col("id") * 7919).alias("text"))
    path = files.scratch(spark)
    gram_index.build(df, path, "id", "text", buckets=2)
    assert gram_index.candidates(spark, path, df.filter("id % 20 = 0").withColumnRenamed("id", "query"), 0.8).count() < 1_000


def test_rows_of_a_frequent_text_are_dealt_to_tasks(spark, monkeypatch):
    """The product of a text's rows and the queries like it comes from tasks by blocks of rows, not from one."""
    monkeypatch.setattr(gram_index, "BLOCK", 16, raising=False)
    df = spark.range(200).select("id", F.when(F.col("id") < 190, "blue plate").otherwise("red gear").alias("text"))
    path = files.scratch(spark)
    gram_index.build(df, path, "id", "text", buckets=2)
    found = gram_index.similar(spark, path, df.filter("id % 20 = 0").withColumnRenamed("id", "query"), 0.5)
    assert sorted((r["query"], r.id) for r in found.collect()) == [(q, i) for q in range(0, 200, 20) for i in range(190)]
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 4 and max(shares) < 0.5 * 1900


def test_unlike_texts_that_share_rare_trigrams_are_no_candidates(spark):
    """names of a dense range share pairs of trigrams with many others; few more than the results themselves are left to be shuffled and compared."""
    df = spark.range(6000).select("id", F.format_string("Customer#%09d", F.col("id")).alias("text"))
    path = files.scratch(spark)
    gram_index.build(df, path, "id", "text", buckets=2)
    queries = df.filter("id % 20 = 0").withColumnRenamed("id", "query")
    results = gram_index.similar(spark, path, queries, 0.8).count()
    assert 300 < results <= gram_index.candidates(spark, path, queries, 0.8).count() < 1.5 * results


def test_flipped_bits_never_say_more_than_the_trigrams(spark, names, grams_path):
    items = spark.read.parquet(f"{grams_path}/items").select("grams", *gram_index._FLIPS).collect()
    for a in items[::5]:
        for b in items:
            bits = sum(((a[f] ^ b[f]) & (2**64 - 1)).bit_count() for f in gram_index._FLIPS)
            apart = len(set(a.grams) ^ set(b.grams))
            assert bits <= apart and (bits - apart) % 2 == 0


def test_equal_queries_are_looked_up_once(spark, names, grams_path, monkeypatch):
    """each of them is answered all the same."""
    asked_for, found = [], gram_index.candidates
    monkeypatch.setattr(gram_index, "candidates", lambda spark, path, queries, *rest: asked_for.append(queries.count()) or found(spark, path, queries, *rest))
    queries = spark.createDataFrame([(i, "Red gear" if i % 2 else "RED GEAR") for i in range(30)] + [(30, "blue plate"), (31, None), (None, "red gear")], "query long, text string")
    got = gram_index.similar(spark, grams_path, queries, 0.5).collect()
    assert asked_for == [2]
    once = {k: sorted((r.id, r.similarity) for r in got if r["query"] == k) for k in range(31)}
    assert all(once[k] == once[0] for k in range(30)) and {0, 1} <= {i for i, s in once[0] if s == 1.0} and once[30]
    assert len(got) == 30 * len(once[0]) + len(once[30])
