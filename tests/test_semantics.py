"""Edges that the driver's tables don't reach, on small tables worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays, texts, times, tokens, vectors
from strandline.operators import catalogue, governance, ranking, recommend, sequences, similarity, statistics, tokenizer, validate, vocabulary
from strandline.sources import features, files, kafka
from strandline.streaming import alerts, windows

LOG = "event_id long, user_id long, item_id int, action string, seconds long, value double"


def log(spark, rows):
    df = spark.createDataFrame(rows, LOG)
    return df.withColumn("ts", F.expr(f"timestampadd(SECOND, seconds, {times.EPOCH})"))


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("hour,name", [(0, "night"), (5, "night"), (6, "morning"), (11, "morning"), (12, "afternoon"), (17, "afternoon"), (18, "evening"), (23, "evening")])
def test_time_buckets(spark, hour, name):
    assert one(spark, times.bucket(F.lit(hour))) == name


def test_weekend(spark):
    days = [datetime.datetime(2024, 1, d) for d in (5, 6, 7, 8)]  # Friday to Monday
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    assert [r[0] for r in df.select(times.is_weekend("ts")).collect()] == [False, True, True, False]


@pytest.mark.parametrize("year,era", [("1919", "ERA_SILENT"), ("1920", "ERA_1920s"), ("1999", "ERA_1990s"), ("2020", "ERA_2020s"), ("\\N", "ERA_UNKNOWN"), (None, "ERA_UNKNOWN")])
def test_eras(spark, year, era):
    assert one(spark, times.era(F.lit(year).cast("string"))) == era


@pytest.mark.parametrize("rating,bucket", [("7.0", "7.0"), ("7.24", "7.0"), ("7.25", "7.0"), ("7.75", "8.0"), (None, "UNKNOWN"), ("abc", "UNKNOWN")])
def test_rating_halves_go_to_even(spark, rating, bucket):
    assert one(spark, tokens.rating_bucket(F.lit(rating).cast("string"))) == bucket


@pytest.mark.parametrize("value", ["\\N", "", "nan", "None", "UNKNOWN", None])
def test_no_token_for_no_value(spark, value):
    assert one(spark, tokens.prefixed(F.lit(value).cast("string"), "genre")) is None


def test_stable_hash(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h

    for s in ("", "movie_001", "é中", "a😀b"):
        assert one(spark, tokens.stable_hash(F.lit(s))) == plain(s)


def test_parse_item(spark):
    assert one(spark, tokens.parse_item(F.lit("ITEM_1_2_3"))) == [1, 2, 3]
    for bad in ("ITEM_1_2", "ITEM_a_2_3", "ACTION_view", None):
        assert one(spark, tokens.parse_item(F.lit(bad).cast("string"))) is None


def test_session_gap_is_exclusive(spark):
    df = log(spark, [(i, 1, 1, "view", s, 0.0) for i, s in enumerate((0, 1799, 3599, 5400))])
    assert values(sequences.sessions(df), "event_id", "session") == [(0, 0), (1, 0), (2, 0), (3, 1)]
    # the stream's windows part at exactly the gap
    assert windows.sessions(df).count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 11])
def test_sliding_windows(spark, n):
    def plain(events, window, stride):
        return [(i, min(i + window, n - 1), events[i : min(i + window, n - 1)], events[min(i + window, n - 1)]) for i in range(0, n - 1, stride)]

    events = list(range(n))
    df = spark.createDataFrame([(events,)], "a array<int>")
    found = df.select(F.inline(arrays.sliding(F.col("a"), 10, 5))).collect()
    assert [(r.start, r.end, r.input, r.target) for r in found] == plain(events, 10, 5)


def test_sequences_keep_first_or_last(spark):
    df = log(spark, [(i, 1, i, "view", 10, 0.0) for i in range(5)])  # equal times: by event_id
    for keep, items in (("first", [0, 1, 2]), ("last", [2, 3, 4])):
        row = sequences.user_sequences(df, 3, keep=keep).first()
        assert [e.item_id for e in row.events] == items and row.seq_length == 3


def test_dedup_drops_missing_keys(spark):
    df = log(spark, [(1, 1, 5, "view", 1, 0.0), (2, 1, 5, "view", 2, 0.0), (3, 1, None, "view", 3, 0.0)])
    assert values(sequences.deduplicated(df), "event_id") == [(2,)]
    assert values(sequences.deduplicated(df, keep="first"), "event_id") == [(1,)]


def test_time_filter_takes_both_ends_and_missing_times_on_one_side(spark):
    df = log(spark, [(i, 1, 1, "view", s, 0.0) for i, s in enumerate((9, 10, 20, 21, None))])
    assert values(validate.by_time(df, 10, 20), "event_id") == [(1,), (2,)]
    assert values(validate.by_time(df, None, 20), "event_id") == [(0,), (1,), (2,), (4,)]


def test_validation_names_broken_rules(spark):
    df = log(spark, [(1, None, 1, "view", 1, 0.0), (2, 1, None, "nope", 1, 0.0), (3, 1, 1, "view", 1, 0.0)])
    good, dead = validate.split_valid(df, validate.event_rules())
    assert values(good, "event_id") == [(3,)]
    assert {r.event_id: r.errors for r in dead.collect()} == {1: ["user_id"], 2: ["item_id", "event_type"]}


def test_vocabulary_ids_and_ties(spark):
    df = spark.createDataFrame([(t,) for t in "b a b a c".split()], "token string")
    assert values(vocabulary.vocabulary(df, 2), "id", "token") == [(5, "a"), (6, "b")]


def test_negatives_are_never_touched_items(spark):
    df = log(spark, [(i, i % 3, i % 7, "view", i, 0.0) for i in range(30)])
    pool = spark.range(50).select(F.col("id").cast("int").alias("item_id"))
    touched = set(values(df, "user_id", "item_id"))
    found = sequences.negatives(df, pool, 4).collect()
    assert found and all((r.user_id, r.negative) not in touched for r in found)
    assert {r["rank"] for r in found} <= {1, 2, 3, 4}


def test_ranks_are_gapless(spark):
    assert values(sequences.ranks(spark.range(1000).select(F.col("id").alias("k")), "k", 7), "place") == [(i,) for i in range(1000)]


def test_augmentation_keeps_elements(spark):
    df = spark.createDataFrame([(1, list(range(20))), (2, [1]), (3, [])], "k int, a array<int>")
    found = df.select("a", sequences.dropout(F.col("a"), F.col("k"), 0.99).alias("d"), sequences.crop(F.col("a"), F.col("k")).alias("c"), sequences.shuffled(F.col("a"), F.col("k")).alias("s")).collect()
    for r in found:
        assert set(r.d) <= set(r.a) and (len(r.d) >= 1 or not r.a)
        assert sorted(r.s) == r.a
        assert len(r.c) >= min(2, len(r.a)) and all(y - x == 1 for x, y in zip(r.c, r.c[1:]))


def test_mlm_changes_only_ordinary_tokens(spark):
    df = spark.createDataFrame([(1, list(range(5)) + list(range(5, 400)))], "k int, ids array<long>")
    r = df.select("ids", tokenizer.mlm(F.col("ids"), F.col("k"), 500).alias("m")).first()
    assert r.m.input_ids[:5] == [0, 1, 2, 3, 4] and set(r.m.labels[:5]) == {-100}
    masked = [i for i, y in enumerate(r.m.labels) if y != -100]
    assert 0.08 < len(masked) / 395 < 0.22
    assert all(r.m.labels[i] == r.ids[i] for i in masked)
    assert all(r.m.input_ids[i] == r.ids[i] for i in range(400) if i not in set(masked))


def test_sets_with_repeats(spark):
    df = spark.createDataFrame([([1, 1, 2], [2])], "a array<int>, b array<int>")
    r = df.select(arrays.difference(F.col("a"), F.col("b")).alias("d"), arrays.intersection(F.col("b"), F.col("a")).alias("i"), arrays.intersection(F.col("a"), F.array(F.lit(1))).alias("j")).first()
    assert (r.d, r.i, r.j) == ([1, 1], [2], [1, 1])


def test_rates_without_denominator_are_zero(spark):
    df = log(spark, [(1, 1, 1, "purchase", 1, 0.0)])
    r = statistics.item_stats(df).first()
    assert (r.click_rate, r.conversion_rate) == (0.0, 0.0)


def test_cosine_edges(spark):
    def cos(a, b):
        return one(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))

    assert cos([0.0, 0.0], [1.0, 0.0]) == 0.0
    assert cos([1.0], [1.0, 0.0]) == 0.0
    assert cos([1.0, 0.0], [-2.0, 0.0]) == -1.0


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(1, [7, 8, 9], 8, [8, 9]), (2, [1, 2, 3], 3, [3])], "u int, p array<int>, t int, s array<int>")
    assert df.agg(F.avg(ranking.recall(F.col("p"), F.col("t"), 2)), F.avg(ranking.recall(F.col("p"), F.col("t"), 3))).first() == (0.5, 1.0)
    # k beyond the list still divides by k
    assert [r[0] for r in df.select(ranking.precision(F.col("p"), F.col("s"), 5)).collect()] == [0.4, 0.2]
    ap = [r[0] for r in df.select(ranking.average_precision(F.col("p"), F.col("s"), 3)).collect()]
    assert ap == pytest.approx([(1 / 2 + 2 / 3) / 2, 1 / 3])


def test_gini_with_ties_and_without_rows(spark):
    xs = [1, 1, 1, 5, 2, 2]
    n, total = len(xs), sum(xs)
    plain = sum((2 * i - n - 1) * x for i, x in enumerate(sorted(xs), 1)) / (n * total)
    df = spark.createDataFrame([(x,) for x in xs], "n int")
    assert statistics.gini(df, "n").first()["gini"] == pytest.approx(plain)
    assert statistics.gini(df.limit(0), "n").first()["gini"] == 0.0


def test_cluster_cohesion_of_one(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, embedding array<double>")
    assert values(similarity.cluster_cohesion(df), "label", "mean", "std") == [(0, 1.0, 0.0), (1, 0.0, 0.0)]


def test_scaler(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (None,)], "age double")
    found = [r.age_scaled for r in similarity.standardised(df, "age").collect()]
    assert found[1] == 0 and found[3] is None and found[2] == pytest.approx(10 / 8.16496580927726)
    same = spark.createDataFrame([(4.0,), (4.0,)], "age double")
    assert [r.age_scaled for r in similarity.standardised(same, "age").collect()] == [0.0, 0.0]


def test_texts(spark):
    def types_of(t):
        return one(spark, texts.personal_types(F.lit(t)))

    assert types_of("My phone is 13800138000.") == ["phone"]
    assert types_of("Contact admin@example.com for help.") == ["email"]
    assert types_of("Hello world.") == []
    assert one(spark, texts.redacted(F.lit("call 13800138000"))) == "call [PHONE_REDACTED]"
    assert one(spark, texts.toxic_by_words(F.lit("I hate you, you idiot."))) and not one(spark, texts.toxic_by_words(F.lit("I love rainbows.")))
    assert one(spark, texts.masked_phone(F.lit("123456"))) == "123456"
    assert one(spark, texts.masked_email(F.lit("a@b@c"))) == "a@b@c"
    assert one(spark, texts.stripped(F.lit("\t\n x y \r"))) == "x y"
    assert one(spark, texts.injection(F.lit("please Ignore Previous Instructions")))["confidence"] == 1.0
    assert one(spark, texts.noise_score(F.lit(""))) == 0.0


def test_as_of_join_takes_the_newest_before(spark):
    labels = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 9)], "id int, k string, ts int")
    history = spark.createDataFrame([("a", 5, 1.0), ("a", 8, 2.0), ("a", 11, 3.0)], "k string, ts int, f double")
    assert values(recommend.as_of_join(labels, history, "k", "ts", ["f"]), "id", "f") == [(1, 2.0), (2, 1.0), (3, None)]


def test_anti_join_with_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert a.join(b, "k", "left_anti").count() == 2


def test_merge_fills_by_priority_and_keeps_repeats(spark):
    first = spark.createDataFrame([(1, 10, 1.0)], "user_id int, item_id int, score double")
    second = spark.createDataFrame([(1, 10, 5.0), (1, 11, 4.0), (1, 12, 3.0)], "user_id int, item_id int, score double")
    found = recommend.merged([("a", first), ("b", second)], 3)
    assert values(found, "position", "item_id", "source") == [(1, 10, "b"), (2, 11, "b"), (3, 10, "a")]


def test_popular_for_users_skips_touched_items(spark):
    ranked = spark.createDataFrame([(i, i) for i in range(1, 8)], "item_id int, rank int")
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    touched = spark.createDataFrame([(1, 1), (1, 3)], "user_id int, item_id int")
    found = recommend.popular_for_users(users, touched, ranked, 3)
    assert values(found, "user_id", "rank", "item_id") == [(1, 1, 2), (1, 2, 4), (1, 3, 5), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_quality_report_takes_the_gravest_level(spark):
    rules = {"a": (F.col("x") > 0, "HIGH"), "b": (F.col("x") > -5, "MEDIUM")}
    df = spark.createDataFrame([(1,), (-1,), (-9,)], "x int")
    assert values(governance.quality_reports(df, rules, "x"), "x", "passed", "level") == [(-9, False, "HIGH"), (-1, False, "HIGH"), (1, True, "LOW")]


def test_lineage_depth_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    start = spark.createDataFrame([("c",)], "n string")
    assert values(governance.lineage(edges, start, 1), "node", "distance") == [("b", 1)]
    assert values(governance.lineage(edges, start, 5), "node", "distance") == [("a", 2), ("b", 1)]
    assert values(governance.lineage(edges, start, 5, up=False), "node", "distance") == [("a", 1), ("b", 2)]


def test_revoking(spark):
    grants = spark.createDataFrame([(1, "d", ["read", "write"]), (2, "d", ["admin"])], "user_id int, dataset string, permissions array<string>")
    assert values(governance.revoked(grants, 1, "d", ["read"]), "user_id", "permissions") == [(1, ["write"]), (2, ["admin"])]
    assert values(governance.revoked(grants, 1, "d"), "user_id") == [(2,)]


def test_alert_needs_its_windows_in_a_row(spark):
    m = spark.createDataFrame([(0, 0.1), (60, 0.1), (180, 0.1), (240, 0.9)], "start long, v double")
    assert values(alerts.sustained(m, F.col("v") < 0.5, 2, step=60), "start") == [(60,)]
    assert values(alerts.sustained(m, F.col("v") < 0.5, 2), "start") == [(60,), (180,)]


def test_store_upserts_and_stages(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, version int")
    assert values(files.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError):
        files.write(old, str(tmp_path / "x"), "tfrecord")
    calls = []
    for _ in range(2):
        files.stage(spark, str(tmp_path / "s"), lambda: calls.append(1) or old)
    assert len(calls) == 1


def test_messages_that_are_not_json(spark):
    df = spark.createDataFrame([("{broken",), ('{"event_id": 3}',)], "value string")
    assert values(kafka.deserialised(df).fillna(-1, ["event_id"]), "event_id") == [(-1,), (3,)]


def test_feature_time_to_live(spark):
    rows = [("user", 1, "f", 1.0, datetime.datetime(2024, 1, 1)), ("user", 1, "f", 2.0, datetime.datetime(2024, 1, 9)), ("user", 2, "g", 3.0, datetime.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, features.SCHEMA)
    assert values(features.online(df), "entity_id", "features") == [(1, {"f": 2.0}), (2, {"g": 3.0})]
    assert values(features.online(df, 7), "entity_id") == [(1,)]


def test_skip_grams_stay_in_their_window(spark):
    df = spark.createDataFrame([(1, [0, 1, 5, 6, 7, 8])], "k int, ids array<int>")
    pairs = set(values(catalogue.skip_grams(df, "k", "ids", 1, dynamic=False), "target", "context"))
    assert pairs == {(5, 6), (6, 5), (6, 7), (7, 6), (7, 8), (8, 7)}
    assert set(values(catalogue.skip_grams(df, "k", "ids", 3), "target", "context")) <= {(a, b) for a in range(5, 9) for b in range(5, 9) if a != b}


def test_operators_on_empty_tables(spark):
    empty = log(spark, [])
    for make in (sequences.user_sequences, sequences.sessions, statistics.item_stats, statistics.user_daily, recommend.cooccurrence, statistics.trending):
        assert make(empty).count() == 0


def test_draws_follow_the_shares_however_small(spark):
    n, draws = 2000, 60_000
    shares = spark.range(n).select(F.col("id").alias("candidate"), F.when(F.col("id") == 7, 0.0).otherwise(1.0 / (F.col("id") + 1)).alias("p"))
    laid = sequences.with_shares(shares, "candidate", "p")
    assert laid.count() == n - 1 and abs(laid.agg(F.sum(F.col("_to") - F.col("_from"))).first()[0] - 1) < 1e-9
    found = sequences.picked(spark.range(draws).withColumnRenamed("id", "draw"), laid, "draw").groupBy("candidate").count().collect()
    times = {r["candidate"]: r["count"] for r in found}
    total = sum(1 / (i + 1) for i in range(n) if i != 7)
    assert sum(times.values()) == draws and 7 not in times
    beyond = 0
    for i in range(n):
        p = 0 if i == 7 else 1 / (i + 1) / total
        beyond += abs(times.get(i, 0) - draws * p) > 3 * (draws * p * (1 - p)) ** 0.5 + 1
    assert beyond <= 0.01 * n


def test_negative_lists_are_full_where_the_pool_has_items(spark):
    touched = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 31), (3, 40), (3, 41)], "user_id long, item_id long")
    pool = spark.createDataFrame([(i, 0 if i == 39 else 1000 if i == 0 else 1) for i in range(40)], "item_id long, weight long")
    for weight, left in (("weight", 9), (None, 10)):
        found = sequences.negatives(touched, pool, 8, weight=weight, tries=1).collect()
        lists = {}
        for r in found:
            lists.setdefault((r.user_id, r.item_id), []).append(r.negative)
        assert len(lists) == 33 and all(len(v) == len(set(v)) == min(8, left) for v in lists.values())
        own = {(u, i) for u, i in touched.collect()}
        assert not any((u, n) in own for (u, _), v in lists.items() for n in v)
        assert weight is None or not any(39 in v for v in lists.values())
    few = sequences.negatives(touched, pool.filter("item_id < 32"), 8).filter("user_id = 1").collect()
    assert {r.negative for r in few} == {30, 31}


def test_array_sets_in_linear_time(spark):
    """The other array is worked out once a row; nulls as before."""
    import time

    from strandline.functions import arrays

    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(60_000)).alias("l")).localCheckpoint()
    other = F.transform(F.slice(F.transform("l", lambda x: x + 1), 1, 3), lambda x: x * 2)  # 4, 6, 8
    began = time.time()
    assert df.select(F.size(arrays.difference(F.col("l"), other)), arrays.intersection(F.col("l"), other)).first()[:] == (59_997, [4, 6, 8])
    assert time.time() - began < 20
    nulls = spark.createDataFrame([(None, [1]), ([1, None], [1]), ([1], None)], "a array<int>, b array<int>")
    got = nulls.select(arrays.difference(F.col("a"), F.col("b")).alias("d"), arrays.intersection(F.col("a"), F.col("b")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(None, None), ([], [1]), ([], [])]


def test_mean_vectors_hold_one_row_a_group(spark):
    """no row for each dimension, whatever is null or shorter."""
    rows = [(1, [1.0, 2.0, 3.0]), (1, [3.0, None, 5.0, 8.0]), (1, None), (2, [None, 4.0]), (3, None), (4, []), (None, [7.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    expected = {1: [2.0, 2.0, 4.0, 8.0], 2: [None, 4.0], None: [7.0]}
    for dims in (None, 4, 6):
        found = similarity.mean_vectors(df, "k", "v", dims)
        assert {r.k: r.v for r in found.collect()} == expected
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert similarity.mean_vectors(df.filter("k = 3"), "k", "v").collect() == []


def test_orders_are_told_apart_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """F16: the tasks that tell orders apart are as many as the lines ask for, and a repeated order or line counts once."""
    from strandline.plans import catalogue as plans

    spark.createDataFrame([(1, "b", "t"), (2, "c", "t")], "p_partkey int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "low"), (1, "low"), (2, "high"), (2, "low"), (None, "low")], "o_orderkey int, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (None, 1)], "l_orderkey int, l_partkey int")
    lines.selectExpr("*", "1 l_suppkey", "1D l_quantity", "1D l_discount", "'R' l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(plans, "TASK_LINES", 2, raising=False)
    found = plans.jo12_explode_join(spark, str(tmp_path))
    assert values(found, "director", "genre", "n") == [("b", "high", 1), ("b", "low", 2), ("c", "low", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 3), REPARTITION_BY_NUM" in plan


def test_draws_of_negatives_are_not_shuffled(spark):
    """users are shuffled, and what is drawn for them meets the pool and their items where it is drawn."""
    rows = [(1, 10), (1, 11), (1, None), (2, 10), (3, 12), (3, 13), (3, 14), (None, 10)]
    touched = spark.createDataFrame(rows, "user_id int, item_id int")
    pool = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14, None)], "item_id int").filter("item_id is not null")
    found = sequences.negatives(touched, pool, 3)
    got = {}
    for r in found.collect():
        got.setdefault((r.user_id, r.item_id), {})[r["rank"]] = r.negative
    own = {1: {10, 11}, 2: {10}, 3: {12, 13, 14}, None: set()}
    assert set(got) == set(rows)
    for (user, _), negatives in got.items():
        free = {10, 11, 12, 13, 14} - own[user]
        assert sorted(negatives) == list(range(1, min(3, len(free)) + 1)) and len(set(negatives.values())) == len(negatives) and set(negatives.values()) <= free
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert not any("item_id#" in s or s.startswith("_cell#") for s in shuffles)
