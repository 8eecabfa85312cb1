"""Views that follow changes, sketches that are merged, vectors trained in strata."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import skipgram
from strandline.sources import files, views
from strandline.sources.tables import behaviours
from strandline.streaming import sketches

# ---- views


def partition_files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def local(path):
    return path.removeprefix("file:")


def totals(df):
    return {(r.day, r.action): (r.n, round(r.value, 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def events(spark, sf):
    return behaviours(spark, sf).select("event_id", "action", "value", F.floor(F.col("seconds") / 86400).cast("int").alias("day")).cache()


def test_view_equals_a_recompute_after_each_batch(spark, events):
    path = files.scratch(spark)
    view = views.SumView(spark, path, ["day", "action"], {"value": "value"})
    first = events.agg(F.min("day")).first()[0]
    alive = events.limit(0)
    for k in range(5):
        fresh = events.filter(F.col("event_id") % 5 == k)
        if k >= 3:  # two batches that touch some days only
            fresh = fresh.filter(F.col("day") < first + 4)
        gone = alive.filter((F.col("event_id") % 3 == 0) & ((F.col("day") == first + 1) | (F.lit(k) == 2)))
        before = partition_files(local(path)) if k else {}
        written = view.apply(fresh.withColumn("op", F.lit(1)).unionByName(gone.withColumn("op", F.lit(-1))), k + 1)
        alive = alive.join(gone.select("event_id"), "event_id", "left_anti").unionByName(fresh).cache()
        assert totals(view.read()) == totals(alive.groupBy("day", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))
        after = partition_files(local(path))
        names = {f"day={w}" for w in written}
        assert all((after[d] == before[d]) == (d not in names) for d in before)
        if k >= 3:
            assert 0 < len(names) < len(after)


def test_batch_applied_again_changes_nothing(spark):
    path = files.scratch(spark)
    view = views.SumView(spark, path, ["day", "action"], {"value": "value"})
    rows = spark.createDataFrame([(1, "a", 2.0, 1), (1, None, 3.0, 1), (2, "a", 4.0, 1)], "day int, action string, value double, op int")
    assert view.apply(rows, 1) == [1, 2]
    assert view.apply(rows, 1) == []
    assert totals(view.read()) == {(1, "a"): (1, 2.0), (1, None): (1, 3.0), (2, "a"): (1, 4.0)}
    # as if the run had failed between two partitions: day 2 has the batch already
    more = spark.createDataFrame([(2, "b", 1.0, 1)], rows.schema)
    assert view.apply(more, 2) == [2]
    assert view.apply(more.union(spark.createDataFrame([(1, "a", 2.0, -1)], rows.schema)), 2) == [1]
    assert totals(view.read()) == {(1, None): (1, 3.0), (2, "a"): (1, 4.0), (2, "b"): (1, 1.0)}
    # a day that loses everything keeps its version
    gone = spark.createDataFrame([(1, None, 3.0, -1)], rows.schema)
    assert view.apply(gone, 3) == [1] and view.apply(gone, 3) == []
    assert {r.day: r.version for r in view.versions().collect()} == {1: 3, 2: 2}
    assert totals(view.read()) == {(2, "a"): (1, 4.0), (2, "b"): (1, 1.0)}


# ---- sketches


def test_long_windows_from_short_ones(spark):
    """Ranks within 1 %, distinct keys within 3 %, for 1 h, 24 h and 30 d, of heavy values and many keys."""
    rows = spark.range(400_000).select(
        F.timestamp_seconds(1704067200 + F.col("id") * 30 * 86400 / 400_000).alias("ts"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1000).alias("value"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(150_000)).alias("user_id"),
        (F.col("id") % 2).alias("app"),
    )
    path = files.scratch(spark)
    sketches.sketched(rows, "value", "user_id", "app").write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * 24 * 30
    assert sketches.report(stored, "app").columns == ["app", "start", "end", "n", "distinct", "p50", "p90", "p95", "p99"]
    for seconds in (3600, 86400, 30 * 86400):
        found = sketches.report(sketches.merged(stored, seconds, "app"), "app").cache()
        keyed = rows.withColumn("s", F.unix_timestamp("ts")).withColumn("start", F.col("s") - F.pmod("s", F.lit(seconds)))
        exact = keyed.join(F.broadcast(found.drop("n")), ["app", "start"]).groupBy("app", "start").agg(
            F.count(F.lit(1)).alias("m"), F.count_distinct("user_id").alias("users"), *(F.avg((F.col("value") <= F.col(f"p{q}")).cast("double")).alias(f"r{q}") for q in (50, 90, 95, 99))
        )
        both = exact.join(found, ["app", "start"]).collect()
        assert len(both) == found.count() and all(r.m == r.n for r in both)
        assert all(abs(r.distinct - r.users) <= 0.03 * r.users for r in both) or seconds == 3600
        assert np.mean([abs(r.distinct - r.users) / r.users for r in both]) < 0.03
        # a rank may fall between two values of a small window
        assert all(abs(r[f"r{q}"] - q / 100) <= 0.01 + 1 / r.m for r in both for q in (50, 90, 95, 99))
        plan = sketches.merged(stored, seconds, "app")._jdf.queryExecution().toString()
        assert "ReadSchema: struct<app:bigint,start:bigint,n:bigint,values:binary,keys:binary>" in plan  # sketches only, no events


def test_nulls_in_sketches(spark):
    rows = spark.createDataFrame([(None, None), (1.0, 7), (3.0, 7), (2.0, None)], "value double, user_id long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    (r,) = sketches.report(sketches.sketched(rows, "value", "user_id"), quantiles=(0.5,)).collect()
    assert (r.start, r.end, r.n, r.distinct, r.p50) == (0, 3600, 4, 1, 2.0)


# ---- skip-gram


@pytest.fixture(scope="module")
def planted(spark):
    """Pairs within groups of three words, and some between any."""
    draw = np.random.default_rng(6)
    rows = []
    for _ in range(6000):
        g = int(draw.integers(0, 20))
        a, b = draw.choice(3, 2, replace=False)
        rows.append((f"g{g}w{a}", f"g{g}w{b}"))
        if draw.random() < 0.2:
            rows.append((f"g{draw.integers(0, 20)}w{draw.integers(0, 3)}", f"g{draw.integers(0, 20)}w{draw.integers(0, 3)}"))
    return skipgram.counted_pairs(spark.createDataFrame([*rows, (None, "x")], "center string, context string")).cache()


@pytest.mark.parametrize("blocks", [1, 4])
def test_planted_neighbours_rank_in_the_first_five(planted, blocks):
    vectors, losses = skipgram.train(planted, dims=16, rounds=8, blocks=blocks)
    rows = vectors.collect()
    assert len(rows) == 60 and all(len(r.vec) == 16 for r in rows)
    assert losses[-1] < 0.6 * losses[0] and all(b < a * 1.05 for a, b in zip(losses, losses[1:]))
    x = np.array([r.vec for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T - 2 * np.eye(len(x))
    inside = 0
    for i, r in enumerate(rows):
        best = [rows[j].word for j in np.argsort(-near[i])[:5]]
        inside += sum(w.split("w")[0] == r.word.split("w")[0] for w in best)
    assert inside >= 0.9 * 2 * len(rows)


def test_training_is_repeatable_and_holds_blocks_only(planted, monkeypatch):
    one, two = (sorted((r.word, tuple(r.vec)) for r in skipgram.train(planted.repartition(k), dims=4, rounds=1, blocks=3)[0].collect()) for k in (1, 5))
    assert one == two
    monkeypatch.setattr(skipgram, "BLOCK_WORDS", 20)
    _, losses = skipgram.train(planted, dims=4, rounds=1)
    assert len(losses) == 1
    none, losses = skipgram.train(planted.limit(0), dims=4, rounds=1)
    assert none.count() == 0 and losses == [0.0]
