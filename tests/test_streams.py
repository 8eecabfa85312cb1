"""Streams over landed files: late rows, order of arrival, restarts."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.plans import storage
from strandline.sources import files
from strandline.streaming import stateful

SCHEMA = "event_id long, user_id long, action string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def land(spark, path, rows):
    spark.createDataFrame([(i, u, a, at(m)) for i, u, a, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def joined(spark, landed, path, late="10 minutes"):
    s = spark.readStream.schema(SCHEMA).parquet(landed)
    q = stateful.to_files(stateful.attributed(s.filter("action = 'view'"), s.filter("action = 'click'"), ["user_id"], late=late), path)
    q.awaitTermination()
    return q


def sessions(spark, landed, path):
    with stateful.with_rocksdb(spark):
        q = stateful.to_files(stateful.numbered_sessions(spark.readStream.schema(SCHEMA).parquet(landed)), path)
        q.awaitTermination()
    return q


def pairs(spark, path):
    return sorted((r.exposure_id, r.click_id or 0) for r in spark.read.parquet(f"{path}/rows").filter("exposure_id IS NOT NULL").collect())


def test_join_waits_for_the_watermark_of_both_sides(spark):
    landed, path = files.scratch(spark), files.scratch(spark)
    land(spark, landed, [(1, 7, "view", 0), (2, 7, "click", 29), (3, 7, "click", 30), (4, 8, "view", 5), (None, None, "view", 6), (5, None, "click", 6)])
    joined(spark, landed, path)
    assert pairs(spark, path) == [(1, 2)]  # a click on 4 may still come
    land(spark, landed, [(6, 8, "click", 34), (7, 9, "view", 300)])
    joined(spark, landed, path)
    assert pairs(spark, path) == [(1, 2), (4, 6)]
    land(spark, landed, [(8, 9, "click", 299)])
    joined(spark, landed, path)
    assert pairs(spark, path) == [(1, 2), (4, 6)]
    land(spark, landed, [(9, 1, "view", 1000), (10, 1, "click", 999)])
    joined(spark, landed, path)
    found = [(r.user_id, r.exposure_id, r.click_id) for r in spark.read.parquet(f"{path}/rows").collect()]
    assert sorted(found, key=str) == sorted([(7, 1, 2), (8, 4, 6), (9, 7, None), (None, None, None)], key=str)


def test_late_rows_are_dropped_and_counted(spark):
    for run, expected in ((joined, 2), (sessions, 2)):
        landed, path = files.scratch(spark), files.scratch(spark)
        land(spark, landed, [(1, 7, "view", 0), (2, 7, "click", 1), (3, 7, "view", 500), (4, 7, "click", 501)])
        assert stateful.dropped_late([run(spark, landed, path)]) == 0
        # two rows before the watermark, one within its delay
        land(spark, landed, [(5, 7, "view", 100), (6, 7, "click", 101), (7, 7, "click", 495)])
        again = run(spark, landed, path)
        assert stateful.dropped_late([again]) == expected
        land(spark, landed, [(8, 1, "view", 5000), (9, 1, "click", 4999)])
        run(spark, landed, path)
        rows = spark.read.parquet(f"{path}/rows")
        if run is joined:
            assert pairs(spark, path) == [(1, 2), (3, 4)]
        else:
            got = sorted((r.user_id, r.session, r.n, (r.end_us - r.start_us) // 60_000_000) for r in rows.collect())
            assert got == [(7, 1, 2, 1), (7, 2, 3, 6)]


@pytest.mark.parametrize("run", [joined, sessions])
def test_restart_repeats_nothing(spark, run):
    landed, path = files.scratch(spark), files.scratch(spark)
    land(spark, landed, [(1, 7, "view", 0), (2, 7, "click", 1), (3, 7, "view", 500), (4, 7, "click", 501)])
    for _ in range(3):
        run(spark, landed, path)
    land(spark, landed, [(8, 1, "view", 5000), (9, 1, "click", 4999)])
    for _ in range(2):
        run(spark, landed, path)
    assert spark.read.parquet(f"{path}/rows").count() == 2


def test_sessions_whatever_the_order(spark):
    """One open session is made of two when a row between them comes; a gap of exactly 30 minutes begins a new one."""
    landed, path = files.scratch(spark), files.scratch(spark)
    land(spark, landed, [(1, 7, "view", 0), (2, 7, "view", 35), (3, 7, "view", 65), (4, None, "view", 1)])
    sessions(spark, landed, path)
    assert spark.read.parquet(f"{path}/rows").count() == 1  # the first; 55 minutes have passed
    land(spark, landed, [(5, 7, "view", 64), (6, 8, "view", 60), (7, 8, "view", 89), (8, 8, "view", 119)])
    sessions(spark, landed, path)
    land(spark, landed, [(9, 9, "view", 9999)])
    sessions(spark, landed, path)
    got = sorted((r.user_id, r.session, r.n, r.start_us, r.end_us) for r in spark.read.parquet(f"{path}/rows").collect())
    us = [int((at(m) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for m in (0, 35, 65, 60, 89, 119)]
    assert got == [(7, 1, 1, us[0], us[0]), (7, 2, 3, us[1], us[2]), (8, 1, 2, us[3], us[4]), (8, 2, 1, us[5], us[5])]


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    with stateful.with_rocksdb(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKSDB
    assert spark.conf.get(stateful.PROVIDER, None) == before


def test_batch_join_gives_unmatched_at_once(spark):
    rows = spark.createDataFrame([(1, 7, "view", at(0)), (2, 7, "click", at(3)), (3, 8, "view", at(0))], SCHEMA)
    found = stateful.attributed(rows.filter("action = 'view'"), rows.filter("action = 'click'"), ["user_id"])
    assert sorted((r.exposure_id, r.click_id or 0) for r in found.collect()) == [(1, 2), (3, 0)]
    assert found.filter(F.col("click_id").isNotNull()).count() == 1


def test_sessions_send_few_messages_a_user():
    """Each look at the state or the timers is a message to the JVM: one read, one write and two for the timer a call, however many sessions are open."""
    sent, held, timers = [], {}, set()

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            sent.append("get")
            return held.get(self.name)

        def update(self, value):
            sent.append("update")
            held[self.name] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        def registerTimer(self, at):
            sent.append("register")
            timers.add(at)

        def deleteTimer(self, at):
            sent.append("delete")
            timers.discard(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 100

    one = stateful.OpenSessions(10_500)
    one.init(Handle())
    assert list(one.handleInputRows((7,), iter([Row(us=us) for us in (200_000, 0, 9_900, 20_400)]), Now())) == []
    assert timers == {20_400 // 1000 + 1} and len(sent) == 3  # (9,900 + 10,500) µs
    sent.clear()
    assert [tuple(r) for r in one.handleExpiredTimer((7,), Now(), None)] == [(7, 1, 0, 9_900, 2), (7, 2, 20_400, 20_400, 1)]
    assert timers == {211} and len(sent) == 4
    sent.clear()
    list(one.handleInputRows((7,), iter([Row(us=205_000), Row(us=195_000)]), Now()))
    assert timers == {216} and len(sent) == 4
    assert list(one.handleInputRows((None,), iter([Row(us=1)]), Now())) == [] and len(sent) == 4


def test_partitions_of_state_follow_the_rows_of_a_batch():
    assert [stateful.partitions_for(rows, 12, 600) for rows in (0, 1, 3_000_000, 3_000_001, 9_000_000, 10**9)] == [12, 12, 12, 24, 36, 600]
    assert stateful.partitions_for(9_000_000, 12, 8) == 8  # what the session asks for, even if there are more cores


def test_few_rows_are_not_dealt_to_all_partitions_of_the_session(spark, sf, monkeypatch):
    """Each partition writes its stores in every batch, so a stream of few rows takes long on many partitions."""
    begun, to_files = [], stateful.to_files
    monkeypatch.setattr(stateful, "to_files", lambda *a: begun.append(to_files(*a)) or begun[-1])
    before = spark.conf.get(stateful.PARTITIONS)
    spark.conf.set(stateful.PARTITIONS, "40")
    try:
        for query, found in ((storage.st12_stream_join, 188), (storage.st12_timed_sessions, 946)):
            begun.clear()
            assert query(spark, sf).count() == found
            assert {op.numShufflePartitions for q in begun for p in q.recentProgress for op in p.stateOperators} == {spark.sparkContext.defaultParallelism}
            assert spark.conf.get(stateful.PARTITIONS) == "40"
    finally:
        spark.conf.set(stateful.PARTITIONS, before)


def test_partitions_of_state_are_put_back_if_a_stream_fails(spark, sf):
    before = spark.conf.get(stateful.PARTITIONS)
    with pytest.raises(ValueError, match="stop"):
        for _ in storage._in_parts(spark, sf):
            raise ValueError("stop")
    assert spark.conf.get(stateful.PARTITIONS) == before
