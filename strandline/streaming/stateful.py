"""Streams with state: joins of two streams within a time range, and sessions closed by timers.

Both run over landed files with the same results whatever the batches, as long as rows arrive within the watermark's delay. Rows that
come later are dropped; `dropped_late` reads their number from a query's progress.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
STATE_ROWS = 250_000

EXPOSED = ("exposure_id", "exposed_at")
CLICKED = ("click_id", "clicked_at")
SESSION = "user_id long, session long, start_us long, end_us long, n long"


def attributed(exposures: DataFrame, clicks: DataFrame, on: list[str], within: str = "30 minutes", late: str = "10 minutes", id_: str = "event_id", ts: str = "ts") -> DataFrame:
    """(on, exposure_id, exposed_at, click_id, clicked_at): each exposure with every click on it within a time.

    An exposure without one comes out with nulls: in a stream once the watermark of both sides has passed its time range, so that no click
    can follow; in a batch at once. The time range bounds what either side keeps. Keys that are null match nothing.
    """

    def side(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        stamped = df.select(*on, F.col(id_).alias(names[0]), F.col(ts).cast("timestamp").alias(names[1]))
        return stamped.withWatermark(names[1], late) if df.isStreaming else stamped

    e, c = side(exposures, EXPOSED).alias("e"), side(clicks, CLICKED).alias("c")
    same = [F.col(f"e.{k}") == F.col(f"c.{k}") for k in on]
    after = F.expr(f"c.clicked_at >= e.exposed_at AND c.clicked_at < e.exposed_at + INTERVAL {within}")
    joined = e.join(c, [*same, after], "left_outer")
    return joined.select(*(F.col(f"e.{k}") for k in on), *EXPOSED, *CLICKED)


class OpenSessions(StatefulProcessor):
    """Sessions of one user: those still open, the number of those closed, and a timer for the one to close next.

    Rows of a batch come in any order, and a late one may join two open sessions to one, so all that the watermark hasn't passed are kept.
    All is one value, and the timer is noted in it: each look at the state is a message to the JVM, and users come by the million.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "closed long, timer long, start_us array<long>, end_us array<long>, n array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] is None:
            return  # rows without a user only move the watermark on
        closed, timer, spans = self._read()
        merged: list[tuple[int, int, int]] = []
        for start, end, n in sorted([*spans, *((r["us"], r["us"], 1) for r in rows)]):
            # a span begins a session if it is `gap` or more after all that begin before it
            if merged and start - merged[-1][1] < self.gap:
                first, last, count = merged[-1]
                merged[-1] = (first, max(last, end), count + n)
            else:
                merged.append((start, end, n))
        self._keep(closed, timer, merged)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        closed, timer, spans = self._read()
        over = [s for s in spans if s[1] + self.gap <= passed]
        self._keep(closed + len(over), timer, spans[len(over) :])
        for i, (start, end, n) in enumerate(over, 1):
            yield Row(user_id=key[0], session=closed + i, start_us=start, end_us=end, n=n)

    def _read(self) -> tuple[int, int | None, list[tuple[int, int, int]]]:
        found = self.state.get()
        return (0, None, []) if found is None else (found[0], found[1], list(zip(*found[2:5], strict=True)))

    def _keep(self, closed: int, timer: int | None, spans: list[tuple[int, int, int]]) -> None:
        wanted = (min(s[1] for s in spans) + self.gap) // 1000 + 1 if spans else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        starts, ends, counts = ([s[k] for s in spans] for k in range(3))
        self.state.update((closed, wanted, starts, ends, counts))

    def close(self) -> None:
        pass


def numbered_sessions(events: DataFrame, gap: timedelta = timedelta(minutes=30), late: str = "10 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user_id, session, start_us, end_us, n) of a stream: each user's sessions, numbered from 1, when the watermark has closed them.

    A gap of exactly `gap` begins a new session. Needs the RocksDB state store, see `with_rocksdb`.
    """
    stamped = events.select(F.col(user).cast("long").alias("user_id"), F.col(ts).cast("timestamp").alias("t")).withWatermark("t", late)
    rows = stamped.select("user_id", "t", F.unix_micros("t").alias("us"))
    return rows.groupBy("user_id").transformWithState(
        OpenSessions(int(gap.total_seconds() * 1_000_000)), outputStructType=SESSION, outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, on the executors' disks and in the checkpoint; the setting is put back afterwards."""
    with _held(spark, PROVIDER, ROCKSDB):
        yield


def partitions_for(rows: int, cores: int, most: int) -> int:
    """Partitions of state for batches of so many rows: STATE_ROWS each at most, as many for each core, so that all cores end together, but no more than `most`."""
    return min(most, cores * max(1, -(-rows // (STATE_ROWS * cores))))


@contextmanager
def with_partitions(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries first started within deal their state to partitions by the rows of a batch; the setting is put back afterwards.

    In every batch each partition opens, cleans and writes its stores, four of them for a join, even if it gets no row. Started again, a query
    keeps the number that is in its checkpoint.
    """
    most = int(spark.conf.get(PARTITIONS))
    with _held(spark, PARTITIONS, str(partitions_for(rows, spark.sparkContext.defaultParallelism, most))):
        yield


def to_files(stream: DataFrame, path: str) -> StreamingQuery:
    """Appends a stream's rows to Parquet under path/rows, until what has landed is read. Offsets and state are in path/offsets.

    Started again, it goes on where it ended: the sink's log keeps a batch that runs twice from being read twice.
    """
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets")
    return writer.outputMode("append").trigger(availableNow=True).start()


def dropped_late(queries: Iterable[StreamingQuery]) -> int:
    """Rows that came later than the watermark, over all batches that the queries report."""
    return sum(op.numRowsDroppedByWatermark for q in queries for p in q.recentProgress for op in p.stateOperators)
