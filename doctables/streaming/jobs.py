"""Incremental intake and job-state streams.

Events may come late by ``delay``. The stateful streams below keep them until the watermark has passed and only then apply them, in the
order of their time, so that their rows do not depend on how the input falls into batches.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from doctables.operators.jobs import ORPHAN, TERMINAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_documents(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process the files that arrived since the last run: read, transform, append as Parquet.

    Each batch goes to a folder of its own, so a batch that is run again replaces itself. Returns
    when all of them are done; a failed batch raises.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


class Replayed(StatefulProcessor):
    """Applies the events of a job in the order of their time, once the watermark has passed them.

    State: the events that wait, at most those of the last ``delay``, and one small row (``KNOWN``) per job. A job's ``deadline`` (the last
    field, microseconds, null: none) is a moment of its own, which comes before the events after it. A job has a timer for the earliest
    event that waits, not one for each: when it goes off, all that are ripe are applied, and the next one gets the timer.
    """

    KNOWN = "deadline long"
    COLUMNS: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the events of one arrival are one value, since every value is a message of its own
        self.waiting = handle.getListState("waiting", "events binary")
        self.known = handle.getValueState("known", self.KNOWN)

    def wanted(self, kind: str) -> bool:
        return True

    def event(self, key: str, known: tuple | None, us: int, kind: str, cost: float, calls: int) -> tuple[tuple | None, list[tuple]]:
        """What is known after an event, and the rows it gives."""
        raise NotImplementedError

    def due(self, key: str, known: tuple) -> tuple[tuple | None, list[tuple]]:
        """The same for the deadline."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            for us, kind, cost, calls in batch[["us", "kind", "cost", "calls"]].itertuples(index=False):
                if self.wanted(kind):
                    new.append((int(us), kind, None if pd.isna(cost) else float(cost), None if pd.isna(calls) else int(calls)))
        if new:
            self.waiting.appendList([(pickle.dumps(new),)])
            self.handle.registerTimer(min(us for us, *_ in new) // 1000 + 1)
        yield from ()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Stored rows are events of their time."""
        for _ in self.handleInputRows(key, iter([initialState]), timerValues):
            pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        arrived = [e for (some,) in self.waiting.get() for e in pickle.loads(some)] if self.waiting.exists() else []
        waiting = sorted(arrived, key=lambda e: tuple((x is not None, x) for x in e))
        ripe = [e for e in waiting if e[0] // 1000 < passed]
        known = tuple(self.known.get()) if self.known.exists() else None
        before, out = known, []

        def reach(us: int) -> None:
            nonlocal known
            if known is not None and known[-1] is not None and known[-1] <= us:
                known, rows = self.due(key[0], known)
                out.extend(rows)
        for e in ripe:
            reach(e[0])
            known, rows = self.event(key[0], known, *e)
            out.extend(rows)
        reach(passed * 1000 - 1)
        if ripe:
            if rest := waiting[len(ripe):]:
                self.waiting.put([(pickle.dumps(rest),)])
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
        if known != before:
            self.known.update(known) if known is not None else self.known.clear()
            if known is not None and known[-1] is not None:
                self.handle.registerTimer(known[-1] // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def replayed(events: DataFrame, processor: Replayed, out: str, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """Run a processor over ``events (job_id, ts, kind, cost, calls)``; ``initial`` has the same columns."""
    def shaped(df: DataFrame) -> DataFrame:
        return df.select("job_id", "ts", F.unix_micros("ts").alias("us"), "kind", F.col("cost").cast("double").alias("cost"), F.col("calls").cast("long").alias("calls"))
    state = None if initial is None else shaped(initial).drop("ts").groupBy("job_id")
    return shaped(events).withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime", initialState=state)


FINISHED_COLUMNS = "job_id string, status string, ts timestamp, cost double, calls bigint"


def stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us", tz="UTC")


class FirstFinish(Replayed):
    """The first terminal event of each job; a flag per job keeps later ones out until ``expiry_us`` after it."""

    KNOWN = "counted boolean, deadline long"
    COLUMNS = ("job_id", "status", "ts", "cost", "calls")

    def __init__(self, expiry_us: int | None):
        self.expiry_us = expiry_us

    def wanted(self, kind):
        return kind in TERMINAL

    def event(self, key, known, us, kind, cost, calls):
        if known is not None:
            return known, []
        return (True, None if self.expiry_us is None else us + self.expiry_us), [(key, kind, stamp(us), cost, calls)]

    def due(self, key, known):
        return None, []


def stream_finished_jobs(events: DataFrame, delay: str = "1 hour", expiry_days: int | None = None) -> DataFrame:
    """One row per job, for the event with which it first became terminal.

    ``events`` is a stream of (job_id, ts, status, cost, calls). A repeat never counts again, however late it comes, unless
    ``expiry_days`` bound the state: then a job is forgotten so many days after it finished. The session must use
    the RocksDB state store (see :func:`rocksdb`).
    """
    expiry = None if expiry_days is None else expiry_days * 86_400_000_000
    return replayed(events.withColumnRenamed("status", "kind"), FirstFinish(expiry), FINISHED_COLUMNS, delay)


def count_finished(finished: DataFrame) -> DataFrame:
    """The five counters over the rows of :func:`stream_finished_jobs`."""
    return finished.groupBy().agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("successful"), F.count_if(F.col("status") == "error").alias("failed"),
        F.coalesce(F.sum(F.col("cost").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("total_cost"), F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"))


STATE_COLUMNS = "job_id string, state string, ts timestamp"
READ = "read"


class JobState(Replayed):
    """Latest status per job; a finished job that is read goes ``ttl_ms`` after its first read."""

    KNOWN = "status string, deadline long"
    COLUMNS = ("job_id", "state", "ts")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def event(self, key, known, us, kind, cost, calls):
        status, deadline = known or (None, None)
        if kind == READ:
            if status in TERMINAL and deadline is None:
                return (status, us + self.ttl_ms * 1000), []
            return known, []
        return (kind, deadline), [(key, kind, stamp(us))]

    def due(self, key, known):
        return None, [(key, "expired", stamp(known[-1]))]


def stream_job_state(events: DataFrame, reads: DataFrame, ttl_ms: int = 120_000, delay: str = "10 seconds") -> DataFrame:
    """Status rows of jobs, and an ``expired`` row ``ttl_ms`` after a finished job was first read.

    ``events (job_id, ts, status)`` and ``reads (job_id, ts)`` are two streams. Reads of unfinished or unknown jobs change nothing; a job that
    was read goes at its time even if its status changes in between. A status after that starts a job anew. Rows come once the
    watermark (``delay`` behind the latest event of both) has passed them. Needs the RocksDB state store (see :func:`rocksdb`).
    """
    nothing = [F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("calls")]
    both = events.select("job_id", "ts", F.col("status").alias("kind"), *nothing).unionByName(reads.select("job_id", "ts", F.lit(READ).alias("kind"), *nothing))
    return replayed(both, JobState(ttl_ms), STATE_COLUMNS, delay)


ORPHAN_COLUMNS = "job_id string, status string, error string, created_at timestamp, completed_at timestamp"


class Orphans(Replayed):
    """Jobs that are still in progress ``timeout_us`` after they were created."""

    KNOWN = "created long, deadline long"
    COLUMNS = ("job_id", "status", "error", "created_at", "completed_at")

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def event(self, key, known, us, kind, cost, calls):
        if kind in TERMINAL:
            return None, []
        return known or (us, us + self.timeout_us), []

    def due(self, key, known):
        return None, [(key, "error", ORPHAN, stamp(known[0]), stamp(known[-1]))]


def stream_orphans(events: DataFrame, jobs: DataFrame | None = None, timeout_ms: int = 3_600_000, delay: str = "10 seconds") -> DataFrame:
    """An error row for each job that has not finished ``timeout_ms`` after its creation, by timers on event time.

    ``events (job_id, ts, status)`` is a stream; a job's first event that is not terminal creates it, a terminal one ends its timer.
    ``jobs`` (the same columns, one row per stored job, with the time of its creation) is the state to begin with. At any watermark the rows
    are those that ``jobs.mark_orphans`` marks with a cutoff of the watermark less the timeout. Needs the RocksDB state store.
    """
    nothing = [F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("calls")]
    shaped = [df if df is None else df.select("job_id", "ts", F.col("status").alias("kind"), *nothing) for df in (events, jobs)]
    return replayed(shaped[0], Orphans(timeout_ms * 1000), ORPHAN_COLUMNS, delay, shaped[1])


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start stateful queries in here: they keep the RocksDB state store, the session its own setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def job_events(stream: DataFrame) -> DataFrame:
    """Job events from a stream of user events with a time-zone free ``ts``."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("in-progress")
    return stream.select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"),
                         (F.col("value") / 1000).alias("cost"), F.lit(1).alias("calls"))
