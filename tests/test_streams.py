"""Event-time streams: the same rows for any batching, timers like the batch form, settings left alone."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from doctables.operators import jobs
from doctables.session import scratch_path
from doctables.streaming import jobs as ST

START = dt.datetime(2024, 5, 1)
SCHEMA = "job_id string, ts timestamp, status string, cost double, calls int"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def source(spark, batches, schema=SCHEMA):
    """A stream that reads one file per micro-batch."""
    path = scratch_path(spark, "inbox")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(spark, df):
    out = scratch_path(spark, "rows")
    with ST.rocksdb(spark):
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect())


def lifecycle(rng, n=60):
    """Events with times that go forward but for a few seconds."""
    return [(f"j{rng.randrange(6)}", at(i * 20 + rng.randrange(8)), rng.choice(["in-progress", "in-progress", "done", "error"]), rng.randrange(9) / 4, 1) for i in range(n)]


@pytest.fixture(scope="module")
def events():
    return lifecycle(random.Random(3))


def test_counters_do_not_depend_on_batches(spark, events):
    late = [("j0", at(1100), "done", 9.0, 1)]  # a repeat, long after the first
    one = rows_of(spark, ST.stream_finished_jobs(source(spark, [events + late]), "10 seconds"))
    many = rows_of(spark, ST.stream_finished_jobs(source(spark, [events[:20], events[20:30], events[30:], late]), "10 seconds"))
    assert one == many and len({r[0] for r in one}) == len(one) > 3
    first = {}
    for job, ts, status, cost, calls in sorted(events, key=lambda e: (e[1], e[2])):
        if status != "in-progress" and ts < max(e[1] for e in events) - dt.timedelta(seconds=10):
            first.setdefault(job, (job, status, ts, cost, calls))
    assert one == sorted(first.values())


def test_flags_go_after_their_expiry(spark):
    day = 86_400
    rows = [[("a", at(0), "done", 1.0, 1)], [("a", at(day), "done", 1.0, 1)], [("a", at(3 * day), "error", 1.0, 1)], [("b", at(4 * day), "done", 1.0, 1)], [("c", at(5 * day), "done", 1.0, 1)]]
    got = rows_of(spark, ST.stream_finished_jobs(source(spark, rows), "1 second", expiry_days=2))
    assert [(r[0], r[1]) for r in got] == [("a", "done"), ("a", "error"), ("b", "done")]


def test_expiry_starts_at_the_read(spark, events):
    reads = [("j1", at(900)), ("j2", at(905)), ("nobody", at(906)), ("j3", at(100)), ("j3", at(1000)), ("j1", at(910))]
    end = [("end", at(9999), "in-progress", 0.0, 1)]
    kind = "job_id string, ts timestamp"
    whole = rows_of(spark, ST.stream_job_state(source(spark, [events, end]), source(spark, [reads], kind), 60_000, "1500 seconds"))
    parts = rows_of(spark, ST.stream_job_state(source(spark, [events[:25], events[25:], end]), source(spark, [reads[:3], reads[3:]], kind), 60_000, "1500 seconds"))
    assert whole == parts
    state, want, deadline = {}, [], {}
    for ts, kind, job in sorted([(ts, s, j) for j, ts, s, *_ in events] + [(ts, "read", j) for j, ts in reads]):
        if job in deadline and deadline[job] <= ts:
            want.append((job, "expired", deadline.pop(job)))
            state.pop(job, None)
        if kind != "read":
            state[job] = kind
            want.append((job, kind, ts))
        elif state.get(job) in ("done", "error"):
            deadline.setdefault(job, ts + dt.timedelta(seconds=60))
    want += [(j, "expired", d) for j, d in deadline.items()]
    assert whole == sorted(want) and any(r[1] == "expired" for r in whole)


def test_orphans_like_the_batch_form(spark):
    """Jobs with one life each; at the watermark the rows are those of ``mark_orphans``."""
    rng = random.Random(1)
    stored = [(f"s{i}", at(-rng.randrange(4000)), rng.choice(["in-progress", "done"])) for i in range(20)]
    new = [(f"n{i}", at(rng.randrange(3000)), "in-progress", 0.0, 1) for i in range(30)]
    ends = [(j, ts + dt.timedelta(seconds=rng.randrange(1, 5000)), "done", 0.0, 1) for j, ts, s, *_ in [*new[::2], *[x for x in stored[::3] if x[2] == "in-progress"]]]
    stream = sorted([*new, *[e for e in ends if at(0) <= e[1]]], key=lambda e: e[1]) + [("end", at(9000), "done", 0.0, 1)]
    known = spark.createDataFrame(stored, "job_id string, ts timestamp, status string")
    timeout, watermark = 1_000_000, at(9000 - 10)
    got = rows_of(spark, ST.stream_orphans(source(spark, [stream[:20], stream[20:]]), known, timeout))
    finished = {j: ts for j, ts, s, *_ in stream if s == "done"}
    life = [(j, ts, s) for j, ts, s, *_ in [*stored, *new]]
    # the state of the job table at a watermark: finished unless the end comes after the time-out
    table = spark.createDataFrame([(j, int(ts.timestamp() * 1000), "done" if s == "done" or (j in finished and finished[j] < ts + dt.timedelta(seconds=1000)) else "in-progress") for j, ts, s in life],
                                  "id string, created_at long, status string")
    cutoff = int((watermark - dt.timedelta(seconds=1000)).timestamp() * 1000)
    marked = {r.id for r in jobs.mark_orphans(table, cutoff).where(F.col("error").isNotNull()).collect()}
    assert {r[0] for r in got} == marked and len(marked) > 5
    assert all(r[1] == "error" and r[2] == jobs.ORPHAN and r[4] - r[3] == dt.timedelta(seconds=1000) for r in got)


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with ST.rocksdb(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ST.ROCKSDB
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Handle:
    """State of one key in memory, and the timers that were asked for."""

    def __init__(self):
        self.timers, self.states = [], {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)


class Kept:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = list(value)

    update = put

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def clear(self):
        self.value = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_one_timer_for_all_events_of_a_job():
    job = ST.JobState(1000)
    job.init(Handle())
    events = pd.DataFrame([(i * 10_000, "done" if i % 2 else "error", None, None) for i in range(500)], columns=["us", "kind", "cost", "calls"])
    assert list(job.handleInputRows(("j",), iter([events]), Clock(0))) == []
    assert job.handle.timers == [1]
    first = pd.concat(job.handleExpiredTimer(("j",), Clock(2001), None))
    assert len(first) == 201 and job.handle.timers == [1, 2011]
    rest = pd.concat(job.handleExpiredTimer(("j",), Clock(9000), None))
    assert len(rest) == 299 and job.handle.timers == [1, 2011] and not job.waiting.exists()
