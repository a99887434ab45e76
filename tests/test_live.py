"""Streams that are stopped and go on, retries and scans, against plain loops."""

import datetime
import heapq
import math
import random
from unittest import mock

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import queueing, scans
from pagemill.streaming import cancels
from pagemill.streaming import queue as streams

@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as there are partitions, instead of one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


# --- calibration ---------------------------------------------------------------------------------

OBSERVATION = "stage string, ts timestamp, event_id long, predicted double, actual double"


def observations(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["ocr", "audio", "audio", "nothing"]), at(rng.randrange(50)), i, rng.choice([0.0, 5.0, 90.0]), rng.uniform(0.1, 900)) for i in range(n)]


def learnt(rows, states=None):
    states = dict(states or {})
    for stage, _, _, predicted, actual in sorted(rows, key=lambda r: r[1:3]):
        if stage != "nothing":
            states[stage] = streams.observe(states.get(stage, (0.0, 0.0, 0)), predicted, actual)
    return {k: v for k, v in states.items() if v[2]}


def same(got, want):
    found = {r.stage: (r.log_factor, r.spread, r.n) for r in got}
    assert found.keys() == want.keys()
    for stage, (mean, spread, n) in want.items():
        assert found[stage][2] == n and math.isclose(found[stage][0], mean, abs_tol=1e-9) and math.isclose(found[stage][1], spread, abs_tol=1e-9)


@pytest.mark.parametrize("block", [3, 4096])
def test_calibration_as_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    first, second = observations(150, 1), [r for r in observations(40, 2) if r[0] != "ocr"]
    got = queueing.calibrated(spark.createDataFrame(first, OBSERVATION), ["ts", "event_id"])
    same(got.collect(), learnt(first))
    again = queueing.calibrated(spark.createDataFrame(second, OBSERVATION), ["ts", "event_id"], got)
    same(again.collect(), learnt(second, learnt(first)))
    same(queueing.calibrated(spark.createDataFrame([], OBSERVATION), ["ts"], got).collect(), learnt(first))
    assert queueing.calibrated(spark.createDataFrame([], OBSERVATION), ["ts"]).collect() == []


def test_calibration_goes_on_after_a_restart(spark, tmp_path):
    parts = [observations(30, i) for i in range(3)]
    states = {}
    for part in parts:
        spark.createDataFrame(part, OBSERVATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.calibrating(spark.readStream.schema(OBSERVATION).parquet(f"{tmp_path}/in"), str(tmp_path)).awaitTermination()
        states = learnt(part, states)
        same(streams.learnt(spark, str(tmp_path)).collect(), states)


# --- cancels -------------------------------------------------------------------------------------

MARK = "thread string, job string, kind string, at timestamp, seq long"


def plain_lives(rows, upto=None, expiry=None):
    """Events one by one, as a tracker with a count for each job would see them."""
    counts, begun, hits, out = {}, {}, {}, []
    for thread, job, kind, when, seq in sorted(rows, key=lambda r: r[3:]):
        if kind == "cancel":
            for k in counts:
                if k[0] == thread:
                    hits.setdefault(k, when)
        elif kind == "add":
            counts[thread, job] = counts.get((thread, job), 0) + 1
            begun.setdefault((thread, job), when)
        elif (thread, job) in counts:
            counts[thread, job] -= 1
            if not counts[thread, job]:
                del counts[thread, job]
                out.append((thread, job, begun.pop((thread, job)), when, hits.pop((thread, job), None)))
    return out


def marks(seed, n=160):
    rng = random.Random(seed)
    return [(rng.choice("uv"), None if kind == "cancel" else rng.choice("abcd"), kind, at(rng.randrange(300)), i) for i in range(n) for kind in [rng.choice(["add", "add", "done", "done", "cancel"])]]


def test_lives_of_a_table(spark):
    rows = marks(4)
    got = [tuple(r) for r in cancels.lives(spark.createDataFrame(rows, MARK)).collect()]
    assert sorted(got, key=str) == sorted(plain_lives(rows), key=str) and sum(r[4] is not None for r in got) > 5


def test_cancels_across_a_restart(spark, tmp_path):
    rows = sorted(marks(7), key=lambda r: r[3:])
    late = rows.pop(40)  # comes with the second half, but within the watermark
    halves = [rows[:80], [late, *rows[80:], ("z", "end", "add", at(10_000), 999)]]
    out = None
    for half in halves:
        spark.createDataFrame(half, MARK).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(MARK).parquet(f"{tmp_path}/in").withWatermark("at", "4 hours")
        with cancels.state_store(spark):
            out = streams.finished(cancels.lives_stream(stream, datetime.timedelta(days=3)), "append", str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    ended, given_up = [r for r in got if r[3]], [r for r in got if not r[3]]
    assert sorted(ended, key=str) == sorted(plain_lives(sum(halves, [])), key=str)
    assert {r[:2] for r in given_up}.isdisjoint({("z", "end")}) and len(given_up) > 0


class Held:
    """What a stateful processor is handed: one list and the timers of a thread."""

    def __init__(self):
        self.rows, self.timers, self.reads = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_thread_has_one_timer():
    """A trigger reads a thread once, not once a minute in which something happens."""
    held, threads = Held(), cancels._Threads(3 * 86_400)
    threads.init(held)
    rows = [(str(i), kind, at(10 * i + j), 2 * i + j) for i in range(100) for j, kind in enumerate(["add", "done"])]
    threads.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["job", "kind", "at", "seq"])]), None)
    assert len(held.timers) == 1
    now = mock.Mock(getCurrentWatermarkInMs=lambda: int(at(505).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))
    [told] = threads.handleExpiredTimer(("u",), now, None)
    assert sorted(map(int, told["job"])) == list(range(51)) and held.reads == 1 and len(held.timers) == 1 and len(held.rows) == 98


# --- predictions ---------------------------------------------------------------------------------


def test_predictions_meet_actuals(spark, tmp_path):
    predicted = [(i, "ocr", float(i), at(i)) for i in range(60)]
    actual = [(i, i * 2.0, at(i + i % 50)) for i in range(60) if i % 4] + [(999, 1.0, at(5)), (8, 1.0, at(8 + 31))]
    spark.createDataFrame(predicted + [(1000, "ocr", 1.0, at(5000))], "job long, stage string, predicted double, at timestamp").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(actual + [(1001, 1.0, at(5000))], "job long, actual double, done timestamp").write.parquet(f"{tmp_path}/a")
    p = spark.readStream.schema("job long, stage string, predicted double, at timestamp").parquet(f"{tmp_path}/p").withWatermark("at", "1 hour")
    a = spark.readStream.schema("job long, actual double, done timestamp").parquet(f"{tmp_path}/a").withWatermark("done", "1 hour")
    got = {r.job: r.actual for r in streams.finished(streams.matched(p, a, "30 MINUTES"), "append").collect()}
    assert got == {i: i * 2.0 if i % 4 and i % 50 <= 30 else None for i in range(60)}


# --- retries -------------------------------------------------------------------------------------


def plain_retries(jobs, most):
    """One worker a queue; a heap of who waits."""
    out = set()
    for queue in {j[1] for j in jobs}:
        waiting, free = [(a, 0, i, s, f) for i, q, a, s, f in jobs if q == queue], 0
        heapq.heapify(waiting)
        while waiting:
            arrival, attempt, job, service, failures = heapq.heappop(waiting)
            start = max(free, arrival)
            free = start + service
            outcome = "done" if attempt >= failures else "requeued" if attempt + 1 < most else "gave up"
            out.add((job, queue, attempt, arrival, start, free, outcome))
            if outcome == "requeued":
                heapq.heappush(waiting, (free, attempt + 1, job, service, failures))
    return out


@pytest.mark.parametrize("load", [5, 40, 400])
def test_retries_go_to_the_back(spark, load):
    rng = random.Random(load)
    jobs = [(i, rng.choice(["a", "b", "b"]), rng.randrange(4000), rng.randrange(1, load), rng.choice([0, 0, 0, 1, 2, 5])) for i in range(120)]
    got = queueing.replayed_with_retries(spark.createDataFrame(jobs, "job long, queue string, arrival long, service long, failures int"), "queue")
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == plain_retries(jobs, 3) and len(rows) == len(set(rows))
    assert queueing.replayed_with_retries(spark.createDataFrame([], "job long, queue string, arrival long, service long, failures int"), "queue").collect() == []


def test_retries_of_jobs_of_one_number(spark):
    rng = random.Random(7)
    jobs = [(i, queue, rng.randrange(4000), rng.randrange(1, 90), rng.choice([0, 0, 1, 2, 5])) for i in range(60) for queue in ("a", "b", None)]
    got = queueing.replayed_with_retries(spark.createDataFrame(jobs, "job long, queue string, arrival long, service long, failures int"), "queue")
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == plain_retries(jobs, 3) and len(rows) == len(set(rows))


def test_spans_are_served_over_batches():
    """Running sums and maxima go on from batch to batch, begin anew with each queue, and leave out what isn't known."""
    rows = [("a", 5, 3), ("a", 6, 4), (None, 1, 2), (None, None, 2), (None, 9, None), ("c", None, 1), ("c", 30, 1)]
    batch = pa.RecordBatch.from_pydict({"queue": [r[0] for r in rows], "arrival": pa.array([r[1] for r in rows], pa.int64()), "service": pa.array([r[2] for r in rows], pa.int64())})
    want = [(3, 5), (7, 5), (2, 1), (4, 1), (4, 1), (1, None), (2, 29)]
    for size in (1, 2, 3, 7):
        got = pa.Table.from_batches(queueing._served(batch.slice(i, size) for i in range(0, len(rows), size)))
        assert list(zip(got["_done"].to_pylist(), got["_most"].to_pylist())) == want


def test_scans_of_null_keys_and_ties(spark):
    rows = [(i % 3 or None, 7, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, o int, i int")
    got = {r.i: r.n for r in scans.numbered(df, ["k"], ["o", "i"], "n").collect()}
    assert got == {i: sum(1 for k, _, j in rows if k == rows[i][0] and j < i) for i in range(40)}
    spans = scans.spanned(df, ["k"], ["o", "i"]).groupBy("_span").count().collect()
    assert len(spans) > 2
