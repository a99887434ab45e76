"""Cancelling as state: which jobs of a thread are under way, how often each, and what a cancel in the thread stops.

Events: thread, job, kind (add, done, cancel), at (event time), seq (orders events of one time). Adds are counted, for a
job that is queued again is added before its failed run is done: a job is under way from its first add until as many are done. A
cancel stops the jobs of its thread that are under way then; a job that comes back later starts anew.

State is kept by thread (`transformWithState`) as one list: a job's events until its life is over, and the thread's cancels as long as a life
that is open may still be stopped by them. A thread has one timer, so a trigger reads its list once, whatever it holds. What comes late within the watermark counts in its place, for a life is only
told when the watermark has passed the minute of its end; one that doesn't end is given up after `expiry`.
"""

from __future__ import annotations

import bisect
import contextlib
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from pagemill.operators.scans import running

LIVES = "thread string, job string, added timestamp, ended timestamp, canceled_at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Event = tuple[int, int, int]  # micros, seq, 1 for an add and -1 for a done


def told(events: list[Event], marks: list[tuple[int, int]], upto: int, expiry: int) -> tuple[list[tuple[int, int | None, int | None]], list[Event]]:
    """The lives (added, ended, first cancel) of one job that are over by `upto` or have been open for `expiry`, and the events that stay. marks: in order."""
    lives: list[tuple[int, int | None, int | None]] = []
    count, life, later = 0, [], []

    def close(end: tuple[int, int] | None) -> None:
        hit = bisect.bisect_right(marks, life[0][:2])  # the first after the begin
        stops = hit < len(marks) and marks[hit] < (end or (life[0][0] + expiry, 0))
        lives.append((life[0][0], end and end[0], marks[hit][0] if stops else None))

    for at, seq, step in sorted(events):
        if at > upto:
            later.append((at, seq, step))
        elif life or step > 0:  # else a done before it was added: nothing was under way
            life.append((at, seq, step))
            count += step
            if not count:
                close((at, seq))
                life = []
    if life and not later and life[0][0] + expiry <= upto:
        close(None)
        life = []
    return lives, life + later


class _Threads(StatefulProcessor):
    def __init__(self, expiry_s: int) -> None:
        self.expiry = expiry_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "job string, at bigint, seq bigint, step int")  # step 0: a cancel

    def _wake(self, at: int) -> None:
        """A thread has one timer, at the first minute after which something may be over: to the minute, after it."""
        due, old = (at // 60_000_000 + 1) * 60_000, list(self.handle.listTimers())
        if not old or due < min(old):
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, new = {"add": 1, "done": -1, "cancel": 0}, []
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64").tolist()
            new += [(job if steps[kind] else None, a, s, steps[kind]) for job, a, s, kind in zip(part["job"], at, part["seq"].tolist(), part["kind"], strict=True) if kind in steps]
        if new:
            self.events.appendList(new)
        times = [a for _, a, _, step in new if step]
        if times:
            self._wake(min(times))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // 60_000 * 60_000_000 - 1  # whole minutes, as timers are
        jobs: dict[str, list[Event]] = {}
        marks: list[tuple[int, int]] = []
        for job, at, seq, step in self.events.get():
            jobs.setdefault(job, []).append((at, seq, step)) if step else marks.append((at, seq))
        marks.sort()
        out, kept, first, times = [], [], upto, []
        for job, events in jobs.items():
            lives, rest = told(events, marks, upto, self.expiry)
            out += [(job, *life) for life in lives]
            if rest:
                first = min(first, rest[0][0])
                kept += [(job, *e) for e in rest]
                times += [t for t in (*(e[0] for e in rest), rest[0][0] + self.expiry) if t > upto]
        kept += [(None, *m, 0) for m in marks if m[0] >= first]  # older ones stop nothing any more
        self.events.put(kept) if kept else self.events.clear()
        for t in self.handle.listTimers():  # this one and what it makes needless
            self.handle.deleteTimer(t)
        if times:
            self._wake(min(times))
        time = lambda us: None if us is None else datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
        ends = [pd.Series([time(x[i]) for x in out], dtype="datetime64[us]") for i in (1, 2, 3)]
        if out:
            yield pd.DataFrame({"thread": pd.Series([key[0]] * len(out), dtype=object), "job": pd.Series([x[0] for x in out], dtype=object), "added": ends[0], "ended": ends[1], "canceled_at": ends[2]})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lives_stream(events: DataFrame, expiry: datetime.timedelta = datetime.timedelta(days=7)) -> DataFrame:
    """`LIVES` of jobs as they end. events: a stream with a watermark on `at`. Has to be started within `state_store`."""
    rows = events.select(F.col("thread").cast("string").alias("thread"), F.col("job").cast("string").alias("job"), "kind", "at", F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("thread").transformWithStateInPandas(statefulProcessor=_Threads(int(expiry.total_seconds())), outputStructType=LIVES, outputMode="Append", timeMode="EventTime")


def lives(events: DataFrame) -> DataFrame:
    """The same of a table, every life that ends in it: running counts, and an as-of window over lives and cancels. No expiry."""
    step = F.when(F.col("kind") == "add", 1).when(F.col("kind") == "done", -1)
    rows = events.select(F.col("thread").cast("string").alias("thread"), F.col("job").cast("string").alias("job"), "kind", "at", F.col("seq").cast("long").alias("seq"))
    own = rows.where("kind in ('add', 'done')").withColumn("step", step)
    # a done that finds nothing under way counts for nothing: the count is the sum less its least value so far, where that is negative
    by = Window.partitionBy("thread", "job").orderBy("at", "seq")
    total = F.sum("step").over(by)
    own = own.withColumn("total", total).withColumn("low", F.least(F.lit(0), F.min("total").over(by)))
    own = own.withColumn("count", F.col("total") - F.col("low"))
    earlier = F.coalesce(F.lag("count").over(by), F.lit(0))
    own = own.withColumn("life", F.sum(F.when((earlier == 0) & (F.col("step") > 0), 1).otherwise(0)).over(by)).where("life > 0")
    when = F.struct("at", "seq")
    ended = F.min(F.when((F.col("count") == 0) & (F.col("step") < 0), when))
    found = own.groupBy("thread", "job", "life").agg(F.min(when).alias("first"), ended.alias("last")).where("last is not null")
    marks = rows.where("kind = 'cancel'").select("thread", F.struct("at", "seq").alias("place"), F.lit(None).cast("string").alias("job"), F.lit(None).cast("long").alias("life"), F.struct("at", "seq").alias("last"), F.lit(True).alias("mark"))
    asks = found.select("thread", F.col("first").alias("place"), "job", F.col("life").cast("long").alias("life"), "last", F.lit(False).alias("mark"))
    # of the cancels after a life's begin the first one: the least that follows, over spans of the thread (`running`, from the end backwards)
    back = marks.unionByName(asks).withColumn("_back", -F.unix_micros(F.col("place.at"))).withColumn("_seq", -F.col("place.seq"))
    key = F.when(F.col("mark"), F.struct((-F.unix_micros(F.col("place.at"))).alias("at"), (-F.col("place.seq")).alias("seq")))
    found = running(back, ["thread"], ["_back", "_seq"], F.max, key, "_next").where("NOT mark")
    hit = F.struct(F.timestamp_micros(-F.col("_next.at")).alias("at"), (-F.col("_next.seq")).alias("seq"))
    return found.select("thread", "job", F.col("place.at").alias("added"), F.col("last.at").alias("ended"), F.when(F.col("_next").isNotNull() & (hit < F.col("last")), hit["at"]).alias("canceled_at"))
