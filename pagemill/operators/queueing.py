"""Queues, estimates and calibration as windows and folds."""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.functions import rules
from pagemill.operators import scans
from pagemill.operators.scans import running
from pagemill.storage import stored

def replayed(jobs: DataFrame, queue: list[str], arrival: str, service: str, order: list[str], prefix: str = "", doubles: bool = False) -> DataFrame:
    """jobs with start, finish and wait in one-worker FIFO queues, by windows alone.

    With S the running sum of service, a job ends at S_n + max over k <= n of (arrival_k - S_(k-1)); both run in spans.
    Fractions are summed as decimals, so an end doesn't hang on where spans begin; with `doubles` as doubles in the order
    of `scans.summed`, for what hangs on their last bits.
    """
    kind, rows = dict(jobs.dtypes)[service], scans.spanned(jobs, queue, order)
    if doubles:
        rows = scans.summed(rows, queue, order, F.col(service), "_done")
    elif kind in ("double", "float"):
        rows = running(rows, queue, order, F.sum, F.col(service).cast("decimal(30,12)"), "_done").withColumn("_done", F.col("_done").cast("double"))
    else:
        rows = running(rows, queue, order, F.sum, F.col(service), "_done")
    rows = rows.withColumn("_slack", F.col(arrival) - (F.col("_done") - F.col(service)))
    rows = running(rows, queue, order, F.max, F.col("_slack"), "_most")
    finish = F.col("_done") + F.col("_most")
    return rows.withColumn(f"{prefix}finish", finish).withColumn(f"{prefix}start", F.col(f"{prefix}finish") - F.col(service)).withColumn(f"{prefix}wait", F.col(f"{prefix}start") - F.col(arrival)).drop("_done", "_slack", "_most", "_span")


def ahead(jobs: DataFrame, queue: list[str], arrival: str, finish: str, service: str, order: list[str]) -> DataFrame:
    """jobs with seconds_ahead: what is left of the work that arrived before."""
    rows = running(jobs, queue, order, F.max, F.col(finish), "_last", inclusive=False)
    return rows.withColumn("seconds_ahead", F.greatest(F.lit(0.0), F.coalesce("_last", F.col(arrival)) - F.col(arrival))).drop("_last")


def jobs_ahead(jobs: DataFrame, queue: list[str], arrival: str, finish: str, order: list[str], name: str = "jobs_ahead") -> DataFrame:
    """jobs with the number of those before it that aren't done when it arrives.

    In a queue of one worker finishes come in order, so the jobs done by a time are counted by one running sum over
    arrivals and finishes together: a finish at the very time of an arrival counts as done.
    """
    # each job is two rows, and its own columns go along with the one that asks: nothing is joined back, so null keys and repeated rows stay as they are
    job = F.struct(*[F.col(c) for c in jobs.columns])
    keep = [F.col(c) for c in dict.fromkeys([*queue, *order])]
    asks = jobs.select(*keep, job.alias("_job"), F.col(arrival).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(1).alias("_step"))
    ends = jobs.select(*keep, F.when(F.lit(False), job).alias("_job"), F.col(finish).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_step"))
    both = running(asks.unionByName(ends), queue, ["_at", "_kind", *order], F.sum, F.col("_step"), "_open")
    return both.where("_kind = 1").select("_job.*", (F.col("_open") - 1).cast("long").alias(name))


def estimated(kind: Column, text_chars: Column, ocr_pages: Column, budget: int, chunk: int) -> Column:
    """struct<kind, chars, ocr_pages, branch, ocr_seconds, summarize_seconds, audio_seconds>: raw predictions of a job."""
    pages = F.when(kind == "image", 1).when(kind == "pdf", ocr_pages).otherwise(0).cast("long")
    chars = F.when(kind == "image", F.lit(rules.OCR_CHARS_PER_PAGE)).when(kind == "pdf", text_chars + pages * rules.OCR_CHARS_PER_PAGE).otherwise(F.lit(budget)).cast("long")
    single = chars <= budget
    summarize = F.when(single, rules.SINGLE_BASE_S + chars * rules.SINGLE_S_PER_CHAR).otherwise((F.ceil(chars / F.lit(chunk)) + 1) * rules.CHUNK_S)
    return F.struct(
        kind.alias("kind"), chars.alias("chars"), pages.alias("ocr_pages"), F.when(single, "summarize_single").otherwise("summarize_map").alias("branch"),
        (pages * rules.OCR_PAGE_S).alias("ocr_seconds"), summarize.cast("double").alias("summarize_seconds"), (chars * F.lit(rules.AUDIO_S_PER_CHAR)).alias("audio_seconds"),
    )


def folded(state: tuple[float, float, int], ratio: float) -> tuple[float, float, int]:
    """The plain form of what `calibrated` does, one observation: the mean moves fast at first, then with a fixed share; spread follows once there is a mean."""
    mean, spread, n = state
    share, off = max(rules.ALPHA, 1 / (n + 1)), ratio - mean
    return mean + share * off, spread + share * (abs(off) - spread) if n else spread, n + 1


def teaches(stage: Column, predicted: Column, attempt: Column, ocr_pages: Column, skipped: Column) -> Column:
    """Whether a completion may teach its stage: first attempts only; OCR where pages were read by it and none was skipped; where a time was predicted at all."""
    first = (attempt == 0) & (predicted > 0)
    return F.coalesce(F.when(stage == "ocr", first & (ocr_pages > 0) & ~skipped).when(stage == "audio", predicted > 0).when(stage.isin(rules.STAGES), first), F.lit(False))


def log_ratio(predicted: Column, actual: Column) -> Column:
    """The clamped log of actual over predicted; null where the observation teaches nothing."""
    r = F.ln(F.when((predicted > 0) & (actual > 0), actual / predicted))
    return F.when(r.isNotNull(), F.greatest(F.lit(-rules.MOST_LOG_RATIO), F.least(F.lit(rules.MOST_LOG_RATIO), r)))


def clamped(log_factor: Column) -> Column:
    return F.greatest(F.lit(rules.FACTOR_MIN), F.least(F.lit(rules.FACTOR_MAX), F.exp(log_factor)))


def calibrated(observations: DataFrame, order: list[str], state: DataFrame | None = None) -> DataFrame:
    """stage, log_factor, spread, n, factor and upper after all observations, in order. observations: stage, predicted, actual.

    state: stage, log_factor, spread, n learnt before, one row a stage; those that nothing new is known of stay.

    An observation maps the mean by m -> (1 - a) m + a r and, the means known, the spread by s -> (1 - a) s + a |r - m|.
    Such maps compose (`scans`), so blocks of observations are made into maps apart: once for the means, once more for the spreads.
    """
    spark = observations.sparkSession
    rows = observations.where(F.col("stage").isin(rules.STAGES)).withColumn("r", log_ratio(F.col("predicted"), F.col("actual"))).where("r is not null")
    before = (state if state is not None else spark.createDataFrame([], "stage string, log_factor double, spread double, n long")).select("stage", "log_factor", "spread", F.col("n").alias("n0"))
    blocks = scans.blocks(rows.select("stage", *order, "r"), "stage", [*order, "r"], "r").join(F.broadcast(before.select("stage", "n0")), "stage", "left")  # a row for each stage
    seen = lambda o: F.coalesce("n0", F.lit(0)) + o["n"]
    share = lambda o: F.greatest(F.lit(rules.ALPHA), 1 / (seen(o) + 1).cast("double"))
    start = lambda column: before.select("stage", F.col(column).alias("x"))

    def step(m: Column, o: Column) -> Column:
        return F.struct((m["a"] * (1 - share(o))).alias("a"), (m["b"] * (1 - share(o)) + share(o) * o["value"]).alias("b"))

    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    means = blocks.select("stage", "block", F.aggregate("items", one, step).alias("m")).select("stage", "block", "m.*")
    mean_at, mean = scans.stops(means, "stage", "block", start("log_factor"))

    def spread_step(m: Column, o: Column) -> Column:
        off, first = o["value"] - m["mean"], seen(o) == 0
        a, b = m["a"] * (1 - share(o)), m["b"] * (1 - share(o)) + share(o) * F.abs(off)
        return F.struct((m["mean"] + share(o) * off).alias("mean"), F.when(first, m["a"]).otherwise(a).alias("a"), F.when(first, m["b"]).otherwise(b).alias("b"))

    known = blocks.join(mean_at.withColumnRenamed("x", "mean"), ["stage", "block"])
    begin = F.struct("mean", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    spreads = known.select("stage", "block", F.aggregate("items", begin, spread_step).alias("m")).select("stage", "block", "m.a", "m.b")
    _, spread = scans.stops(spreads, "stage", "block", start("spread"))

    counts = blocks.groupBy("stage").agg(F.sum(F.size("items")).alias("new"))
    new = counts.join(mean.withColumnRenamed("x", "log_factor"), "stage").join(spread.withColumnRenamed("x", "spread"), "stage").join(before.select("stage", "n0"), "stage", "left")
    new = new.select("stage", "log_factor", "spread", (F.coalesce("n0", F.lit(0)) + F.col("new")).cast("long").alias("n"))
    old = before.join(new, "stage", "left_anti").select("stage", "log_factor", "spread", F.col("n0").alias("n"))
    return learned(stored(new.unionByName(old), "learned"))


def learned(state: DataFrame) -> DataFrame:
    """stage, log_factor, spread, n with the factors of expecting and of quoting."""
    return state.select("stage", "log_factor", "spread", "n", clamped(F.col("log_factor")).alias("factor"), clamped(F.col("log_factor") + rules.SPREAD_K * F.col("spread")).alias("upper"))


def quoted(jobs: DataFrame, factors: DataFrame, audio_on: Column) -> DataFrame:
    """jobs with summary_at and audio_at, seconds from now: each stage's raw seconds by its quoting factor (1 for a stage that has learnt nothing).

    jobs: branch, ocr_seconds, summarize_seconds, audio_seconds, seconds_ahead, audio_ahead. Audio starts when the summary
    is done or the audio queue has drained, whichever is later; without audio audio_at is null.
    """
    known = factors.where(F.col("stage").isin(rules.STAGES)).agg(F.map_from_entries(F.collect_list(F.struct("stage", "upper"))).alias("m")).scalar()  # four stages
    upper = lambda stage: F.coalesce(F.try_element_at(F.col("_upper"), stage), F.lit(1.0))
    rows = jobs.withColumn("_upper", known)
    summary = F.col("seconds_ahead") + F.col("ocr_seconds") * upper(F.lit("ocr")) + F.col("summarize_seconds") * upper(F.col("branch"))
    rows = rows.withColumn("summary_at", summary)
    audio = F.greatest(F.col("summary_at"), F.col("audio_ahead")) + F.col("audio_seconds") * upper(F.lit("audio"))
    return rows.withColumn("audio_at", F.when(audio_on, audio)).drop("_upper")


def clock(now: Column, seconds: Column, zone: Column, default_zone: str = "UTC") -> Column:
    """HH:MM in the reader's zone, with the day when it rolls over. now: timestamp."""
    # a zone that isn't one is the default's
    zones = F.array(*map(F.lit, sorted(zoneinfo.available_timezones())))
    known = F.when(F.array_contains(zones, zone), zone).otherwise(default_zone)
    here = F.convert_timezone(F.lit("UTC"), known, now.cast("timestamp_ntz"))
    then = F.convert_timezone(F.lit("UTC"), known, (now + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz"))
    return F.concat(F.date_format(then, "HH:mm"), F.when(F.to_date(then) != F.to_date(here), " tomorrow").otherwise(""))


def resolved_settings(layers: DataFrame, users: DataFrame) -> DataFrame:
    """user, key, value and layer: a user's own value over the shared one over the environment's over the default.

    layers: layer (default, env, shared, user), user (null but for user), key, value. Keys that chat may not set count
    only from default and env.
    """
    rank = F.when(F.col("layer") == "user", 4).when(F.col("layer") == "shared", 3).when(F.col("layer") == "env", 2).when(F.col("layer") == "default", 1)
    allowed = F.col("layer").isin("default", "env") | F.col("key").isin(rules.ALLOWED_KEYS)
    ranked = layers.where(allowed).withColumn("rank", rank)
    common = ranked.where("layer <> 'user'").groupBy("key").agg(F.max(F.struct("rank", "layer", "value")).alias("best"))
    own = ranked.where("layer = 'user'").groupBy("user", "key").agg(F.max(F.struct("rank", "layer", "value")).alias("own"))
    # every user has every shared setting, which is one value for all: the settings of an installation as an array
    shared = common.agg(F.collect_list(F.struct("key", F.col("best.layer").alias("layer"), F.col("best.value").alias("value")))).scalar()
    every = users.select("user", F.explode(shared).alias("s")).select("user", "s.key", F.lit(0).alias("rank"), "s.layer", "s.value")
    mine = own.join(users.select("user").distinct(), "user", "left_semi").select("user", "key", F.lit(1).alias("rank"), F.col("own.layer").alias("layer"), F.col("own.value").alias("value"))
    best = every.unionByName(mine).groupBy("user", "key").agg(F.max(F.struct("rank", "layer", "value")).alias("best"))
    return best.select("user", "key", "best.value", "best.layer")


def settings_upsert(layers: DataFrame, commands: DataFrame) -> DataFrame:
    """layers after chat commands: the last one for a user (null: everyone) and a key replaces that layer's row; an empty value removes it.

    commands: ts, user, key, value. Keys that chat may not set are left out.
    """
    wanted = commands.where(F.col("key").isin(rules.ALLOWED_KEYS)).groupBy("user", "key").agg(F.max(F.struct("ts", "value")).alias("last"))
    new = wanted.select(F.when(F.col("user").isNull(), "shared").otherwise("user").alias("layer"), "user", "key", F.col("last.value").alias("value"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("layer", "user", "key")]
    kept = layers.select("layer", "user", "key", "value").alias("a").join(new.alias("b"), same, "left_anti")
    return kept.unionByName(new.where(F.col("value") != ""))


def handed_off(jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """Jobs handed from the first stage to the second, each with the settings its sender had then, frozen in `overrides`.

    jobs: job, user, handed (time). settings: user, key, value, since (time from which it holds). An as-of join as one
    window: of each user's and key's settings the last that isn't later than the hand-off.
    """
    keys = jobs.select("job", "user", "handed", F.explode(F.array(*map(F.lit, rules.FROZEN_KEYS))).alias("key"))
    marks = settings.where(F.col("key").isin(rules.FROZEN_KEYS)).select("user", "key", F.col("since").alias("at"), F.lit(0).alias("kind"), F.col("value").alias("mark"), F.lit(None).cast(dict(jobs.dtypes)["job"]).alias("job"))
    asks = keys.select("user", "key", F.col("handed").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("mark"), "job")
    last = F.last("mark", ignorenulls=True).over(Window.partitionBy("user", "key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.unionByName(asks).withColumn("value", last).where("kind = 1 AND value IS NOT NULL")
    frozen = found.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("overrides"))
    return jobs.join(frozen, "job", "left").withColumn("overrides", F.coalesce("overrides", F.create_map().cast("map<string,string>")))


def restart_order(summaries: DataFrame, audio: DataFrame) -> DataFrame:
    """position, stage, id: what a restart takes up again, audio first and each by id (ids sort as jobs came)."""
    both = audio.select(F.lit(0).alias("first"), F.lit("audio").alias("stage"), "id").union(summaries.select(F.lit(1), F.lit("summarize"), "id"))
    return both.orderBy("first", "id").select("stage", "id")


def canceled(jobs: DataFrame, cancels: DataFrame, thread: list[str]) -> DataFrame:
    """jobs with canceled: whether a cancel came from its thread while it was waiting or running.

    jobs: thread, job, added, done (null: still open). cancels: thread, ts. A job counts as long as any half of it is open,
    so its rows (halves) are joined first: open from the first added to the last done.
    """
    whole = jobs.groupBy(*thread, "job").agg(F.min("added").alias("added"), F.when(F.count("*") == F.count("done"), F.max("done")).alias("done"))
    marks = cancels.select(*thread, F.col("ts").alias("at"), F.lit(0).alias("kind"), F.col("ts").alias("mark"), F.lit(None).cast(dict(jobs.dtypes)["job"]).alias("job"), F.lit(None).cast(dict(jobs.dtypes)["done"]).alias("done"))
    asks = whole.select(*thread, F.col("added").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(cancels.dtypes)["ts"]).alias("mark"), "job", "done")
    after = F.first("mark", ignorenulls=True).over(Window.partitionBy(*thread).orderBy("at", F.desc("kind")).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = marks.unionByName(asks).withColumn("next", after).where("kind = 1")
    return found.select(*thread, "job", F.coalesce(F.col("next").isNotNull() & (F.col("done").isNull() | (F.col("next") < F.col("done"))), F.lit(False)).alias("canceled"))


def retried(attempts: DataFrame, most: int = 3) -> DataFrame:
    """attempts with outcome. attempts: job, attempt (from 0), error (null, transient, input, crash).

    A transient failure goes to the back of the queue while attempts are left; input errors and crashes end a job.
    """
    e = F.col("error")
    return attempts.withColumn("outcome", F.when(e.isNull(), "done").when((e == "transient") & (F.col("attempt") + 1 < most), "requeued").when(e == "transient", "gave up").when(e == "input", "rejected").otherwise("crashed"))


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A span's rows in order with `_done`, the running sum of service in their queue, and `_most`, the running maximum of arrival less the service before."""
    none = np.iinfo(np.int64).min
    queue, done, most = None, 0, none
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column("queue"))
        served, arrival = b.column("service"), b.column("arrival")
        service = pc.fill_null(served, 0).to_numpy()
        known = pc.and_(pc.is_valid(served), pc.is_valid(arrival)).to_numpy(zero_copy_only=False)
        at, sums, highs, begin = pc.fill_null(arrival, 0).to_numpy(), np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64), 0
        for end, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            if name != queue:
                queue, done, most = name, 0, none
            part = slice(begin, end)
            sums[part] = done + np.cumsum(service[part])
            slack = np.where(known[part], at[part] - (sums[part] - service[part]), none)
            highs[part] = np.maximum(np.maximum.accumulate(slack), most)
            done, most, begin = int(sums[end - 1]), int(highs[end - 1]), end
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums), pa.array(highs, mask=highs == none)], [*b.schema.names, "_done", "_most"])


def _finished(rows: DataFrame) -> DataFrame:
    """rows (queue, arrival, attempt, job, service, failures) with finish, as `replayed` has it, for whole numbers: rows are dealt out once, and written once.

    Both scans run in one pass over each range of (queue, order). A range hands on when its queue is free, so a finish is
    `_done + max(_most, free)`; the ranges' totals are a small table.
    """
    order = ["queue", "arrival", "attempt", "job"]
    dealt = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*order).withColumn("_span", F.spark_partition_id())
    local = stored(dealt.mapInArrow(_served, T.StructType([*dealt.schema.fields, T.StructField("_done", T.LongType()), T.StructField("_most", T.LongType())])), "served")
    spans = local.groupBy("queue", "_span").agg(F.coalesce(F.sum("service"), F.lit(0)).alias("_total"), F.max("_most").alias("_high"))
    before = Window.partitionBy("queue").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_sum", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    spans = stored(spans.select("queue", "_span", (F.max(F.col("_high") - F.col("_sum")).over(before) + F.col("_sum")).alias("_free")), "free")
    met = local.alias("r").join(spans.alias("s"), F.col("r.queue").eqNullSafe(F.col("s.queue")) & (F.col("r._span") == F.col("s._span")))
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._done") + F.greatest("r._most", "s._free")).alias("finish"))


def replayed_with_retries(jobs: DataFrame, queue: str, most: int = 3) -> DataFrame:
    """job, queue, attempt (from 0), arrival, start, finish and outcome of every attempt in one-worker FIFO queues where a job that fails goes to the back.

    jobs: job, queue, arrival, service (whole numbers of one unit, so that all sums are exact) and failures, how many of its
    attempts fail for a passing reason. An attempt that fails while another is left arrives anew at its own finish, which moves all that
    is served after it: when it arrives is known only from a replay that it is part of. So the queues are replayed again and again, each time
    with the arrivals that the last replay gave, until they are those it was made with. Of equal arrivals first attempts go
    first, then those of the smaller job.

    A round settles at least all attempts up to the first whose arrival was wrong; as an arrival hangs only on attempts
    that were finished before it, there are about as many rounds as a busy time holds waits. In a round each attempt is shuffled once: its row
    carries its job, so the next attempt is made from it. Sums of hashes tell that arrivals have moved; where they are equal, the rows are compared.
    """
    c = F.col
    first = jobs.select("job", c(queue).alias("queue"), F.lit(0).alias("attempt"), c("arrival").cast("long").alias("arrival"), c("service").cast("long").alias("service"), "failures")
    rows = first = stored(first, "first")
    fails = (c("attempt") < c("failures")) & (c("attempt") + 1 < most)
    total = lambda of, *columns: F.struct(F.count(F.when(of, 1)), F.sum(F.when(of, F.xxhash64(*columns).cast("decimal(20,0)"))))
    while True:
        done = _finished(rows)
        again = done.where(fails).select("job", "queue", (c("attempt") + 1).alias("attempt"), c("finish").alias("arrival"), "service", "failures")
        made, met = done.agg(total(fails, "job", "queue", c("attempt") + 1, "finish"), total(c("attempt") > 0, "job", "queue", "attempt", "arrival")).first()
        key = ["job", "queue", "attempt", "arrival"]
        if made == met and again.select(key).exceptAll(done.where("attempt > 0").select(key)).isEmpty():
            break
        rows = first.unionByName(again)
    outcome = F.when(c("attempt") >= c("failures"), "done").when(c("attempt") + 1 < most, "requeued").otherwise("gave up")
    return done.select("job", c("queue").alias(queue), "attempt", "arrival", (c("finish") - c("service")).alias("start"), "finish", outcome.alias("outcome"))
