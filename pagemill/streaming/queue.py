"""Streams: event-time windows, the durable job queue and online calibration.

Every job here runs with the available-now trigger too, which makes a stream's result that of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.operators.queueing import calibrated, folded
from pagemill.storage import own_folder

LEARNT = "stage string, log_factor double, spread double, n long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, watermark: str = "10 minutes") -> DataFrame:
    """Events with an event-time watermark."""
    rows = spark.readStream.schema(EVENTS).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; late events past the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def observe(state: tuple[float, float, int], predicted: float, actual: float) -> tuple[float, float, int]:
    """One observation folded into (log_factor, spread, n)."""
    if predicted <= 0 or actual <= 0:
        return state
    return folded(state, min(rules.MOST_LOG_RATIO, max(-rules.MOST_LOG_RATIO, math.log(actual / predicted))))


def calibrating(observations: DataFrame, folder: str):
    """The started query that keeps what stages have learnt in `folder`/state, a row a stage and trigger; a restart goes on from the last.

    observations: stage, ts, event_id, predicted, actual. Each trigger's observations are folded onto the state that the
    trigger before it left, as maps of blocks (`queueing.calibrated`); a trigger that is repeated writes the same again.
    """
    spark = observations.sparkSession

    def learn(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(f"{LEARNT}, trigger long").parquet(f"{folder}/state").where(F.col("trigger") == number - 1) if number else None
        calibrated(batch, ["ts", "event_id"], state).select(*[c.split()[0] for c in LEARNT.split(", ")]).write.mode("overwrite").parquet(f"{folder}/state/trigger={number}")

    return observations.writeStream.foreachBatch(learn).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def learnt(spark: SparkSession, folder: str) -> DataFrame:
    """stage, log_factor, spread and n after the last trigger."""
    rows = spark.read.schema(f"{LEARNT}, trigger long").parquet(f"{folder}/state")
    return rows.groupBy("stage").agg(F.max_by(F.struct("log_factor", "spread", "n"), "trigger").alias("s")).select("stage", "s.*")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark; the state of older keys is dropped."""
    return events.dropDuplicatesWithinWatermark(keys)


def matched(predictions: DataFrame, actuals: DataFrame, within: str) -> DataFrame:
    """predictions with what came of them: job, stage, predicted, at, actual and done; the last two null where a job wasn't done in time.

    predictions: job, stage, predicted, at. actuals: job, actual, done. Both have watermarks on their times, and a job is done
    `within` an interval of its prediction, so state on both sides is dropped behind the watermark; that is when a job that was never done is told.
    """
    p, a = predictions.alias("p"), actuals.withColumnRenamed("job", "done_job").alias("a")
    same = F.expr(f"p.job = a.done_job AND a.done >= p.at AND a.done <= p.at + INTERVAL {within}")
    return p.join(a, same, "leftOuter").select("job", "stage", "predicted", "at", "actual", "done")


def finished(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """The stream run over what is there now, with a checkpoint, as a stored table: all rows (append), those of the last trigger (complete), or every change (update).

    With a folder that an earlier run had, the stream goes on from where that one was.
    """
    spark = stream.sparkSession
    folder = folder or own_folder(spark)

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/trigger={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/trigger=*").select(*stream.columns)


def chained(source: DataFrame, first: str, second: str, hand_off: Callable[[DataFrame], DataFrame]) -> tuple[str, str]:
    """Two durable stages: rows land in the table `first`, and from there, as `hand_off` makes them, in `second`; each stage has its own checkpoint, so either goes on by itself after a restart."""
    spark = source.sparkSession
    spooled(source, f"{first}/rows", f"{first}/checkpoint").awaitTermination()
    again = spark.readStream.schema(source.schema).parquet(f"{first}/rows")
    spooled(hand_off(again), f"{second}/rows", f"{second}/checkpoint").awaitTermination()
    return f"{first}/rows", f"{second}/rows"


def spooled(stream: DataFrame, table: str, checkpoint: str):
    """A durable queue between two stages: rows land in a table with a checkpoint, and a restart goes on where it was."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
