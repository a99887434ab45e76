"""Spooled records, transcripts, shelves: JSON in, bad records dropped instead of failing the read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.sinks.files import write_files
from pagemill.storage import stored

JOB = "id string, channel string, thread_ts string, target string, source_label string, attachment string, attachment_name string, user string, attempts int"
NEEDED = ["id", "channel", "thread_ts", "target", "source_label"]
TRANSCRIPT = "start double, end double, text string"


def jobs(spark: SparkSession, path: str, pattern: str = "*.json", schema: str = JOB) -> DataFrame:
    """Records; one that isn't JSON, lacks a needed field or has an unknown one is dropped. Their ids sort as they came: order where order matters."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    names = [c.split()[0] for c in schema.split(", ")]
    keys = F.json_object_keys("value")
    good = keys.isNotNull() & F.forall(keys, lambda k: k.isin(names)) & (F.size(F.array_except(F.array(*map(F.lit, NEEDED)), keys)) == 0)
    parsed = raw.where(good).select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed.withColumn("attempts", F.coalesce("attempts", F.lit(0))).where("id is not null")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSONL transcript; blank and malformed lines are skipped."""
    return spark.read.schema(TRANSCRIPT).option("mode", "DROPMALFORMED").json(path)


def item_detail(body: Column) -> Column:
    """struct<title, description, cover_path, chapters> of an item's JSON; what is missing is empty."""
    item = F.from_json(body, "media struct<metadata: struct<title: string, description: string>, coverPath: string, chapters: array<struct<title: string>>>")
    some = lambda c: F.coalesce(c, F.lit(""))
    meta = item["media"]["metadata"]
    chapters = F.coalesce(F.transform(item["media"]["chapters"], lambda c: some(c["title"])), F.array().cast("array<string>"))
    return F.struct(some(meta["title"]).alias("title"), some(meta["description"]).alias("description"), some(item["media"]["coverPath"]).alias("cover_path"), chapters.alias("chapters"))


def write_jobs(jobs: DataFrame, path: str) -> DataFrame:
    """Each job as a record of its own, <id>.json: all of them, or none where the write fails. name and outcome of each."""
    return write_files(jobs.select(F.concat("id", F.lit(".json")).alias("name"), F.to_json(F.struct(*jobs.columns)).cast("binary").alias("content")), path)


def completed(jobs: DataFrame, path: str) -> DataFrame:
    """Remove what jobs that are done have in the spool at `path`: records, page caches and attachments. Safe to repeat.

    jobs: id, and attachment where there are such columns. A row for each file: id, file, outcome (removed, or gone already). The work is
    done by the tasks, when this is called.
    """
    attachment = F.col("attachment") if "attachment" in jobs.columns else F.lit(None).cast("string")
    names = F.array(*[F.concat(F.lit(path.rstrip("/") + "/"), "id", F.lit(s)) for s in (".json", ".pages")], attachment)
    files = jobs.select("id", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for file in b.column(1).to_pylist():
                store, where = fs.FileSystem.from_uri(file)
                try:
                    store.delete_file(where)
                    told.append("removed")
                except FileNotFoundError:
                    told.append("gone")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], ["id", "file", "outcome"])

    return stored(files.mapInArrow(run, "id string, file string, outcome string"), "completed")


def job_id(epoch_ns: Column, suffix: Column) -> Column:
    """Nineteen digits of time and eight signs: ids sort as jobs came."""
    return F.concat(F.lpad(epoch_ns.cast("string"), 19, "0"), F.lit("-"), suffix)


class PagedSource(DataSource):
    """Rows of a paged listing: `fetch` (a module-level function's import path) takes a page number and returns JSON rows and the total."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id string, title string, series string, narrator string, tags array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.where, self.size = options["fetch"], int(options.get("page_size", "100"))

    def _fetch(self) -> Callable[[int, int], tuple[list[dict], int]]:
        module, _, name = self.where.rpartition(".")
        return getattr(__import__(module, fromlist=[name]), name)

    def partitions(self) -> list[InputPartition]:
        _, total = self._fetch()(0, self.size)
        return [InputPartition(i) for i in range(max(1, -(-total // self.size)))]

    def read(self, partition):
        rows, _ = self._fetch()(partition.value, self.size)
        for r in rows:
            yield (r.get("id"), r.get("title"), r.get("series"), r.get("narrator"), list(r.get("tags") or []))

