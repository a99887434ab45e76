"""A spool of records as a stream: each trigger takes what has come since the last, in the order of names.

A record's name is its job's id, and ids sort as jobs came, so the last name read says how far a stream is: that is all a
checkpoint holds, and a restart lists the spool anew from there. A trigger that is repeated reads the same names; a record that
has gone since is done. Records that can't be read come as rows with an error, not as failures.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pagemill.sources.records import JOB, NEEDED

FIELDS = [c.split()[0] for c in JOB.split(", ")]
#: Records that one task reads.
PER_TASK = 256


class SpoolSource(DataSource):
    """Format `job_spool`: name, the fields of a job, and error. Options: path (a URI), suffix, per_trigger (records, all by default)."""

    @classmethod
    def name(cls) -> str:
        return "job_spool"

    def schema(self) -> str:
        return f"name string, {JOB}, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SpoolReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SpoolStream(self.options)


class _Spool:
    def __init__(self, options) -> None:
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ".json"), int(options.get("per_trigger", "0"))

    def names(self, after: str = "") -> list[str]:
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and f.base_name > after)

    def parts(self, names: list[str]) -> list[InputPartition]:
        return [InputPartition(names[i : i + PER_TASK]) for i in range(0, len(names), PER_TASK)]

    def rows(self, names: list[str]) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.path)
        for name in names:
            try:
                with store.open_input_stream(f"{base}/{name}") as f:
                    body = f.read()
            except FileNotFoundError:
                continue
            yield (name, *record(body))


def record(body: bytes) -> tuple:
    """A record's fields and what is wrong with it; without the fields where something is."""
    try:
        found = json.loads(body)
        if not isinstance(found, dict):
            raise ValueError("not an object")
        if odd := sorted(found.keys() - set(FIELDS)):
            raise ValueError(f"unknown field {odd[0]}")
        if lacking := [n for n in NEEDED if found.get(n) is None]:
            raise ValueError(f"no {lacking[0]}")
        return (*[None if found.get(n) is None else str(found[n]) for n in FIELDS[:-1]], int(found.get("attempts") or 0), None)
    except (ValueError, TypeError) as e:
        return (*[None] * len(FIELDS), f"unreadable record: {e}"[:200])


class _SpoolReader(_Spool, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.parts(self.names()) or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.value)


class _SpoolStream(_Spool, DataSourceStreamReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.last = ""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        names = self.names(self.last)
        if names:
            self.last = names[min(self.most or len(names), len(names)) - 1]
        return {"last": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["last"])
        return self.parts([n for n in self.names(start["last"]) if n <= end["last"]])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to do: records stay until their jobs are completed."""


def spool_stream(spark: SparkSession, path: str, suffix: str = ".json", per_trigger: int = 0) -> DataFrame:
    """The stream of a spool's records."""
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format("job_spool").option("path", path).option("suffix", suffix).option("per_trigger", per_trigger).load()


def spool_table(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """What is in a spool now."""
    spark.dataSource.register(SpoolSource)
    return spark.read.format("job_spool").option("path", path).option("suffix", suffix).load()
