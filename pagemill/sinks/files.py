"""Rows as files, all or none of a job's: tasks write, and then tasks move.

Tasks write beside the place, each into a folder of its own; only when all are done are the files of the tasks that count
moved to their names, by tasks too, so a job that fails while it writes, or a task that is repeated, leaves nothing. What is there already with
the same bytes stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.storage import bounded_batches, stored

OUTCOME = "name string, outcome string"
#: Files that a task moves at once.
MOVERS = 4

Batches = Iterator[pa.RecordBatch]


def there(path: str, name: Column) -> Column:
    """Whether a file of that name is under `path` (a URI) when a task comes to the row; the folder isn't listed."""

    @F.arrow_udf("boolean")
    def asked(names: pa.Array) -> pa.Array:
        store, base = fs.FileSystem.from_uri(path)
        found = store.get_file_info([f"{base}/{n}" for n in names.to_pylist()])
        return pa.array([f.type == fs.FileType.File for f in found], pa.bool_())

    return asked.asNondeterministic()(name)


def _writes(path: str, run: str) -> Callable[[Batches], Batches]:
    """Rows (name, content, kept) as files of the task's own folder: name, part (null: nothing is to be moved) and outcome."""

    def write(batches: Batches) -> Batches:
        store, base = fs.FileSystem.from_uri(path)
        folder, n = f"{base}/{run}/{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        for b in batches:
            names = b.column(0).to_pylist()
            parts, outcomes = [], []
            for name, content, kept, target in zip(names, b.column(1), b.column(2).to_pylist(), store.get_file_info([f"{base}/{x}" for x in names]), strict=True):
                data, is_there = content.as_py() or b"", target.type == fs.FileType.File
                same = not kept and is_there and target.size == len(data) and _read(store, target.path) == data
                outcomes.append("kept" if kept else "same" if same else "replaced" if is_there else "created")
                if kept or same:
                    parts.append(None)
                    continue
                parts.append(f"{folder}/{n}")
                n += 1
                with store.open_output_stream(parts[-1]) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.string()), pa.array(outcomes, pa.string())], ["name", "part", "outcome"])

    return write


def _moves(path: str) -> Callable[[Batches], Batches]:
    """Parts (name, part, outcome) to their names; a part that a task before this one has moved is there already."""

    def move(batches: Batches) -> Batches:
        store, base = fs.FileSystem.from_uri(path)

        def place(name: str, part: str | None) -> None:
            if part is not None:
                try:
                    store.move(part, f"{base}/{name}")
                except OSError:
                    here, target = store.get_file_info([part, f"{base}/{name}"])
                    if here.type != fs.FileType.NotFound or target.type != fs.FileType.File:
                        raise

        with ThreadPoolExecutor(MOVERS) as pool:
            for b in batches:
                for _ in pool.map(place, b.column(0).to_pylist(), b.column(1).to_pylist()):
                    pass
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["name", "outcome"])

    return move


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """name and content of each row as a file under `path` (any store that pyarrow opens by URI). `OUTCOME` of each: created, replaced or same,
    by what was there before the job.

    A row with `kept` (boolean, where rows have it) is told as kept and nothing is written for it. Of rows with one name the last that is
    moved stays; give each a name of its own.
    """
    bounded_batches(rows.sparkSession)
    kept = F.coalesce(F.col("kept"), F.lit(False)) if "kept" in rows.columns else F.lit(False)
    run = f".run-{uuid.uuid4().hex}"
    try:
        wrote = stored(rows.select(F.col("name").cast("string"), F.col("content").cast("binary"), kept.alias("kept")).mapInArrow(_writes(path, run), "name string, part string, outcome string"), "wrote")
        return stored(wrote.mapInArrow(_moves(path), OUTCOME), "outcomes")
    finally:
        store, base = fs.FileSystem.from_uri(path)
        if store.get_file_info(f"{base}/{run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{run}")
