"""Notes as files, all of a job's or none (`files`)."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import portable_markdown, slug
from pagemill.operators.scans import numbered
from pagemill.sinks.files import write_files

FORMATS = ("pdf", "md", "docx", "none")


def write_markdown(notes: DataFrame, path: str) -> DataFrame:
    """Each note as a file <name>.md under `path` (a URI); a name that several notes have gets a number from the second on. notes: title, markdown."""
    return write_notes(notes, path, "md")


def write_notes(notes: DataFrame, path: str, fmt: str) -> DataFrame:
    """Each note as a file in a format: name and outcome of each. Notes whose conversion failed aren't written; `exported` tells why."""
    rows = numbered(exported(notes, fmt).where("content is not null"), ["name"], ["content"], "nth")
    named = F.concat("name", F.when(F.col("nth") > 0, F.concat(F.lit(" "), (F.col("nth") + 1).cast("string"))).otherwise(""), F.lit(f".{fmt}"))
    return write_files(rows.select(named.alias("name"), "content"), path)


def exported(notes: DataFrame, fmt: str) -> DataFrame:
    """name, content (binary) and error of each note in `fmt`; every failure is a row, none stops the job."""
    if fmt not in FORMATS or fmt == "none":
        raise ValueError(f"unsupported note format: {fmt!r}")
    rows = notes.select(slug(F.col("title")).alias("name"), (F.col("markdown") if fmt == "md" else portable_markdown(F.col("markdown"))).alias("markdown"))
    if fmt == "md":
        return rows.select("name", F.col("markdown").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))

    def converted(text: str) -> tuple[bytes | None, str | None]:
        if not shutil.which("pandoc"):
            return None, "pandoc is not installed"
        done = subprocess.run(["pandoc", "-f", "markdown", "-t", fmt, "-o", "-"], input=text.encode(), capture_output=True, timeout=300)
        return (done.stdout, None) if done.returncode == 0 else (None, done.stderr.decode(errors="replace")[:300])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [converted(m) for m in b["markdown"]]
            yield pd.DataFrame({"name": b["name"], "content": [g[0] for g in got], "error": [g[1] for g in got]})

    return rows.mapInPandas(run, "name string, content binary, error string")
