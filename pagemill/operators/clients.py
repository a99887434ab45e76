"""Calls to services outside: from tasks, with waits between tries, and a row for every outcome.

A client is anything that takes a value and returns one; it is sent to the workers. What it raises says what happened: an
answer that refuses the request is final, a service that can't be reached is tried again after each of `WAITS`, and a request that takes too
long is neither, for the service is there and would take as long again. No row fails the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.documents import ocr_outcome
from pagemill.storage import bounded_batches

#: Seconds between tries.
WAITS = (10.0, 60.0)
#: Signs of a refusal that are kept.
DETAIL_CHARS = 200
OUTCOME = "tries int, seconds double, failure string, detail string"


class Rejected(Exception):
    """The service judged the request."""


class Unreachable(Exception):
    """The service didn't answer."""


class TimedOut(Exception):
    """The service took too long."""


class Vision(Protocol):
    """What reads a page's picture: its text, and whether the reading came to an end by itself."""

    def __call__(self, image: bytes) -> tuple[str, bool]: ...


def tried(client: Callable[[Any], Any], value: Any, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, int, float, str | None, str | None]:
    """The result (None where there is none), tries, seconds of the last one, failure (rejected, unreachable, timed out) and detail."""
    for i in range(len(waits) + 1):
        began = time.monotonic()
        try:
            return client(value), i + 1, time.monotonic() - began, None, None
        except Rejected as e:
            return None, i + 1, time.monotonic() - began, "rejected", str(e)[:DETAIL_CHARS]
        except TimedOut as e:
            return None, i + 1, time.monotonic() - began, "timed out", str(e)[:DETAIL_CHARS]
        except Unreachable as e:
            last = str(e)[:DETAIL_CHARS]
            if i < len(waits):
                sleep(waits[i])
    return None, len(waits) + 1, time.monotonic() - began, "unreachable", last


def called(rows: DataFrame, key: str, column: str, client: Callable[[Any], Any], result: str, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """key, result (of the type `result`) and `OUTCOME` of a call for each row. A task that is repeated calls anew: store what it gives."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [tried(client, v, waits) for v in b[column]]
            names = ["result", *[c.split()[0] for c in OUTCOME.split(", ")]]
            yield pd.DataFrame({key: b[key]} | {n: pd.Series([g[i] for g in got], dtype="int32" if n == "tries" else "float64" if n == "seconds" else object) for i, n in enumerate(names)})

    bounded_batches(rows.sparkSession)
    return rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, result {result}, {OUTCOME}")


def read_pages(pictures: DataFrame, key: str, vision: Vision, limit_s: float, limit_tokens: int, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """pictures (key, image) as pages: key, text, method, seconds, reason and outage, which says that the job has to be tried again later.

    A page that took too long or ran to the cap is skipped for good; one that was refused too, with what was said.
    """
    found = called(pictures, key, "image", vision, "struct<text: string, complete: boolean>", waits)
    c = F.col
    page = ocr_outcome(c("result.text"), c("seconds"), F.coalesce("result.complete", F.lit(False)), c("failure").eqNullSafe("timed out"), limit_s, limit_tokens)
    refused: Column = F.struct(F.lit("").alias("text"), F.lit("skipped").alias("method"), c("seconds").alias("seconds"), F.concat(F.lit("OCR refused: "), "detail").alias("reason"))
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("method", "string"), ("seconds", "double"), ("reason", "string"))])
    page = F.when(c("failure") == "unreachable", none).when(c("failure") == "rejected", refused).otherwise(page)
    return found.select(key, page.alias("_page"), (c("failure").eqNullSafe("unreachable")).alias("outage")).select(key, "_page.*", "outage")
