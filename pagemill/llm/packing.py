"""Best-fit packing planned over the histogram of lengths.

Documents become token ids plus an end id; one longer than a sequence is cut into full pieces, its first piece taking
the remainder. The plan is made from counts per length (at most `size` of them), never from documents: lengths are
taken from the longest down, and all pieces of a length go at once into the open sequences with the least room
that suffices. Its rows say "the pieces of this length with ranks a to b lie in sequences c onwards at this
offset". Documents take their slots by joining on their rank within the length; ranks are counted per length and
hash bucket and then shifted, so one very common length is spread over all tasks; there are as many buckets as make
about `PER_BUCKET` pieces each if all had one length.

Defined cases: a null text is empty (one piece: the end id); texts of any length are packed whole; pieces of one length
take their ranks in the order of bucket, doc_id, piece and start, and ties (repeated rows) get slots of their own in any
order; without rows there are no pieces; rows may lack a doc_id; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import stored, tuned
from pagemill.llm.tokens import ByteBpe

SIZE = 2048
END_ID = 0
#: Hash buckets that share out the ranks of one length, at least, and pieces to a bucket.
BUCKETS, PER_BUCKET = 256, 20_000


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, offset): best fit decreasing over counts; ranks count from 0."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, sequences)
    free: list[int] = []
    rows, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(free, length)
            if i == len(free):
                new = -(-left // (size // length))
                put(size, sequences, new)
                sequences += new
                continue
            space = free[i]
            first, n = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(i)
            take = min(n, left)
            rows.append((length, rank, take, first, size - space))
            if take < n:
                put(space, first + take, n - take)
            if space > length:
                put(space - length, first, take)
            rank, left = rank + take, left - take
    return rows


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows, texts = [], b.column(1).to_pylist()
            for i, text in enumerate(texts):
                data = bpe.id_bytes(text or "") + end
                n, at, k = len(data) // 4, 0, 0
                upto = n % size or size
                while at < n:
                    part = data[4 * at : 4 * upto]
                    rows.append((i, k, at, upto - at, zlib.crc32(part), part))
                    at, upto, k = upto, upto + size, k + 1
            own, *cols = zip(*rows, strict=True) if rows else [()] * 6
            out = [b.column(0).take(pa.array(own, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[4]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset: sequences of `size` tokens at most, gapless from 0."""
    spark = documents.sparkSession
    rows = stored(pieces(documents, tokenizer, size, with_ids), "pieces")
    buckets = max(BUCKETS, rows.count() // PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = stored(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(counts, size) or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("rank", F.row_number().over(place) - 1).join(shift, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "bucket")
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("slots"))
    met = ranked.join(F.broadcast(by_length), "length")  # at most `size` rows; their slots follow the lengths, not the documents
    hit = F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["n"]))[0]
    return met.withColumn("slot", hit).withColumns({"sequence_id": F.col("slot.sequence") + F.col("rank") - F.col("slot.first"), "offset": F.col("slot.offset")}).drop("slot", "slots", "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
