"""Hashed sparse logistic regression on text: trained by FTRL-proximal, scored as sparse dot products.

Training looks at a bounded sample of labelled rows (`Spec.most_rows`) in one task, whose features lie in a file of the
task; the bound holds for rows, so a label whose doc_id stands on many rows doesn't add to it. The model that comes
back holds non-zero weights only, at most 2^bits of them, so its size doesn't grow with the corpus.
Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Ftrl, blocks, bounded_sample, distinct, doc_of, fold, tokens, tuned, utf8

#: From token hashes and document offsets: hashes of the features and the documents' offsets into them.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Spec:
    features: Features
    bits: int = 20
    #: Labelled rows to learn from, about; with fewer, all.
    most_rows: int = 12_000
    epochs: int = 3
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    #: A feature's value: 1 if it is there, or the root of its share among the document's features.
    shares: bool = False
    #: Weight of a row with label 1 and of one with label 0.
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass(frozen=True)
class Model:
    at: np.ndarray
    w: np.ndarray
    bias: float

    def dense(self, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.at] = self.w
        return out


def _columns(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def labelled(documents: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, text, label of the rows to learn from, about `spec.most_rows` at most. labels: doc_id (each once), label."""
    some = bounded_sample(labels.select("doc_id", F.col("label").cast("int").alias("label")), "doc_id", spec.most_rows)
    found = documents.select("doc_id").join(F.broadcast(some), "doc_id").count()
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    if found > 2 * spec.most_rows:  # ids that stand on many rows
        rows = rows.where(F.pmod(F.xxhash64(F.lit("row"), "doc_id", "text"), F.lit(1 << 32)) < int(spec.most_rows / found * (1 << 32)))
    return rows


def train(documents: DataFrame, labels: DataFrame, spec: Spec) -> Model:
    """labels: doc_id and label (0 or 1), each doc_id once. With no labelled document the model is all zero."""
    tuned(documents.sparkSession)
    rows = labelled(documents, labels, spec).withColumn("turn", F.xxhash64(F.lit("turn"), "doc_id"))
    bits, shares, features = spec.bits, spec.shares, spec.features

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(_columns(b, "text"))
            h, cuts = features(*tokens(data, offsets))
            ids = (h >> np.uint64(64 - bits)).astype(np.int32)
            lists, values = [], []
            for i in range(len(cuts) - 1):
                u, n = distinct(ids[cuts[i] : cuts[i + 1]])
                lists.append(u)
                values.append(np.sqrt(n / max(n.sum(), 1)).astype(np.float32) if shares else np.ones(len(u), np.float32))
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = lambda parts, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))
            yield pa.RecordBatch.from_arrays([_columns(b, "turn"), _columns(b, "label"), flat(lists, np.int32), flat(values, np.float32)], ["turn", "label", "ids", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, sizes = [], []
        with tempfile.TemporaryFile() as ids_file, tempfile.TemporaryFile() as x_file:
            for b in batches:
                labels += _columns(b, "label").to_pylist()
                for ids, x in zip(_arrays(_columns(b, "ids")), _arrays(_columns(b, "x")), strict=True):
                    sizes.append(len(ids))
                    ids_file.write(ids.tobytes())
                    x_file.write(x.tobytes())
            model = Ftrl(bits, spec.alpha, spec.beta, spec.l1, spec.l2)
            if sum(sizes):
                ids_file.flush(), x_file.flush()
                all_ids, all_x = np.memmap(ids_file, np.int32, "r"), np.memmap(x_file, np.float32, "r")
            else:
                all_ids, all_x = np.zeros(0, np.int32), np.zeros(0, np.float32)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for _ in range(spec.epochs):
                for y, a, z in zip(labels, cuts[:-1], cuts[1:], strict=True):
                    model.learn(np.append(all_ids[a:z], 1 << bits), np.append(all_x[a:z], np.float32(1)), y, spec.weights[0] if y else spec.weights[1])
        w = model.weights()
        at = np.flatnonzero(w[:-1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w[at].astype(np.float32).tobytes()]), pa.array([float(w[-1])])], ["at", "w", "bias"])

    sparse = rows.mapInArrow(hashed, "turn long, label int, ids array<int>, x array<float>")
    got = sparse.repartition(1).sortWithinPartitions("turn").mapInArrow(fitted, "at binary, w binary, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["at"], np.int32), np.frombuffer(got[0]["w"], np.float32), got[0]["bias"])


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def scored(documents: DataFrame, model: Model, spec: Spec, held_out: tuple[int, int]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null or empty text gets the bias's score."""
    spark = tuned(documents.sparkSession)
    sent = spark.sparkContext.broadcast((model.at, model.w, model.bias))
    bits, shares, features = spec.bits, spec.shares, spec.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        dense = Model(at, w, bias).dense(bits)
        for b in batches:
            data, offsets = utf8(_columns(b, "text"))
            margin = np.full(b.num_rows, bias)
            for lo, hi in blocks(offsets):
                h, cuts = features(*tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                ids = (h >> np.uint64(64 - bits)).astype(np.int64)
                some = np.flatnonzero(dense[ids])
                key, n = distinct((doc_of(cuts)[some] << bits) | ids[some])
                doc = key >> bits
                x = np.sqrt(n / np.maximum(np.diff(cuts), 1)[doc]) if shares else 1.0
                margin[lo:hi] += np.bincount(doc, dense[key & ((1 << bits) - 1)] * x, hi - lo)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([_columns(b, "doc_id"), _columns(b, "held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def known_labels(labels: DataFrame, column: str, held_out: tuple[int, int]) -> DataFrame:
    """doc_id and label outside the held-out fold; the larger label where rows disagree."""
    open_rows = labels.where((fold(F.col("doc_id"), held_out[0]) != held_out[1]) & F.col(column).isin(0, 1))
    return open_rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
