"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes sets chunk ends wherever it falls below a bound (32 bytes apart on
average), so an insertion moves only the ends near it. Chunks are known by XXH3 digests of 128 bits. The first place of a
digest (smallest doc_id, then text digest, then position) keeps its chunk; later places are repeats. Repeats
that follow one another for `MIN_RUN` bytes make a repeated passage. A passage that begins or ends inside a word is
cut to the word's edge where white space lies within `EDGE` bytes, else (text without spaces) to a whole code point.
The runs end at chunk ends: they aren't extended to the byte where two texts stop agreeing, so about two chunks of a
passage stay, and some repeats of under 300 bytes aren't found.

First places come from an aggregation with map-side combine; the join of chunks to the digests that occur twice is
between two plain exchanges, which adaptive execution can split where one passage is everywhere. Texts are cut into
chunks twice, for both sides: that costs less than a table of all chunks, which would be larger than the texts.

Defined cases: null and empty texts have no chunks and stay; texts of any length are cut whole, a stretch without a
chunk end every `LONGEST` bytes; doc_ids that aren't integers are compared as strings; rows without a doc_id come before
all others; rows equal in doc_id and text count as one document (each gets its result), so places don't tie otherwise;
no rows give no rows; extra columns, whatever their names, pass through `dedup_substrings` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import blocks, free_name, mixed, stored, tuned, utf8

#: Bytes between chunk ends on average; ends nearer than NEAR to the one before are left out; longest chunk.
MEAN, NEAR, LONGEST = 32, 8, 1024
#: Bytes of consecutive repeated chunks that make a repeated passage.
MIN_RUN = 120
#: Bytes at either end of a passage in which a word's edge is looked for.
EDGE = 32

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BOUND = np.uint32((1 << 32) // MEAN)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; the last is its length."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    for w in (1, 2, 4, 8):  # h over 2w bytes from two over w: the gear hash with two bits a byte
        h[w:] = h[w:] + (h[:-w] << np.uint32(2 * w)) if w < len(h) else h[w:]
    ends = np.flatnonzero(h < _BOUND) + 1
    if len(ends):
        ends = ends[np.concatenate([[True], np.diff(ends) >= NEAR])]
    ends = np.append(ends[ends < len(data)], len(data))
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(wide):
        begins = np.concatenate([[0], ends[:-1]])
        ends = np.sort(np.concatenate([ends, *[np.arange(begins[i] + LONGEST, ends[i], LONGEST) for i in wide]]))
    return ends


def _text_ids(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).astype(np.int64)


def chunks(documents: DataFrame) -> DataFrame:
    """digest, doc (`_doc_key`), tid (text digest), at, size of every chunk."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in blocks(offsets):
                part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                tids, raw = _text_ids(part, cuts), part.tobytes()
                ends = [chunk_ends(part[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                n = [len(e) for e in ends]
                if not sum(n):
                    continue
                at = np.concatenate([np.concatenate([[0], e[:-1]]) if len(e) else e for e in ends])
                ends, base = np.concatenate(ends), np.repeat(cuts[:-1], n)
                digest = [xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip((at + base).tolist(), (ends + base).tolist(), strict=True)]
                doc = b.column(0).take(pa.array(np.repeat(np.arange(lo, hi), n)))
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), doc, *[pa.array(x) for x in (np.repeat(tids, n), at.astype(np.int32), (ends - at).astype(np.int32))]], ["digest", "doc", "tid", "at", "size"])

    key, kind = _doc_key(documents)
    return documents.select(key.alias("doc"), "text").mapInArrow(run, f"digest binary, doc {kind}, tid long, at int, size int")


def _doc_key(documents: DataFrame, name: str = "doc_id") -> tuple[Column, str]:
    """A document's key that is never null, and its type."""
    if dict(documents.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63))), "long"
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")), "string"


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc, tid and spans (array of at, size) of the chunks whose digest has an earlier place."""
    found = chunks(documents)
    place = F.struct("doc", "tid", "at")
    firsts = stored(found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first"), "firsts")
    again = found.join(firsts, "digest").where(F.struct("doc", "tid", "at") != F.col("first"))
    return again.groupBy("doc", "tid").agg(F.collect_set(F.struct("at", "size")).alias("spans"))


def passages(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, of whole words where there are spaces, inside runs of repeated chunks of MIN_RUN bytes or more."""
    order = np.argsort(at)
    at, end = at[order], (at + size)[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != end[:-1]]))
    out = []
    for a, z in zip(at[first], end[np.append(first[1:], len(at)) - 1], strict=True):
        if z - a < MIN_RUN:
            continue
        if a > 0 and not _SPACE[data[a - 1]]:  # the word before goes on into the run
            gap = np.flatnonzero(_SPACE[data[a : min(z, a + EDGE)]])
            a = a + gap[0] + 1 if len(gap) else a
            while a < z and data[a] & 0xC0 == 0x80:
                a += 1
        if z < len(data) and not _SPACE[data[z - 1]] and not _SPACE[data[z]]:
            low = max(a, z - EDGE)
            gap = np.flatnonzero(_SPACE[data[low:z]])
            z = low + gap[-1] + 1 if len(gap) else z
            while z > a and data[z] & 0xC0 == 0x80:
                z -= 1
        if z > a:
            out.append((int(a), int(z)))
    return out


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """documents with text less its repeated passages, and the columns n_passages and removed_bytes (with an underscore where a column has that name)."""
    tuned(documents.sparkSession)
    spans = repeated_spans(documents)
    columns = documents.columns
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index("text")]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids = _text_ids(*utf8(b.column(b.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tids)], [*b.schema.names, "tid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, spans = b.schema.get_field_index(text), b.column(b.schema.get_field_index("spans")).to_pylist()
            texts, n, gone = b.column(where).to_pylist(), [], []
            for i, found in enumerate(spans):
                parts = []
                if found:
                    raw = np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)
                    parts = passages(raw, np.array([s["at"] for s in found], np.int64), np.array([s["size"] for s in found], np.int64))
                    if parts:
                        keep = np.ones(len(raw), bool)
                        for a, z in parts:
                            keep[a:z] = False
                        texts[i] = raw[keep].tobytes().decode("utf-8", "surrogatepass")
                n.append(len(parts))
                gone.append(sum(z - a for a, z in parts))
            out = [pa.array(texts, pa.string()) if j == where else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_passages", "removed_bytes"])

    types = [t for _, t in documents.dtypes]
    plain = documents.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    keyed_rows = plain.mapInArrow(keyed, f"{schema}, tid long").withColumn("doc", _doc_key(plain, names[columns.index("doc_id")])[0])
    met = keyed_rows.join(spans, ["doc", "tid"], "left").select(*names, "spans")
    return met.mapInArrow(cut, f"{schema}, n_passages long, removed_bytes long").toDF(*columns, free_name("n_passages", columns), free_name("removed_bytes", columns))
