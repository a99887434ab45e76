"""What the operators share: shared tables, label folds, word hashing in numpy, FTRL-proximal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.storage import stored  # noqa: F401  for the operators

#: Rows and bytes of a table that Python workers get at once, at most; a worker holds one batch (a longer row is one by itself).
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 64 << 20
#: Bytes of text that the numpy code works on at once.
BLOCK = 1 << 20

#: Modulus of the hashes of spans, a prime: modulo a power of two, texts that differ collide by construction whatever the base.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x0C6A4A7935BD1E99
#: Bytes whose powers are held in tables; sums within that many stay under 2^64.
_STEP = 1 << 16


def tuned(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, for texts may be long. The settings stay, and hold for later queries too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores added while a column has it already."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of `key`; all rows when there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    cut = int(most / n * (1 << 32))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 32)) < cut)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x under 2^64."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _by_two_to_31(x: np.ndarray) -> np.ndarray:
    """A number under 2^63 congruent to x * 2^31, for x under 2^62."""
    return (x >> np.uint64(30)) + ((x & np.uint64((1 << 30) - 1)) << np.uint64(31))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, from halves of 30 and 31 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    return _reduced((a1 * b1 << np.uint64(1)) + _by_two_to_31(a1 * b0 + a0 * b1) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, product(out, np.uint64(pow(base, len(out), int(_PRIME))))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, int(_PRIME)), _STEP)
_UP_HALVES = _UP & np.uint64((1 << 31) - 1), _UP >> np.uint64(31)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """prefix[i]: polynomial of the bytes data[:i] modulo the prime."""
    out, carry, step = np.zeros(len(data) + 1, np.uint64), np.uint64(0), pow(_BASE, _STEP, int(_PRIME))
    for k, lo in enumerate(range(0, len(data), _STEP)):
        part = data[lo : lo + _STEP].astype(np.uint64) + np.uint64(1)
        low, high = (np.cumsum(part * half[: len(part)]) for half in _UP_HALVES)
        local = _reduced(_by_two_to_31(high) + low)
        out[lo + 1 : lo + 1 + len(part)] = _reduced(product(local, np.uint64(pow(step, k, int(_PRIME)))) + carry)
        carry = out[lo + len(part)]
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that don't depend on the place; two spans of n bytes that differ meet with a chance of n in 2^61."""
    starts = starts.astype(np.int64)
    far = _powers(pow(_BASE, -_STEP, int(_PRIME)), (int(starts.max()) // _STEP + 1) if len(starts) else 1)
    sums = _reduced(prefix[ends] + (_PRIME - prefix[starts]))
    return mixed(product(product(sums, _DOWN[starts % _STEP]), far[starts // _STEP]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets; nulls are empty. No copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_byte_table() -> np.ndarray:
    """Class of each byte: 0 white space, 1 part of a word, 2 other sign."""
    t = np.full(256, 2, np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        t[lo:hi] = 1
    return t


BYTE_CLASS = _word_byte_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the Latin-1 block in small letters, by bytes of UTF-8."""
    out = _LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def runs(classes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class, white space left out; a run ends at each of `cuts`."""
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(classes) + 1, bool)
    np.not_equal(classes[1:], classes[:-1], out=edge[1:-1])
    edge[cuts] = True
    at = np.flatnonzero(edge)
    real = classes[at[:-1]] != 0
    return at[:-1][real], at[1:][real]


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of documents whose bytes make up about `size`; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and sign runs of documents, and the documents' n + 1 offsets into them."""
    cuts, found = np.zeros(len(offsets), np.int64), []
    for lo, hi in blocks(offsets):
        part = lowered(data[offsets[lo] : offsets[hi]])
        at = offsets[lo : hi + 1] - offsets[lo]
        starts, ends = runs(BYTE_CLASS[part], at)
        prefix = prefix_sums(part)
        found.append(span_hashes(prefix, starts, ends))
        cuts[lo + 1 : hi + 1] = np.searchsorted(starts, at[1:]) + cuts[lo]
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), cuts


def doc_of(cuts: np.ndarray) -> np.ndarray:
    """The document of each element, from offsets."""
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


class Ftrl:
    """Logistic regression by follow-the-regularised-leader with per-coordinate rates, L1 and L2.

    w is zero where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2); a bias is the last coordinate.
    """

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> float:
        """One step on distinct coordinates `at` with values `x`; returns the score before it."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return float(p)
