"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text or media reference, each with its position, and media with
the digest named in its source and its caption. Payloads are written once per digest in a lossless form (8-bit grey
PNG, rows of 576 samples) to a table, read back from it, and resolved by joins on the digest; rows keep document,
position and caption. `page_sequences` gives the sequences of web pages, `media_documents` shows each text as a page:
a heading, the figure of its payload with the text's first line as caption, and a line after it.

Defined cases: a null or empty page has no elements; a reference whose digest isn't stored resolves to nulls; equal
payloads are stored once; extra columns, whatever their names, are ignored; a null or empty text's payload is 576 bytes of 255;
texts of any length are stored whole; repeated rows and rows without a doc_id give a row each; no rows give no rows; media that stand
side by side keep the page's order.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, tuned

UNIT = 576
#: Effort of the lossless form, 1 to 9: stored bytes are shuffled once and written once.
LEVEL = 9
#: Signs of a text's first line that its figure has as a caption (the payload is the whole text).
CAPTION = 80
ELEMENT = "struct<position int, kind string, text string, digest string, caption string>"
_SOURCE = re.compile(r"media:([0-9a-f]{64})")
_PNG = b"\x89PNG\r\n\x1a\n"


class _Sequence(HTMLParser):
    """Text runs and media in page order; a figure's caption goes to its media."""

    BREAKS = frozenset("p div br li h1 h2 h3 h4 h5 h6 tr table article section figure blockquote pre".split())
    SKIPPED = frozenset("script style head template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.hidden, self.figure, self.caption = [], [], 0, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIPPED:
            self.hidden += 1
        if tag in self.BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.out)
        if tag == "figcaption":
            self.flush()
            self.caption = []
        if tag in ("img", "video", "audio", "source") and a.get("src"):
            self.flush()
            digest = _SOURCE.fullmatch(a["src"])
            self.out.append({"kind": "media", "text": None, "digest": digest[1] if digest else None, "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for x in self.out[self.figure if self.figure is not None else len(self.out) :]:
                if x["kind"] == "media":
                    x["caption"] = text or x["caption"]
            self.caption = None
        if tag in self.BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.out)]


def interleaved(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and sequence: the page's ordered elements."""
    tuned(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([elements(x) for x in b.column(1).to_pylist()], kind)], ["key", "sequence"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"key {dict(pages.dtypes)[key]}, sequence array<{ELEMENT}>").withColumnRenamed("key", key)


def to_png(payload: bytes) -> bytes:
    """8-bit grey, UNIT samples to a row; the payload's length is a positive multiple of UNIT."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a stored payload."""
    if not media.startswith(_PNG):
        raise ValueError("not a stored payload")
    at, body = len(_PNG), []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", media, at + 8)
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def feature(samples: bytes) -> str:
    """Mean, spread and a 16-bin histogram of the samples, in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{x.mean():.3f} {x.std():.3f} " + " ".join(str(int(n) * 1000 // len(x)) for n in bins)


def text_pages(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a page that shows the text: heading, figure with the payload's digest and a caption, size."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, html = [], []
            for text in b.column(1).to_pylist():
                size, payload = padded(text)
                n.append(size)
                first = escape((text or "").split("\n", 1)[0][:CAPTION])
                html.append(f'<h1>Document</h1><figure><img src="media:{hashlib.sha256(payload).hexdigest()}"><figcaption>{first}</figcaption></figure><p>{size} bytes</p>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(html, pa.string())], ["doc_id", "n_bytes", "html"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, html string")


def text_media(documents: DataFrame) -> DataFrame:
    """digest and stored form of each text's payload, once per digest."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [padded(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([to_png(p) for p in payloads], pa.binary())], ["digest", "media"])

    return documents.select("text").mapInArrow(run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def media_features(media: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; from the stored bytes read back."""
    tuned(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored_form in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = from_png(stored_form)
                rows.append((digest, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), feature(x)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolved(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """key, position, kind, text, digest, caption of every element, with the media columns of its digest (nulls without)."""
    flat = sequences.select(*[c for c in sequences.columns if c != "sequence"], F.explode("sequence").alias("e")).select("*", "e.*").drop("e")
    return flat.join(media, "digest", "left")


def page_sequences(pages: DataFrame, media: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, kind, text, digest, caption of every element of web pages, with the columns of `media` by digest."""
    return resolved(interleaved(pages, key, html), key, media)


def media_documents(documents: DataFrame) -> DataFrame:
    """Each text as a page with one figure: parsed, its payload resolved by digest and described, its place and neighbours kept."""
    pages = text_pages(documents)
    payloads = stored(text_media(documents), "payloads")  # the media table; what follows reads its bytes
    found = page_sequences(pages.select(F.struct("doc_id", "n_bytes").alias("page"), "html"), media_features(payloads), "page")
    return found.where("kind = 'media'").select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
