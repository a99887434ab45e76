"""PDF files as pages of text: the text layer, the title in the metadata, and what can't be read as rows that say so.

The reader knows what text layers are made of: indirect objects, also in object streams and of later revisions, Flate streams, page
trees, fonts with a ToUnicode map or else Latin letters, and the operators that place text. What only pictures hold is left
to OCR, as pages without text. Encrypted files and files without pages give a row with an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import is_junk_title
from pagemill.storage import BYTES_PER_BATCH, bounded_batches

PAGES = "number int, text string, title string, error string"

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|\((?s:.)|<[0-9A-Fa-f\s]*>|(\d+)\s+(\d+)\s+R(?![^\s()<>\[\]{}/%])|[^\s()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_STREAM, _ENDSTREAM = re.compile(rb"\s*stream\r?\n?"), re.compile(rb"\s*endstream")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: Thousandths of an em that a step within a line has to go for a space between words.
_GAP = 200


class Unreadable(ValueError):
    pass


class Name(str):
    pass


class Ref(int):
    pass


class Op(bytes):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from the sign after the first one, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            c = data[at]
            at += 1
            if c in _ESCAPES:
                out.append(_ESCAPES[c])
            elif 0x30 <= c <= 0x37:
                m = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])
                out.append(int(m[0], 8) & 255)
                at += len(m[0]) - 1
            elif c in b"\r\n":
                at += c == 13 and data[at : at + 1] == b"\n"
            else:
                out.append(c)
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """The values of a piece of PDF, one after the other, and where each ends: numbers, names, strings, references, arrays, dicts, operators."""
    stack: list[list] = []
    while m := _TOKEN.search(data, at):
        word, at = m[0], m.end()
        if word[:1] == b"%" or word in (b"{", b"}"):
            continue
        if word in (b"<<", b"["):
            stack.append([word])
            continue
        if word in (b">>", b"]"):
            if not stack:
                continue
            kind, *items = stack.pop()
            value: Any = {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)} if kind == b"<<" else items
        elif word[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), word[1:]).decode("latin-1"))
        elif word[:1] == b"(":
            value, at = _string(data, m.start() + 1)
        elif word[:1] == b"<":
            try:
                value = bytes.fromhex(word[1:-1].decode())
            except ValueError:  # white space within a pair, or half a pair at the end
                digits = re.sub(rb"\s", b"", word[1:-1])
                value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m[1]:
            value = Ref(m[1])
        elif _NUMBER.fullmatch(word):
            value = float(word)
        else:
            value = Op(word)
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise Unreadable("not a PDF")
        self.data, self.objects, self.trailer = data, {}, {}
        self.codes: dict[int, Codes] = {}  # by the place of a font's map
        self.read: dict[int, Any] = {}  # objects by their places
        for m in _OBJECT.finditer(data):  # a later revision's object counts
            self.objects[int(m[1])] = m.end()
        for m in re.finditer(rb"\btrailer\b", data):
            self.trailer |= self._first(data, m.end()) or {}
        for at in list(self.objects.values()):
            found = self._at(at)
            if isinstance(found, dict) and found.get("Type") == "XRef":
                self.trailer |= found
            elif isinstance(found, dict) and found.get("Type") == "ObjStm":
                body, first = self.stream(at), int(found.get("First", 0))
                numbers = [int(v) for v, _ in values(body[:first]) if isinstance(v, float)]
                for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                    self.objects.setdefault(number, self._first(body, first + offset))
        if "Encrypt" in self.trailer:
            raise Unreadable("encrypted")

    @staticmethod
    def _first(data: bytes, at: int) -> Any:
        return next((v for v, _ in values(data, at)), None)

    def _at(self, at: int) -> Any:
        if at not in self.read:
            self.read[at] = self._first(self.data, at)
        return self.read[at]

    def get(self, value: Any) -> Any:
        """What a reference stands for."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            found = self.objects.get(int(value))
            value = self._at(found) if isinstance(found, int) else found
        raise Unreadable("references go round")

    def stream(self, at: int) -> bytes:
        """The bytes of the stream object that begins at a place."""
        head, end = next(values(self.data, at), (None, at))
        m = _STREAM.match(self.data, end)
        if not isinstance(head, dict) or not m:
            return b""
        length = self.get(head.get("Length"))
        stop = m.end() + int(length) if isinstance(length, float) else -1
        if stop < 0 or not _ENDSTREAM.match(self.data, stop):
            stop = self.data.find(b"endstream", m.end())
        body, filters = self.data[m.end() : stop], self.get(head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name != "FlateDecode":
                return b""
            body = zlib.decompressobj().decompress(body)
        return body

    def pages(self) -> list[dict]:
        """Page dicts in order, each with what it inherits."""
        root = self.get(self.get(self.trailer.get("Root")) or {})
        top = root.get("Pages") if isinstance(root, dict) else None
        if top is None:
            return [d for n in sorted(self.objects) if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Page"]
        out, seen, todo = [], set(), [(top, {})]
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            node = {k: v for k, v in above.items() if k == "Resources"} | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, node) for k in reversed(kids)]
            else:
                out.append(node)
        return out

    def title(self) -> str | None:
        info = self.get(self.trailer.get("Info"))
        raw = self.get(info.get("Title")) if isinstance(info, dict) else None
        if not isinstance(raw, bytes):
            return None
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    def text(self, page: dict) -> str:
        """The text layer of a page: lines as its operators place them."""
        contents = self.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [page.get("Contents")]
        body = b"\n".join(self.stream(self.objects[int(p)]) for p in parts if isinstance(p, Ref) and isinstance(self.objects.get(int(p)), int))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps: dict[str, Codes | None] = {}
        out, args, cmap, height = [], [], None, None

        def show(raw: Any) -> None:
            if isinstance(raw, bytes):
                out.append(_decoded(raw, cmap))

        for value, _ in values(body):
            if not isinstance(value, Op):
                args.append(value)
                continue
            if value == b"Tf" and args and isinstance(args[0], Name):
                if args[0] not in maps:
                    font = self.get(fonts.get(args[0]))
                    where = self.objects.get(int(font["ToUnicode"])) if isinstance(font, dict) and isinstance(font.get("ToUnicode"), Ref) else None
                    if isinstance(where, int) and where not in self.codes:
                        self.codes[where] = _unicode_map(self.stream(where))
                    maps[args[0]] = self.codes[where] if isinstance(where, int) else None
                cmap = maps[args[0]]
            elif value in (b"Td", b"TD") and len(args) >= 2:
                out.append("\n" if args[1] else " " if out and not out[-1].endswith((" ", "\n")) else "")
            elif value == b"Tm" and len(args) >= 6:
                out.append("\n" if height not in (None, args[5]) else "")
                height = args[5]
            elif value in (b"T*", b"'", b'"'):
                out.append("\n")
            if value in (b"Tj", b"'", b'"') and args:
                show(args[-1])
            elif value == b"TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, float):
                        out.append(" " if x <= -_GAP and out and not out[-1].endswith((" ", "\n")) else "")
                    else:
                        show(x)
            args = []
        return "".join(out)


class Codes(dict):
    """What a font's codes stand for, in UTF-16; a code is looked up in the ranges once."""

    def __init__(self) -> None:
        self.ranges: list[tuple[bytes, bytes, Any]] = []
        self.width = 1
        # of codes of two bytes: whether they were looked up, whether they stand for one unit, and which
        self.known, self.single, self.unit = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool), np.zeros(1 << 16, ">u2")

    def units(self, raw: bytes) -> bytes | None:
        """What a string of codes of two bytes stands for, where each stands for one unit."""
        codes = np.frombuffer(raw, ">u2")
        for c in np.unique(codes[~self.known[codes]]).tolist():
            found = self[c.to_bytes(2)]
            self.known[c], self.single[c] = True, len(found) == 2
            self.unit[c] = int.from_bytes(found[:2])
        return self.unit[codes].tobytes() if self.single[codes].all() else None

    def __missing__(self, code: bytes) -> bytes:
        found = b""
        for low, high, to in self.ranges:
            if len(low) == len(code) and low <= code <= high:
                step = int.from_bytes(code) - int.from_bytes(low)
                found = to[step] if isinstance(to, list) and step < len(to) else (int.from_bytes(to) + step).to_bytes(max(2, len(to))) if isinstance(to, bytes) else b""
                break
        self[code] = found
        return found


@functools.lru_cache(maxsize=16)
def _unicode_map(body: bytes) -> Codes:
    """The codes of a ToUnicode map; files of one writer share it."""
    found = Codes()
    args: list = []
    for value, _ in values(body):
        if not isinstance(value, Op):
            args.append(value)
            continue
        if value == b"endbfchar":
            found.update({a: b.decode("utf-16-be", "replace").encode("utf-16-be", "surrogatepass") for a, b in zip(args[::2], args[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)})
        elif value == b"endbfrange":
            found.ranges += [r for r in zip(args[::3], args[1::3], args[2::3], strict=False) if isinstance(r[0], bytes) and isinstance(r[1], bytes)]
        args = []
    found.width = max({len(k) for k in found} | {len(r[0]) for r in found.ranges}, default=1)
    return found


def _decoded(raw: bytes, codes: Codes | None) -> str:
    if codes is None:
        return raw.decode("cp1252", "replace")
    width = codes.width
    out = codes.units(raw) if width == 2 and len(raw) % 2 == 0 else None
    return (b"".join([codes[raw[i : i + width]] for i in range(0, len(raw), width)]) if out is None else out).decode("utf-16-be", "replace")


def read(data: bytes | None) -> list[tuple[int | None, str | None, str | None, str | None]]:
    """number (from 1), text, title and error of a file's pages; one row with an error where it can't be read."""
    try:
        pdf = Pdf(data or b"")
        pages, title = pdf.pages(), pdf.title()
        if not pages:
            raise Unreadable("no pages")
        return [(i, pdf.text(p), title, None) for i, p in enumerate(pages, 1)]
    except (Unreadable, zlib.error, ValueError, TypeError, KeyError, IndexError, AttributeError, StopIteration, OverflowError, RecursionError) as e:
        return [(None, None, None, f"unreadable PDF: {e}"[:200])]


def pages(files: DataFrame, key: str) -> DataFrame:
    """key, number (from 1), text, title and error: a row a page, or one with an error. files: key and content (binary), a file a row."""
    kind = dict(files.dtypes)[key]

    names = [key, *(c.split()[0] for c in PAGES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows, size = [], [], 0
            for i in range(b.num_rows):
                new = read(b.column(1)[i].as_py())
                owner += [i] * len(new)
                rows += new
                size += sum(len(r[1] or "") for r in new)
                if rows and (size > BYTES_PER_BATCH or i + 1 == b.num_rows):
                    number, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), *[pa.array(x, pa.string()) for x in rest]], names)
                    owner, rows, size = [], [], 0

    bounded_batches(files.sparkSession)
    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, {PAGES}")


def title_of(title: Column) -> Column:
    """The title of a file's pages, an aggregate: null where it is none or a file's name in disguise."""
    title = F.trim(F.first(title, ignorenulls=True))
    return F.when(~is_junk_title(title), title)


def titles(found: DataFrame, key: str) -> DataFrame:
    """key and title of files (`pages`), null where it is none or a file's name in disguise."""
    return found.groupBy(key).agg(title_of(F.col("title")).alias("title"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the PDFs under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
