"""Text layers of PDFs made here by hand."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import documents
from pagemill.plans import live
from pagemill.sources import pdf


def made(objects, trailer):
    """A file of numbered objects: dicts as text, streams as (dict, bytes)."""
    out = [b"%PDF-1.7\n%\xe2\xe3\n"]
    for n, o in objects.items():
        head, body = o if isinstance(o, tuple) else (o, None)
        out.append(b"%d 0 obj\n%s\n" % (n, head.encode() if isinstance(head, str) else head) + (b"stream\n" + body + b"\nendstream\n" if body is not None else b"") + b"endobj\n")
    return b"".join(out) + b"trailer\n" + trailer.encode() + b"\nstartxref\n0\n%%EOF"


def plain(content, extra=None, font="<< /Type /Font >>"):
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: (f"<< /Length {len(content)} >>", content), 5: font}
    return made(objects | (extra or {}), "<< /Root 1 0 R /Info 9 0 R >>")


def texts(data):
    return [r[1] for r in pdf.read(data)]


def test_operators_that_place_text():
    content = rb"BT /F1 12 Tf 1 0 0 1 50 700 Tm (One \(two\) \164hree) Tj 0 -14 Td [(fo) 20 (ur) -300 (five)] TJ T* (six) ' 3 0 Td (\351t\351) Tj 1 0 0 1 50 600 Tm <7365 76 656e> Tj ET % (no)"
    assert texts(plain(content)) == ["One (two) three\nfour five\n\nsix été\nseven"]
    flat = zlib.compress(content)
    assert texts(plain(b"", {4: (f"<< /Length {len(flat)} /Filter [/FlateDecode] >>", flat)})) == texts(plain(content))
    assert texts(plain(b"", {4: ("<< /Length 99999 /Filter /FlateDecode >>", flat)})) == texts(plain(content))  # a length that isn't right
    assert texts(plain(b"", {4: ("<< /Length 7 0 R >>", content), 7: str(len(content))})) == texts(plain(content))


def test_fonts_with_maps():
    cmap = b"begincmap 1 beginbfchar <01> <00660066> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<4E2D> <D83CDF89>] endbfrange endcmap"
    data = plain(b"BT /F1 9 Tf <0102030405060900> Tj ET", {6: (f"<< /Length {len(cmap)} >>", cmap)}, "<< /Type /Font /ToUnicode 6 0 R >>")
    assert texts(data) == ["ffabc中\U0001f389"]


def test_codes_are_looked_up_once():
    """Ranges are walked once a code, not once a sign; lone and paired units of a string of two-byte codes come out alike."""
    codes = pdf._unicode_map(b"beginbfrange <0000> <FFFF> <0000> endbfrange")
    text = "aé中\U0001f389" * 5000
    assert pdf._decoded(text.encode("utf-16-be"), codes) == text and len(codes) == 5
    pairs = pdf._unicode_map(b"beginbfchar <0001> <00660069> endbfchar beginbfrange <0002> <0003> <0061> endbfrange")
    assert pdf._decoded(bytes.fromhex("000200010003000900"), pairs) == "afib"


def test_page_trees_object_streams_and_revisions():
    catalog, tree = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>"
    body = b"1 0 2 %d " % len(catalog) + catalog + tree
    packed = zlib.compress(body)
    first = body.index(b"<<")
    objects = {8: (f"<< /Type /ObjStm /N 2 /First {first} /Length {len(packed)} /Filter /FlateDecode >>", packed), 3: "<< /Type /Page /Contents [5 0 R 6 0 R] >>", 4: "<< /Type /Pages /Kids [7 0 R 4 0 R] >>", 5: ("<< /Length 9 >>", b"(old) Tj "), 6: ("<< /Length 10 >>", b"(more) Tj "), 7: "<< /Type /Page >>"}
    data = made(objects, "<< /Root 1 0 R /Info 9 0 R >>") + b"\n5 0 obj << /Length 9 >>\nstream\n(new) Tj \nendstream endobj\n9 0 obj << /Title <FEFF00C9> >> endobj"
    assert pdf.read(data) == [(1, "newmore", "É", None), (2, "", "É", None)]


@pytest.mark.parametrize("data", [None, b"", b"hello", b"%PDF-1.4", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R /Encrypt 2 0 R >>", plain(b"", {4: ("<< /Filter /FlateDecode >>", b"not flate")}), made({1: "1 0 R"}, "<< /Root 1 0 R >>"), b"%PDF-1.4\n" + b"<<" * 50_000])
def test_broken_files_are_rows(data):
    [(number, text, title, error)] = pdf.read(data)
    assert number is None and text is None and error.startswith("unreadable PDF")


def test_any_cut_of_a_file_is_rows():
    whole = plain(b"BT /F1 12 Tf (text) Tj ET")
    for n in range(0, len(whole), 7):
        assert pdf.read(whole[:n]) and pdf.read(whole[:n] + b"(<<[" + whole[n:])


def test_lines_come_back(spark, tmp_path):
    lines = ["", "a (b) \\c", " led by spaces ", "Ünïcode 中文 🎉", "", "x" * 3000, "end"]
    (tmp_path / "a.pdf").write_bytes(live.written("A title", [lines, [], ["one"]]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = pdf.pages(pdf.files(spark, str(tmp_path)), "path")
    got = sorted((r.path[-5:], r.number, r.text, r.title) for r in found.where("error is null").collect())
    assert got == [("a.pdf", 1, "\n".join(lines), "A title"), ("a.pdf", 2, "", "A title"), ("a.pdf", 3, "one", "A title")]
    assert [r.path[-5:] for r in found.where("error is not null").collect()] == ["b.pdf"]
    assert {(r.path[-5:], r.title) for r in pdf.titles(found, "path").collect()} == {("a.pdf", "A title"), ("b.pdf", None)}
    assert {(r.path[-5:], r.chars, r.ocr_pages) for r in documents.size_scan(found.where("error is null"), "path").collect()} == {("a.pdf", len("\n".join(lines)), 2)}
    assert {r.method for r in documents.routed(found.where(F.col("error").isNull()), "path").collect()} == {"text-layer", "ocr"}
