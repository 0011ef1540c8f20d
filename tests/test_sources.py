import bz2
import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile

import pytest

from quire.sinks import writers
from quire.sources import archives, cues, eml, epub, html, images, jsonl, lines, odf, ooxml, pages, pdf, tabular
from quire.sources.base import SourceError
from quire.sources.catalog import inspect_files
from quire.sources.items import project, text_items, within_budget


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def code(f, *args, **kw) -> str:
    with pytest.raises(SourceError) as e:
        list(f(*args, **kw))
    return str(e.value)


def texts(name, payload, mode="strict"):
    return [(json.loads(loc), text) for _, loc, text, _ in project(name, payload, mode)]


def test_html():
    page = b'<html><body><p>needle &amp; result</p><script>x</script><p hidden>no</p><p style="display: none">no</p><img src="a"></body></html>'
    assert texts("a.html", page) == [(["html-text", [["html", 1], ["body", 2], ["p", 3]], 4, 1, 15], "needle & result")]
    assert code(html.read, "a.html", b"<p>open") == "HTML_UNBALANCED_OR_NO_ELEMENTS"
    assert code(html.read, "a.html", b"<a><b>x</a>") == "HTML_UNBALANCED_EXPLICIT_TAGS"
    assert [t for _, t in texts("a.html", b"<a><b>x</a>y", "lenient")] == ["x", "y"]


def test_json():
    assert texts("a.json", '{"a/b":{"~x":[null,"needle 中文"]}}'.encode())[1] == (["json-pointer", "/a~1b/~0x/1"], "needle 中文")
    found = texts("a.jsonl", b'\xef\xbb\xbf{"other":1}\r\n{"key":"needle"}\r\n')
    assert found[1] == (["jsonl-record", 2, 16, 32, "/key"], "needle")
    assert code(jsonl.read, "a.json", b"[" + b"9" * 257 + b"]") == "JSON_NUMBER_DIGIT_LIMIT"
    assert code(jsonl.read, "a.json", b'{"a":1,"a":2}') == "JSON_DUPLICATE_KEY"
    assert code(jsonl.read, "a.json", b"[" * 33 + b"]" * 33) == "JSON_DEPTH_LIMIT"
    assert code(jsonl.read, "a.jsonl", b"{}\n\n{}\n") == "JSONL_EMPTY_RECORD"


def test_lines():
    payload = "first line\n😀 café\r\ntail\n".encode()
    found = list(lines.read("a.md", payload))
    assert [t for _, t, _ in found] == ["first line", "😀 café", "tail"]
    _, start, end, number, sha = found[1][0]
    assert lines.resolve_line(payload, start, end, sha) == "😀 café" and number == 2
    assert code(lambda: [lines.resolve_line(payload, start + 1, end, sha)]) == "INVALID_LOCATOR"
    assert code(lines.read, "a.txt", b"a\rb\n") == "UNSUPPORTED_LINE_CONTENT"
    assert code(lines.read, "a.txt", b"x" * 9000) == "LINE_EXCEEDS_BUDGET"


def test_cues():
    vtt = b"WEBVTT\n\n1\n00:01.000 --> 00:02.500 align:start\nhello\nyou\n\nNOTE x\n\n00:03.000 --> 00:04.000\nbye"
    assert [c[2:5] for c in cues.cues("a.vtt", vtt)] == [(1000, 2500, "align:start"), (3000, 4000, "")]
    assert code(cues.cues, "a.srt", b"1\n00:00:02,000 --> 00:00:01,000\nx\n") == "CUE_ORDER_INVALID"
    assert code(cues.cues, "a.vtt", b"x") == "VTT_HEADER_MISSING"


def test_mail():
    raw = (
        "Subject: hi\nFrom: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=Z\n\n--Z\n"
        "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nbWFpbG5lZWRsZSDkuK3mlocK\n"
        "--Z\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=x.pdf\n\nabc\n--Z--\n"
    ).encode()
    found = texts("a.eml", raw)
    assert (["eml-header", "subject", 1], "hi") in found
    assert (["eml-body", [1, 1], "text/plain", "base64"], "mailneedle 中文\n") in found
    assert list(eml.attachments("a.eml", raw)) == [("1.2", "x.pdf", "application/pdf")]


OFFICE = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:style="s"'


def test_odf():
    body = "<office:text><text:p>needle<text:s/><text:s/>中文</text:p><text:tracked-changes><text:p>x</text:p></text:tracked-changes></office:text>"
    odt = zipped(**{"content.xml": f"<r {OFFICE}><office:body>{body}</office:body></r>"})
    assert texts("a.odt", odt) == [(["odt-paragraph-xml", 1], "needle  中文")]
    sheet = '<office:spreadsheet><table:table table:name="Data"><table:table-row><table:table-cell table:formula="=1"><text:p>cell</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet>'
    ods = zipped(**{"content.xml": f"<r {OFFICE}>{sheet}</r>"})
    assert texts("a.ods", ods) == [(["ods-cell-xml", "Data", 1, 1, 1], "cell")]
    assert list(odf.cells(ods))[0][3] == "=1"
    assert code(odf.read, "a.odt", zipped(**{"content.xml": "<!DOCTYPE x><r/>"})) == "XML_DTD_REFUSED"


def test_epub():
    book = zipped(
        mimetype="application/epub+zip",
        **{
            "META-INF/container.xml": '<c><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></c>',
            "O/b.opf": '<p><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></p>',
            "O/a.xhtml": "<html><body><p>last</p></body></html>",
            "O/b.xhtml": "<html><body><p>first</p></body></html>",
        },
    )
    assert [t for _, t in texts("a.epub", book)] == ["first", "last"]
    assert code(epub.read, "a.epub", zipped(mimetype="x")) == "EPUB_MIMETYPE"


BLOCKS = [
    {"kind": "heading", "level": 2, "text": "Title", "paragraphs": None, "pairs": None, "rows": None, "name": None},
    {"kind": "paragraphs", "text": None, "paragraphs": ["one & two", "three"], "pairs": None, "rows": None, "name": None},
    {"kind": "table", "text": None, "paragraphs": None, "pairs": None, "rows": [["a", "b"], ["1", "2"]], "name": "T"},
]


def test_written_packages_read_back():
    body = list(ooxml.docx_body(writers.to_docx(BLOCKS)))
    assert [(k, level, t) for _, k, _, level, t, _ in body[:3]] == [("paragraph", 2, "Title"), ("paragraph", 0, "one & two"), ("paragraph", 0, "three")]
    assert body[3][5] == [["a", "b"], ["1", "2"]]
    cells = list(ooxml.xlsx_cells(writers.to_xlsx(BLOCKS)))
    assert [(c[1], c[3], c[4], c[5]) for c in cells][:2] == [("T", 1, 1, "a"), ("T", 1, 2, "b")]
    shapes = list(ooxml.pptx_shapes(writers.to_pptx(BLOCKS)))
    assert shapes[0][2:4] == ("title", "Title") and len({s[0] for s in shapes}) == 3
    assert writers.to_csv(BLOCKS) == b"a,b\n1,2\n"
    assert [p[1] for p in pdf.pages("a.pdf", writers.to_pdf(BLOCKS))] == ["Title\none & two\nthree\na | b\n1 | 2"]
    assert writers.to_docx(BLOCKS) == writers.to_docx(BLOCKS)
    assert writers.sheet_names(["A", "a", "x" * 40, ""]) == ["A", "a-2", "x" * 31, "Sheet"]


def test_package_rules():
    assert code(ooxml.docx_body, b"nope") == "PACKAGE_INVALID"
    assert code(ooxml.docx_body, zipped(**{"../evil": "x"})) == "PACKAGE_MEMBER_NAME"


def test_csv():
    assert tabular.records('k,v\n1,"first\nsecond"\n') == [["k", "v"], ["1", "first\nsecond"]]
    assert tabular.records('k,v\n1,"first\nsecond"\n', "1")[1] == ["1", "firstsecond"]
    assert code(lambda: [tabular.records('a,"b')]) == "CSV_INVALID"


def test_csv_relation(spark):
    rows = "\n".join(["a,b,b", *(f"{i},x{i},y{i}" for i in range(15))])
    files = spark.createDataFrame([("d/x.csv", rows.encode()), ("d/empty.csv", b"")], "path string, content binary")
    parsed = tabular.csv_rows(files)
    assert [r.error for r in parsed.filter("error is not null").collect()] == ["CSV_EMPTY"]
    p = tabular.csv_profiles(parsed).first()
    assert p.row_count == 15 and len(p.preview) == 10 and json.loads(p.preview[0]) == {"a": "0", "b": "y0"}


def test_pages(spark):
    text = spark.createDataFrame([("=== A.pdf | Page 1 ===\nhello\n=== A.pdf | Page 2 ===\n world \n",)], "text string")
    assert [tuple(r) for r in pages.delimited_pages(text).collect()] == [("A.pdf", 1, "hello", 5), ("A.pdf", 2, " world ", 7)]
    other = spark.createDataFrame([("doc.pdf", "in/x.pdf", 3, "hello")], "Document_ID string, Source_File string, Page_Number int, Extracted_Text string")
    assert tuple(pages.normalize_pages(other).first()) == ("doc.pdf", 3, "hello", 5)
    clip = pages.clipped_pages(spark.createDataFrame([("f", 1, "x" * 30), ("f", 2, "y" * 30)], "file string, page int, text string"), 25, 40)
    assert [(r.char_count, r.truncated, r.ocr_required) for r in clip.orderBy("page").collect()] == [(25, True, False), (15, True, False)]


def tarred(mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "m.txt"
        t.addfile(link)
    return out.getvalue()


@pytest.mark.parametrize(
    "name, payload",
    [
        ("a.zip", zipped(**{"m.txt": b"hello"})), ("a.tar", tarred("w")), ("a.tar.gz", tarred("w:gz")), ("a.tar.bz2", tarred("w:bz2")),
        ("a.tar.xz", tarred("w:xz")), ("m.txt.gz", gzip.compress(b"hello")), ("m.txt.bz2", bz2.compress(b"hello")), ("m.txt.xz", lzma.compress(b"hello")),
    ],
)
def test_archives(name, payload):
    assert list(archives.inventory(name, payload))[0][1:4] == ("m.txt", 5, "file")
    assert archives.read_range(name, payload, 0, 0, 2)[::4] == (b"he", None)
    raw, start, stop, eof, sha = archives.read_range(name, payload, 0, 2, 99)
    assert (raw, start, stop, eof) == (b"llo", 2, 5, True) and sha
    assert code(archives.inventory, name, payload, archives.Budget(source=1)) == "BUDGET_EXHAUSTED"


def test_nested_and_damaged_archives():
    nested = zipped(**{"in.tar.xz": tarred("w:xz")})
    assert archives.resolve_chain("o.zip", nested, [(0, "in.tar.xz"), (0, "m.txt")]) == ("m.txt", b"hello")
    broken = zipped(**{"in.tar.xz": tarred("w:xz")[:-1]})
    assert code(lambda: archives.resolve_chain("o.zip", broken, [(0, "in.tar.xz"), (0, "m.txt")])) == "INTEGRITY_FAILED"
    assert code(lambda: [archives.read_range("a.tar", tarred("w"), 1, 0, 1)]) == "MEMBER_NOT_READABLE"


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 9, 8, 2, 0, 0, 0) + b"\0" * 4
    assert images.header(png) == ("png", 7, 9, "RGB", 0, False, False)
    tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 0x112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 3, 4, 3) + b"\0" * 6
    assert images.header(jpeg) == ("jpeg", 4, 3, "RGB", 90, False, True)


def test_items_relation(spark):
    files = spark.createDataFrame(
        [("x/a.txt", b"one\ntwo\n\n"), ("x/b.bin", b"?"), ("x/c.html", b"<p>bad"), ("x/d.json", b'["x", "y"]')], "path string, content binary"
    )
    items = text_items(files)
    assert {(r.path, r.error) for r in items.filter("error is not null").collect()} == {("x/b.bin", "UNSUPPORTED_FORMAT"), ("x/c.html", "HTML_UNBALANCED_OR_NO_ELEMENTS")}
    assert [r.text for r in items.filter("path = 'x/a.txt'").orderBy("ordinal").collect()] == ["one", "two"]
    assert within_budget(items.filter("error is null"), max_bytes=4).count() == 3
    known = {r.name: (r.parser, r.admission) for r in inspect_files(files).collect()}
    assert known["a.txt"] == ("lines", "portable") and known["b.bin"] == (None, "unsupported")
