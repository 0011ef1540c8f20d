"""Content blocks written as files: CSV, and Office packages made with the standard library.

A document is one row (name, blocks: array of content blocks), so a writer is an Arrow batch
function and scales with the rows; every output is checked against its format's mark.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources.base import pieces

MARKS = {"xlsx": b"PK\x03\x04", "docx": b"PK\x03\x04", "pptx": b"PK\x03\x04", "pdf": b"%PDF-"}
MEDIA = {
    "csv": "text/csv",
    "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9 ._-]{0,127}")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def check_name(name: str, kind: str) -> None:
    """A plain file name with the ending of its format."""
    if not NAME.fullmatch(name) or not name.lower().endswith(f".{kind}"):
        raise ValueError("OUTPUT_NAME_INVALID")


def lines_of(block: dict) -> list[list[str]]:
    """A block as rows of cells."""
    kind = block["kind"]
    if kind in ("table", "sheet"):
        return [list(r) for r in block["rows"] or []]
    if kind == "key_values":
        return [[p["label"], p["value"]] for p in block["pairs"] or []]
    head = [[block["text"]]] if block.get("text") else []
    return head + [[p] for p in block.get("paragraphs") or []]


def to_csv(blocks: list[dict]) -> bytes:
    """The first table or sheet alone, else all blocks flattened."""
    tables = [b for b in blocks if b["kind"] in ("table", "sheet")]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(lines_of(tables[0]) if tables else [r for b in blocks for r in lines_of(b)])
    return out.getvalue().encode()


def _package(parts: dict[str, str]) -> bytes:
    """A zip with fixed times, so that equal content is equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text if text.startswith("<?xml") else _XML + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _types(overrides: dict[str, str]) -> str:
    own = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in overrides.items())
    return (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
        f'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{own}</Types>'
    )


def _rels(targets: list[tuple[str, str]]) -> str:
    own = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{t}"/>' for i, (kind, t) in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}</Relationships>'


def sheet_names(wanted: list[str]) -> list[str]:
    """Names that a workbook may have: at most 31 characters, without what sheets can't be named, each different when case is ignored.

    The names of content blocks follow a rule of their own, see ``quire.sources.blocks.sheet_name``.
    """
    out, used = [], set()
    for name in wanted:
        base = re.sub(r"[\[\]:*?/\\]", " ", name or "Sheet").strip()[:31] or "Sheet"
        one, k = base, 1
        while one.casefold() in used:
            k += 1
            one = f"{base[: 31 - len(str(k)) - 1]}-{k}"
        used.add(one.casefold())
        out.append(one)
    return out


def _ref(row: int, col: int) -> str:
    letters = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row + 1}"


def to_xlsx(blocks: list[dict]) -> bytes:
    some = [b for b in blocks if b["kind"] == "sheet"] + [b for b in blocks if b["kind"] == "table"]
    grids = [lines_of(b) for b in some] or [[r for b in blocks for r in lines_of(b)]]
    names = sheet_names([b.get("name") or "Sheet" for b in some] or ["Sheet"])
    parts = {}
    for i, grid in enumerate(grids, 1):
        cell = lambda r, c, v: f'<c r="{_ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>'
        rows = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(grid))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S}"><sheetData>{rows}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return _package(
        {
            "[Content_Types].xml": _types({"xl/workbook.xml": f"{base}.sheet.main+xml", **{p: f"{base}.worksheet+xml" for p in parts}}),
            "_rels/.rels": _rels([("officeDocument", "xl/workbook.xml")]),
            "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _rels([("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(grids) + 1)]),
            **parts,
        }
    )


def _paragraph(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text or "")}</w:t></w:r></w:p>'


def to_docx(blocks: list[dict]) -> bytes:
    body = []
    for b in blocks:
        if b["kind"] == "heading":
            body.append(_paragraph(b["text"], f"Heading{b.get('level') or 1}"))
        elif b["kind"] in ("table", "sheet"):
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in lines_of(b))
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            body += [_paragraph(": ".join(r)) for r in lines_of(b)]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    base = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return _package(
        {
            "[Content_Types].xml": _types({"word/document.xml": f"{base}.document.main+xml", "word/styles.xml": f"{base}.styles+xml"}),
            "_rels/.rels": _rels([("officeDocument", "word/document.xml")]),
            "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
            "word/_rels/document.xml.rels": _rels([("styles", "styles.xml")]),
            "word/styles.xml": f'<w:styles xmlns:w="{_W}">{styles}</w:styles>',
        }
    )


#: Lines of a written slide.
SLIDE_LINES = 20


def to_pptx(blocks: list[dict]) -> bytes:
    """A slide for each block, tables as lines; what goes beyond the lines of a slide goes on on further slides of its title."""
    slides, parted = {}, []
    for b in blocks:
        lines = [" | ".join(c or "" for c in r) for r in lines_of(b)]
        title = b.get("name") or (lines.pop(0) if b["kind"] in ("heading", "slide") and lines else "")
        parted += [(title, lines[k : k + SLIDE_LINES]) for k in range(0, max(1, len(lines)), SLIDE_LINES)]
    for i, (title, lines) in enumerate(parted, 1):
        shape = lambda k, kind, rows: (
            f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>'
            + "".join(f"<a:p><a:r><a:t>{escape(x or '')}</a:t></a:r></a:p>" for x in rows or [""])
            + "</p:txBody></p:sp>"
        )
        tree = shape(2, "title", [title]) + shape(3, "body", lines)
        slides[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="{_P}" xmlns:a="{_A}"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    base = "application/vnd.openxmlformats-officedocument.presentationml"
    return _package(
        {
            "[Content_Types].xml": _types({"ppt/presentation.xml": f"{base}.presentation.main+xml", **{s: f"{base}.slide+xml" for s in slides}}),
            "_rels/.rels": _rels([("officeDocument", "ppt/presentation.xml")]),
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{_P}" xmlns:r="{_REL}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _rels([("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]),
            **slides,
        }
    )


#: A font that every viewer has for text beyond Latin-1, and its encoding: two bytes a character.
_CJK = (
    b"<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 "
    b"/BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /DW 1000 >>] >>"
)


def to_pdf(blocks: list[dict], width: int = 95, per_page: int = 56) -> bytes:
    """Plain pages of text in a built-in font: one byte a character, or two where a text goes beyond Latin-1.

    Characters beyond the first plane have no place in either font; a document that holds one is refused.
    """
    texts = [" | ".join(c or "" for c in r) for b in blocks for r in lines_of(b)]
    wide = any(c > "\xff" for t in texts for c in t)
    if any(c > "\uffff" for t in texts for c in t):
        raise ValueError("PDF_TEXT_UNSUPPORTED")
    shown = (lambda x: b"<" + x.encode("utf-16-be").hex().encode() + b">") if wide else (
        lambda x: b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("latin-1")) + b")"
    )
    width = width // 2 if wide else width
    lines = [x for t in texts for x in (re.findall(f".{{1,{width}}}", t) or [""])]
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    font = _CJK if wide else b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", font]
    kids = []
    for page in pages:
        text = b"".join(shown(x) + b" Tj T*\n" for x in page)
        stream = b"BT /F1 10 Tf 13 TL 50 790 Td\n" + text + b"ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


WRITERS = {"csv": to_csv, "xlsx": to_xlsx, "docx": to_docx, "pptx": to_pptx, "pdf": to_pdf}


def write_blocks(documents: DataFrame, kind: str, max_bytes: int = 32 << 20) -> DataFrame:
    """(output_name, media_type, content, sha256, code) of documents (output_name, blocks)."""
    import hashlib

    if kind not in WRITERS:
        raise ValueError(f"unknown format {kind!r}")

    def run(batches):
        for b in pieces(batches):
            rows = []
            for name, blocks in zip(b["output_name"].to_pylist(), b["blocks"].to_pylist()):
                try:
                    check_name(name or "", kind)
                    content = WRITERS[kind](blocks or [])
                    if len(content) > max_bytes:
                        raise ValueError("OUTPUT_TOO_LARGE")
                    if not content.startswith(MARKS.get(kind, b"")):
                        raise ValueError("OUTPUT_FORMAT_MISMATCH")
                    rows.append((name, MEDIA[kind], content, hashlib.sha256(content).hexdigest(), "WRITTEN"))
                except ValueError as e:
                    rows.append((name, MEDIA[kind], None, None, str(e)))
            kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
            names = ["output_name", "media_type", "content", "sha256", "code"]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return documents.select("output_name", "blocks").mapInArrow(
        run, "output_name string, media_type string, content binary, sha256 string, code string"
    )
