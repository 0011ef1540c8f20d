"""Office packages: paragraphs, tables, sheets and slides from their XML parts, with the standard library."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files
from quire.sources.packages import attribute, local, member, open_package, relations, xml

MAX_BYTES = {"docx": 16 << 20, "xlsx": 16 << 20, "pptx": 32 << 20}
MAX_CELL_ROWS, MAX_CELL_COLUMNS = 1_048_576, 16_384
# The built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def open_kind(kind: str, payload: bytes):
    if len(payload) > MAX_BYTES[kind]:
        raise SourceError("SOURCE_TOO_LARGE")
    return open_package(payload)


def _run_text(node) -> str:
    """Text of runs below a node; deleted text, fields' codes and nested paragraphs' boxes aren't part."""
    out = []
    for child in node:
        name = local(child.tag)
        if name in ("t", "delText"):
            out.append(child.text or "" if name == "t" else "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name not in ("pPr", "rPr", "instrText", "del", "txbxContent"):
            out.append(_run_text(child))
    return "".join(out)


def styles_of(package) -> dict[str, str]:
    raw = member(package, "word/styles.xml")
    names = {}
    for s in xml(raw) if raw else ():
        if local(s.tag) == "style":
            names[attribute(s, "styleId")] = next((attribute(n, "val") for n in s if local(n.tag) == "name"), "")
    return names


def heading_level(style: str) -> int:
    """1 to 6 for a style named like a heading, else 0."""
    if not style.casefold().startswith("heading"):
        return 0
    digits = re.sub(r"\D", "", style)
    return min(6, max(1, int(digits or 1)))


def body_unit(node, styles: dict[str, str]):
    """(kind, style, level, text, rows) of a paragraph or table of a body."""
    if local(node.tag) == "p":
        ref = next((attribute(s, "val") for s in node.iter() if local(s.tag) == "pStyle"), None)
        style = (styles.get(ref) or ref or "Normal") if ref else "Normal"
        return "paragraph", style, heading_level(style), _run_text(node), None
    rows = []
    for tr in (n for n in node if local(n.tag) == "tr"):
        cells = []
        for tc in (n for n in tr if local(n.tag) == "tc"):
            span = next((int(attribute(g, "val", "1")) for g in tc.iter() if local(g.tag) == "gridSpan"), 1)
            cells += ["\n".join(_run_text(p) for p in tc.iter() if local(p.tag) == "p")] * max(1, span)
        rows.append(cells)
    return "table", None, 0, None, rows


def docx_body(payload: bytes):
    """(idx, kind, style, level, text, rows) of a document's body: paragraphs and tables in order."""
    package = open_kind("docx", payload)
    styles = styles_of(package)
    root = xml(member(package, "word/document.xml"))
    body = next((n for n in root if local(n.tag) == "body"), None)
    if body is None:
        raise SourceError("DOCX_BODY_MISSING")
    for i, node in enumerate((n for n in body if local(n.tag) in ("p", "tbl")), 1):
        yield i, *body_unit(node, styles)


def docx_parts(payload: bytes):
    """(part, text) of headers, footers, notes and comments that hold text."""
    package = open_kind("docx", payload)
    for name in sorted(package.namelist()):
        if re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", name):
            text = "\n".join(t for t in (_run_text(p) for p in xml(member(package, name)).iter() if local(p.tag) == "p") if t.strip())
            if text:
                yield name, text


def docx_marks(payload: bytes):
    """(kind, name) of bookmarks, references, breaks, sections and drawings, for checks of structure."""
    package = open_kind("docx", payload)
    for n in xml(member(package, "word/document.xml")).iter():
        name = local(n.tag)
        if name == "bookmarkStart":
            yield "bookmark", attribute(n, "name")
        elif name == "instrText":
            if m := re.match(r"\s*(?:PAGEREF|NOTEREF|REF)\s+(\S+)", n.text or "", re.I):
                yield "reference", m[1]
            if "TOC" in (n.text or "").upper():
                yield "toc", (n.text or "").strip()
        elif name == "fldSimple":
            code = attribute(n, "instr", "") or ""
            if m := re.match(r"\s*(?:PAGEREF|NOTEREF|REF)\s+(\S+)", code, re.I):
                yield "reference", m[1]
            if "TOC" in code:
                yield "toc", code.strip()
        elif name == "docPartGallery" and attribute(n, "val") == "Table of Contents":
            yield "toc", ""
        elif name == "br" and attribute(n, "type") == "page":
            yield "page_break", ""
        elif name == "sectPr":
            yield "section", ""
        elif name in ("drawing", "pict"):
            yield "image", ""


def docx_units(payload: bytes):
    """(idx, breaks, filled, section) of a body's paragraphs, tables and last section, for pages that explicit breaks part."""
    package = open_kind("docx", payload)
    body = next((n for n in xml(member(package, "word/document.xml")) if local(n.tag) == "body"), None)
    for i, node in enumerate(n for n in (() if body is None else body) if local(n.tag) in ("p", "tbl", "sectPr")):
        name = local(node.tag)
        below = [local(n.tag) for n in node.iter()]
        if name == "p":
            text = "".join(n.text or "" for n in node.iter() if local(n.tag) == "t").strip()
            breaks = sum(local(n.tag) == "br" and attribute(n, "type") == "page" for n in node.iter())
            ends = any(local(n.tag) == "sectPr" for props in node if local(props.tag) == "pPr" for n in props)
            yield i, breaks, bool(text) or "drawing" in below or "pict" in below, ends
        else:
            yield i, 0, name == "tbl", name == "sectPr"


def _serial_date(value: float, epoch_1904: bool) -> str:
    base = datetime.datetime(1904, 1, 1) if epoch_1904 else datetime.datetime(1899, 12, 30)
    stamp = base + datetime.timedelta(milliseconds=round(value * 86_400_000))
    return stamp.isoformat()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook(package):
    """(sheets, value): the sheets as (name, visibility, part), and what gives a cell's (row, col, value, formula)."""
    book, links = xml(member(package, "xl/workbook.xml")), relations(package, "xl/workbook.xml")
    raw = member(package, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in (xml(raw) if raw else ()) if local(si.tag) == "si"]
    raw = member(package, "xl/styles.xml")
    dates: list[bool] = []
    if raw:
        styles = xml(raw)
        own = {attribute(f, "numFmtId"): attribute(f, "formatCode", "") for f in styles.iter() if local(f.tag) == "numFmt"}
        for xf in (x for c in styles if local(c.tag) == "cellXfs" for x in c):
            fmt = attribute(xf, "numFmtId", "0")
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(fmt, "")).lower()
            dates.append(int(fmt) in DATE_FORMATS or (fmt in own and any(c in code for c in "ymdhs")))
    old = any(local(n.tag) == "workbookPr" and attribute(n, "date1904") in ("1", "true") for n in book)

    def cell(c):
        kind, style, ref = attribute(c, "t", "n"), int(attribute(c, "s", "0")), attribute(c, "r")
        inner = {local(x.tag): x for x in c}
        formula = "=" + (inner["f"].text or "") if "f" in inner else None
        value = inner["v"].text if "v" in inner else None
        if kind == "s" and value is not None:
            value = shared[int(value)]
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
        elif kind == "b":
            value = "true" if value == "1" else "false"
        elif kind == "n" and value is not None:
            number = float(value)
            if style < len(dates) and dates[style]:
                value = _serial_date(number, old)
            else:
                value = str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
        return int(re.search(r"\d+", ref)[0]), _column(ref), value, formula

    sheets = [s for n in book if local(n.tag) == "sheets" for s in n]
    return [(attribute(s, "name"), attribute(s, "state", "visible"), links.get(attribute(s, "id")) or "") for s in sheets], cell


def xlsx_cells(payload: bytes):
    """(sheet_ix, sheet, visible, row, col, value, formula) of the cells with a value, counted from 1."""
    package = open_kind("xlsx", payload)
    sheets, cell = workbook(package)
    for ix, (name, visible, part) in enumerate(sheets):
        for c in (c for c in xml(member(package, part)).iter() if local(c.tag) == "c"):
            row, col, value, formula = cell(c)
            if value is not None or formula:
                yield ix, name, visible, row, col, value, formula


def slide_parts(package) -> list[str]:
    """The parts of a deck's slides in order."""
    deck, links = xml(member(package, "ppt/presentation.xml")), relations(package, "ppt/presentation.xml")
    order = [attribute(n, "id") for n in deck.iter() if local(n.tag) == "sldId"]
    ids = [v for n in deck.iter() if local(n.tag) == "sldId" for k, v in n.attrib.items() if k.endswith("}id")] or order
    return [links.get(ref) or "" for ref in ids]


def slide_content(package, part: str):
    """(shape, kind, text, rows) of a slide's titles, texts, tables, pictures and notes, in order."""
    root = xml(member(package, part))
    text_of = lambda n: "\n".join(_run_text(p) for p in n.iter() if local(p.tag) == "p")
    shapes = [n for n in root.iter() if local(n.tag) in ("sp", "graphicFrame", "pic")]
    for k, shape in enumerate(shapes, 1):
        name = local(shape.tag)
        holder = next((attribute(p, "type", "body") for p in shape.iter() if local(p.tag) == "ph"), None)
        table = next((t for t in shape.iter() if local(t.tag) == "tbl"), None)
        if table is not None:
            rows = [[text_of(tc) for tc in tr if local(tc.tag) == "tc"] for tr in table if local(tr.tag) == "tr"]
            yield k, "table", None, rows
        elif name == "pic":
            yield k, "image", None, None
        elif name == "sp":
            yield k, "title" if holder in ("title", "ctrTitle") else "text", text_of(shape), None
    notes = [t for t in relations(package, part).values() if "notesSlide" in t]
    for t in notes:
        text = "\n".join(x for x in (_run_text(p) for p in xml(member(package, t)).iter() if local(p.tag) == "p") if x.strip())
        if text:
            yield 0, "notes", text, None


def pptx_shapes(payload: bytes):
    """(slide, shape, kind, text, rows) of all slides."""
    package = open_kind("pptx", payload)
    for number, part in enumerate(slide_parts(package), 1):
        for shape in slide_content(package, part):
            yield number, *shape


def docx_paragraphs(files: DataFrame) -> DataFrame:
    return parse_files(
        files, "idx int, kind string, style string, level int, text string, rows array<array<string>>", lambda n, p: docx_body(p)
    )


def docx_structure(files: DataFrame) -> DataFrame:
    return parse_files(files, "kind string, name string", lambda n, p: docx_marks(p))


def docx_pages(files: DataFrame) -> DataFrame:
    return parse_files(files, "idx int, breaks int, filled boolean, section boolean", lambda n, p: docx_units(p))


def docx_stories(files: DataFrame) -> DataFrame:
    return parse_files(files, "part string, text string", lambda n, p: docx_parts(p))


def workbook_cells(files: DataFrame) -> DataFrame:
    return parse_files(
        files, "sheet_ix int, sheet string, visible string, row int, col int, value string, formula string", lambda n, p: xlsx_cells(p)
    )


def slide_shapes(files: DataFrame) -> DataFrame:
    return parse_files(files, "slide int, shape int, kind string, text string, rows array<array<string>>", lambda n, p: pptx_shapes(p))
