"""Edits of DOCX files, one document a row: sections, tables by row label, front matter, contents, footers,
page breaks, marks of terms. An edit is data, so a plan of edits is a column and runs over any number of files.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources.base import SourceError
from quire.sources.packages import attribute, local, member, open_package, xml

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
for _prefix, _uri in (
    ("w", _W), ("r", _R), ("wp", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"),
    ("a", "http://schemas.openxmlformats.org/drawingml/2006/main"), ("pic", "http://schemas.openxmlformats.org/drawingml/2006/picture"),
):
    ET.register_namespace(_prefix, _uri)


def _q(name: str) -> str:
    return f"{{{_W}}}{name}"


def _text(p) -> str:
    return "".join(t.text or "" for t in p.iter(_q("t")))


def _norm(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def _label(text: str) -> str:
    return re.sub(r"\s+", "", text)


class Document:
    """The body of a DOCX package with what edits need; styles go by name."""

    def __init__(self, payload: bytes):
        self.package = open_package(payload)
        self.parts: dict[str, bytes] = {}
        self.root = xml(member(self.package, "word/document.xml"))
        self.body = self.root.find(_q("body"))
        if self.body is None:
            raise SourceError("DOCX_BODY_MISSING")
        raw = member(self.package, "word/styles.xml")
        found = xml(raw).iter(_q("style")) if raw else ()
        self.style_names = {attribute(s, "styleId"): attribute(s.find(_q("name")), "val", "") for s in found if s.find(_q("name")) is not None}

    def style(self, p) -> str:
        s = p.find(f"{_q('pPr')}/{_q('pStyle')}")
        return "Normal" if s is None else self.style_names.get(attribute(s, "val"), attribute(s, "val"))

    def style_id(self, name: str | None) -> str | None:
        return next((k for k, v in self.style_names.items() if v == name), name)

    def is_heading(self, node) -> bool:
        return node.tag == _q("p") and self.style(node).casefold().startswith("heading") and bool(_text(node).strip())

    def section(self, heading: str) -> tuple[int, int]:
        """Where the content of a section begins and ends among the body's children; equal names go before contained ones."""
        nodes = list(self.body)
        heads = [i for i, n in enumerate(nodes) if self.is_heading(n)]
        want = _norm(heading)
        at = next((i for i in heads if _norm(_text(nodes[i])) == want), None)
        at = next((i for i in heads if want and want in _norm(_text(nodes[i]))), None) if at is None else at
        if at is None:
            raise SourceError("SECTION_NOT_FOUND")
        end = next((i for i in heads if i > at), len(nodes))
        while end > at + 1 and nodes[end - 1].tag == _q("sectPr"):
            end -= 1
        return at + 1, end

    def paragraph(self, text: str, style: str | None = None):
        p = ET.Element(_q("p"))
        if style:
            ET.SubElement(ET.SubElement(p, _q("pPr")), _q("pStyle"), {_q("val"): self.style_id(style)})
        self.add_run(p, text)
        return p

    def add_run(self, p, text: str):
        t = ET.SubElement(ET.SubElement(p, _q("r")), _q("t"), {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
        t.text = text

    def set_text(self, p, text: str) -> None:
        """All text of a paragraph in its first run; the run keeps its looks."""
        texts = list(p.iter(_q("t")))
        if not texts:
            self.add_run(p, text)
        for k, t in enumerate(texts):
            t.text = text if k == 0 else ""

    def field(self, p, instruction: str) -> None:
        for kind in ("begin", None, "end"):
            r = ET.SubElement(p, _q("r"))
            if kind:
                ET.SubElement(r, _q("fldChar"), {_q("fldCharType"): kind})
            else:
                ET.SubElement(r, _q("instrText")).text = f" {instruction} "

    def property(self, p, name: str, **values: str):
        """Set a property of a paragraph, replacing one of that name."""
        props = p.find(_q("pPr"))
        if props is None:
            props = ET.Element(_q("pPr"))
            p.insert(0, props)
        for old in props.findall(_q(name)):
            props.remove(old)
        return ET.SubElement(props, _q(name), {_q(k): v for k, v in values.items()})

    def save(self) -> bytes:
        for key in [k for k in self.root.attrib if local(k) == "Ignorable"]:
            del self.root.attrib[key]  # it names prefixes that may not be declared any more
        self.parts["word/document.xml"] = ET.tostring(self.root, encoding="UTF-8", xml_declaration=True)
        out, done = io.BytesIO(), set()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in [*self.package.namelist(), *self.parts]:
                if name not in done:
                    done.add(name)
                    data = self.parts[name] if name in self.parts else self.package.read(name)
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()


def replace_section(d: Document, heading: str, paragraphs: list[str], style: str | None = None) -> int:
    """New paragraphs for a section; its tables and section marks stay after them."""
    start, end = d.section(heading)
    for node in list(d.body)[start:end]:
        if node.tag == _q("p") and node.find(f"{_q('pPr')}/{_q('sectPr')}") is None:
            d.body.remove(node)
    for k, text in enumerate(paragraphs):
        d.body.insert(start + k, d.paragraph(text, style))
    return len(paragraphs)


def fill_table(d: Document, heading: str, values: dict[str, str], label_col: int = 0, value_col: int = 1) -> int:
    """Values into the first table of a section by row label: equal first, else the first that contains or is contained."""
    start, end = d.section(heading)
    table = next((n for n in list(d.body)[start:end] if n.tag == _q("tbl")), None)
    if table is None:
        raise SourceError("TABLE_NOT_FOUND")
    keys, filled = {_label(k): v for k, v in values.items()}, 0
    for row in table.iter(_q("tr")):
        cells = row.findall(_q("tc"))
        if len(cells) <= max(label_col, value_col):
            continue
        label = _label("".join(map(_text, cells[label_col].iter(_q("p")))))
        key = label if label in keys else next((k for k in keys if label and (k in label or label in k)), None)
        if key is not None:
            ps = cells[value_col].findall(_q("p")) or [ET.SubElement(cells[value_col], _q("p"))]
            d.set_text(ps[0], keys[key])
            for p in ps[1:]:
                d.set_text(p, "")
            filled += 1
    return filled


def front_matter(d: Document, prefix: str, text: str, occurrence: int = 1) -> int:
    """The nth paragraph before the first heading that begins with a prefix gets a new text."""
    seen = 0
    for node in d.body:
        if d.is_heading(node):
            break
        if node.tag == _q("p") and " ".join(_text(node).split()).startswith(prefix):
            seen += 1
            if seen == occurrence:
                d.set_text(node, text)
                return 1
    raise SourceError("ANCHOR_NOT_FOUND")


def insert_toc(d: Document, after: str, switches: str = 'TOC \\o "1-3" \\h \\z \\u') -> int:
    """A contents field after a heading, unless the document has one."""
    if any(re.match(r"\s*TOC\b", t.text or "") for t in d.root.iter(_q("instrText"))):
        return 0
    start, _ = d.section(after)
    p = ET.Element(_q("p"))
    d.field(p, switches)
    d.body.insert(start, p)
    return 1


def heading_breaks(d: Document, styles: list[str], first_without: bool = True) -> int:
    """A page break before each heading of the styles, but the first if so asked."""
    n = 0
    for node in d.body:
        if d.is_heading(node) and d.style(node) in styles:
            d.property(node, "pageBreakBefore", val="0" if n == 0 and first_without else "1")
            n += 1
    return n


def fit_tables(d: Document, width: int = 5000) -> int:
    """Every table as wide as the page, in fiftieths of a percent."""
    tables = list(d.body.iter(_q("tbl")))
    for t in tables:
        props = t.find(_q("tblPr"))
        if props is None:
            props = ET.Element(_q("tblPr"))
            t.insert(0, props)
        for old in props.findall(_q("tblW")):
            props.remove(old)
        ET.SubElement(props, _q("tblW"), {_q("w"): str(width), _q("type"): "pct"})
    return len(tables)


def highlight(d: Document, terms: list[str], color: str = "yellow") -> int:
    """Mark every run that holds a term."""
    n = 0
    for run in d.body.iter(_q("r")):
        text = "".join(t.text or "" for t in run.findall(_q("t")))
        if any(term and term in text for term in terms):
            props = run.find(_q("rPr"))
            if props is None:
                props = ET.Element(_q("rPr"))
                run.insert(0, props)
            if props.find(_q("highlight")) is None:
                ET.SubElement(props, _q("highlight"), {_q("val"): color})
                n += 1
    return n


def clear_highlights(d: Document) -> int:
    n = 0
    for props in d.body.iter(_q("rPr")):
        for mark in props.findall(_q("highlight")):
            props.remove(mark)
            n += 1
    return n


def remove_images(d: Document, heading: str) -> int:
    """Drop the pictures of a section."""
    start, end = d.section(heading)
    n = 0
    for node in list(d.body)[start:end]:
        for run in list(node.iter(_q("r"))):
            for drawing in [x for x in run if local(x.tag) in ("drawing", "pict")]:
                run.remove(drawing)
                n += 1
    return n


def page_footer(d: Document, prefix: str = "Page ", middle: str = " of ") -> int:
    """A footer with the page's number and their total, for the last section."""
    footer = ET.Element(_q("ftr"))
    p = ET.SubElement(footer, _q("p"))
    d.add_run(p, prefix)
    d.field(p, "PAGE")
    d.add_run(p, middle)
    d.field(p, "NUMPAGES")
    name = "word/footer900.xml"
    d.parts[name] = ET.tostring(footer, encoding="UTF-8", xml_declaration=True)
    types = xml(member(d.package, "[Content_Types].xml"))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.footer+xml"
    ET.SubElement(types, f"{{{_TYPES}}}Override", {"PartName": f"/{name}", "ContentType": kind})
    d.parts["[Content_Types].xml"] = ET.tostring(types, encoding="UTF-8", xml_declaration=True)
    raw = member(d.package, "word/_rels/document.xml.rels")
    rels = xml(raw) if raw else ET.Element(f"{{{_RELS}}}Relationships")
    ET.SubElement(rels, f"{{{_RELS}}}Relationship", {"Id": "rIdPages", "Type": f"{_R}/footer", "Target": "footer900.xml"})
    d.parts["word/_rels/document.xml.rels"] = ET.tostring(rels, encoding="UTF-8", xml_declaration=True)
    section = d.body.find(_q("sectPr"))
    if section is None:
        section = ET.SubElement(d.body, _q("sectPr"))
    for old in [x for x in section.findall(_q("footerReference")) if attribute(x, "type") in (None, "default")]:
        section.remove(old)
    section.insert(0, ET.Element(_q("footerReference"), {_q("type"): "default", f"{{{_R}}}id": "rIdPages"}))
    return 1


EDITS = {
    f.__name__: f
    for f in (replace_section, fill_table, front_matter, insert_toc, heading_breaks, fit_tables, highlight, clear_highlights, remove_images, page_footer)
}


def edit(payload: bytes, plan: list[dict]) -> tuple[bytes, list[int]]:
    """Apply edits, each a name under ``edit`` with its arguments, and say how much each did."""
    d = Document(payload)
    done = []
    for step in plan:
        name = step.get("edit")
        if name not in EDITS:
            raise SourceError("UNKNOWN_EDIT")
        done.append(EDITS[name](d, **{k: v for k, v in step.items() if k != "edit"}))
    return d.save(), done


def edit_documents(files: DataFrame) -> DataFrame:
    """(path, content, counts, error) of files (path, content, plan); ``plan`` is a JSON list of edits."""
    import json

    def run(batches):
        for b in batches:
            rows = []
            for path, content, plan in zip(*(b[c].to_pylist() for c in ("path", "content", "plan"))):
                try:
                    rows.append((path, *edit(content or b"", json.loads(plan or "[]")), None))
                except SourceError as e:
                    rows.append((path, None, None, str(e)))
                except (TypeError, ValueError, AttributeError):
                    rows.append((path, None, None, "PLAN_INVALID"))
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "content", "counts", "error"])

    return files.select("path", "content", "plan").mapInArrow(run, "path string, content binary, counts array<int>, error string")
