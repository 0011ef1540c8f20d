"""OpenDocument text, sheets and slides; tracked deletions, notes to the text and objects aren't items."""

from __future__ import annotations

from quire.sources.base import SourceError
from quire.sources.packages import attribute, local, member, open_package, xml

MAX_SOURCE, MAX_XML, MAX_NODES, MAX_REPEAT = 4 << 20, 2 << 20, 20_000, 4096
SKIPPED = {"annotation", "annotation-end", "tracked-changes", "note", "object", "notes"}


def inline(node) -> str:
    """The text of a paragraph with its spaces, tabs and breaks."""
    out = [node.text or ""]
    for child in node:
        name = local(child.tag)
        if name == "s":
            out.append(" " * min(MAX_REPEAT, int(attribute(child, "c", "1"))))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in SKIPPED:
            out.append(inline(child))
        out.append(child.tail or "")
    return "".join(out)


def _paragraphs(node):
    """Paragraphs and headings below a node, in document order, outside of what is skipped."""
    for child in node:
        name = local(child.tag)
        if name in SKIPPED:
            continue
        if name in ("p", "h"):
            yield child
        else:
            yield from _paragraphs(child)


def _body(payload: bytes, kind: str):
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    raw = member(open_package(payload, 256, 8 << 20), "content.xml")
    if raw and len(raw) > MAX_XML:
        raise SourceError("ODF_XML_LIMIT")
    root = xml(raw)
    if sum(1 for _ in root.iter()) > MAX_NODES:
        raise SourceError("ODF_NODE_LIMIT")
    hidden = {
        attribute(s, "name")
        for s in root.iter()
        if local(s.tag) == "style" and any(local(p.tag) == "table-properties" and attribute(p, "display") == "false" for p in s)
    }
    for node in root.iter():
        if local(node.tag) == kind:
            return node, hidden
    raise SourceError("ODF_BODY_MISSING")


def cells(payload: bytes):
    """(sheet, row, column, formula, text) of the cells of visible sheets, counted from 1."""
    body, hidden = _body(payload, "spreadsheet")
    for sheet in (t for t in body if local(t.tag) == "table" and attribute(t, "style-name") not in hidden):
        row = 0
        for line in (r for r in sheet.iter() if local(r.tag) == "table-row"):
            column = 0
            for cell in line:
                if local(cell.tag) in ("table-cell", "covered-table-cell"):
                    column += 1
                    text = "\n".join(inline(p) for p in _paragraphs(cell))
                    if text and local(cell.tag) == "table-cell":
                        yield attribute(sheet, "name"), row + 1, column, attribute(cell, "formula"), text
                    column += int(attribute(cell, "number-columns-repeated", "1")) - 1
            row += int(attribute(line, "number-rows-repeated", "1"))


def read(name: str, payload: bytes):
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix == "ods":
        for sheet, row, column, _, text in cells(payload):
            yield ["ods-cell-xml", sheet, row, column, 1], text, "cell"
    elif suffix == "odt":
        body, _ = _body(payload, "text")
        for i, p in enumerate(_paragraphs(body), 1):
            yield ["odt-paragraph-xml", i], inline(p), "heading" if local(p.tag) == "h" else "paragraph"
    else:
        body, _ = _body(payload, "presentation")
        for s, page in enumerate((p for p in body if local(p.tag) == "page"), 1):
            for i, p in enumerate(_paragraphs(page), 1):
                yield ["odp-slide-text-xml", s, i], inline(p), "slide"
