"""The structure of tables in Office files: size, header rows, merges, columns and fixed labels, without judging content."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files
from quire.sources.ooxml import _run_text, open_kind, styles_of, xlsx_cells
from quire.sources.packages import attribute, local, member, relations, xml

TABLE = (
    "table_id string, ordinal int, anchor string, row_count int, column_count int, header_rows array<int>, merge_ranges array<string>, "
    "columns array<struct<ordinal:int,header:string,width_points:double,alignment:string,text_direction:string>>, "
    "fixed_row_labels array<string>, style struct<style_name:string,border_digest:string,shading_digest:string>"
)
# Names of alignments in the three formats, and points of their units.
ALIGNMENTS = {"left": "left", "start": "left", "l": "left", "center": "center", "ctr": "center", "right": "right", "end": "right", "r": "right"}
ALIGNMENTS |= {"both": "justify", "just": "justify", "justify": "justify"}
TWIPS, EMU = 20, 12_700


def letters(column: int) -> str:
    """The name of a column counted from 0."""
    name = ""
    while column >= 0:
        column, r = divmod(column, 26)
        name, column = chr(65 + r) + name, column - 1
    return name


def _one(values: set[str]) -> str:
    some = values - {"unspecified"}
    return some.pop() if len(some) == 1 else "mixed" if some else "unspecified"


def _below(node, *names):
    return [n for n in node if local(n.tag) in names]


def _texts(cell) -> str:
    return "\n".join(_run_text(p) for p in cell.iter() if local(p.tag) == "p")


def _aligned(cell, holder: str, name: str) -> set[str]:
    """The alignments of a cell's paragraphs; ``holder`` has it in attribute or child ``name``."""
    found = set()
    for p in (n for n in cell.iter() if local(n.tag) == "p"):
        value = None
        for props in _below(p, holder):
            value = attribute(props, name) or next((attribute(j, "val") for j in _below(props, name)), None)
        found.add(ALIGNMENTS.get(value or "", "unspecified"))
    return found


def _spans(grid: dict[tuple[int, int], int]) -> list[str]:
    """The ranges of cells that cover more than one place of a grid (row, column) -> cell."""
    boxes: dict[int, list[tuple[int, int]]] = {}
    for place, cell in grid.items():
        boxes.setdefault(cell, []).append(place)
    found = set()
    for places in boxes.values():
        if len(places) > 1:
            rows, cols = zip(*places)
            found.add(f"{letters(min(cols))}{min(rows) + 1}:{letters(max(cols))}{max(rows) + 1}")
    return sorted(found)


def _profile(table_id, ordinal, anchor, rows, headers, merges, columns, labels, style):
    names = ("ordinal", "header", "width_points", "alignment", "text_direction")
    listed = [dict(zip(names, (i, *c, "unspecified"))) for i, c in enumerate(columns)]
    own = dict(zip(("style_name", "border_digest", "shading_digest"), (*style, None, None)))
    return table_id, ordinal, anchor, rows, len(columns), headers, merges, listed, labels, own


def docx_tables(payload: bytes):
    package = open_kind("docx", payload)
    styles, root = styles_of(package), xml(member(package, "word/document.xml"))
    body = next((n for n in root if local(n.tag) == "body"), None)
    if body is None:
        raise SourceError("DOCX_BODY_MISSING")
    for ordinal, table in enumerate(_below(body, "tbl")):
        grid, cells, upward, number = {}, {}, {}, 0
        rows, headers = _below(table, "tr"), []
        for r, tr in enumerate(rows):
            c = 0
            if any(local(n.tag) == "tblHeader" for props in _below(tr, "trPr") for n in props):
                headers.append(r)
            for tc in _below(tr, "tc"):
                props = [n for p in _below(tc, "tcPr") for n in p]
                span = next((int(attribute(n, "val", "1")) for n in props if local(n.tag) == "gridSpan"), 1)
                merge = next((attribute(n, "val") or "continue" for n in props if local(n.tag) == "vMerge"), None)
                if merge == "continue" and c in upward:
                    owner = upward[c]
                else:
                    owner, number = number, number + 1
                    cells[owner] = tc
                for k in range(max(1, span)):
                    grid[r, c + k] = owner
                    if merge:
                        upward[c + k] = owner
                    else:
                        upward.pop(c + k, None)
                c += max(1, span)
        width = max((c + 1 for _, c in grid), default=0)
        if not width:
            continue
        at = lambda r, c: cells[grid[r, c]] if (r, c) in grid else None
        widths = [attribute(g, "w") for d in _below(table, "tblGrid") for g in _below(d, "gridCol")]
        columns = []
        head = headers[0] if headers else 0
        for c in range(width):
            own = at(head, c)
            align = _one({a for r in range(len(rows)) if at(r, c) is not None for a in _aligned(at(r, c), "pPr", "jc")})
            points = round(int(widths[c]) / TWIPS, 4) if c < len(widths) and (widths[c] or "").isdigit() else None
            columns.append((_texts(own).strip() if own is not None else "", points, align))
        labels = [t for r in range(1, len(rows)) if at(r, 0) is not None and (t := _texts(at(r, 0)).strip())]
        ref = next((attribute(n, "val") for p in _below(table, "tblPr") for n in _below(p, "tblStyle")), None)
        yield _profile(f"table:{ordinal + 1:04d}", ordinal, None, len(rows), headers, _spans(grid), columns, labels, (styles.get(ref, ref or ""),))


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def xlsx_tables(payload: bytes):
    package = open_kind("xlsx", payload)
    book, links = xml(member(package, "xl/workbook.xml")), relations(package, "xl/workbook.xml")
    values: dict[int, dict[tuple[int, int], str]] = {}
    for ix, _, _, row, col, value, formula in xlsx_cells(payload):
        values.setdefault(ix, {})[row, col] = formula or value
    raw = member(package, "xl/styles.xml")
    formats = [x for c in (xml(raw) if raw else ()) if local(c.tag) == "cellXfs" for x in c]
    aligned = [ALIGNMENTS.get(next((attribute(a, "horizontal", "") for a in _below(x, "alignment")), ""), "unspecified") for x in formats]
    for ordinal, s in enumerate(s for n in book if local(n.tag) == "sheets" for s in n):
        sheet, own = xml(member(package, links.get(attribute(s, "id")) or "")), values.get(ordinal, {})
        used = {}
        for c in (n for n in sheet.iter() if local(n.tag) == "c"):
            m = re.match(r"([A-Z]+)(\d+)", attribute(c, "r", ""))
            col = 0
            for ch in m[1]:
                col = col * 26 + ord(ch) - 64
            used[int(m[2]), col] = int(attribute(c, "s", "0"))
        rows, width = max((r for r, _ in used), default=1), max((c for _, c in used), default=1)
        sizes = {}
        for c in (n for d in _below(sheet, "cols") for n in d):
            sizes |= {k: float(attribute(c, "width", "13")) for k in range(int(attribute(c, "min")), min(width, int(attribute(c, "max"))) + 1)}
        columns = []
        for c in range(1, width + 1):
            align = _one({aligned[f] for (_, k), f in used.items() if k == c and f < len(aligned)})
            columns.append((str(own.get((1, c)) or "").strip(), round(sizes.get(c, 13.0) * 7.0, 4), align))
        labels = [str(own[r, 1]).strip() for r in range(2, rows + 1) if own.get((r, 1)) not in (None, "")]
        merges = sorted(attribute(m, "ref") for d in _below(sheet, "mergeCells") for m in d)
        look = [[r, c, f] for (r, c), f in sorted(used.items())]
        part = lambda name: [attribute(x, name, "0") for x in formats]
        style = ("worksheet", _digest([look, part("borderId")]), _digest([look, part("fillId")]))
        yield _profile(f"sheet:{ordinal + 1:04d}", ordinal, attribute(s, "name"), rows, [0], merges, columns, labels, style)


def pptx_tables(payload: bytes):
    package = open_kind("pptx", payload)
    deck, links = xml(member(package, "ppt/presentation.xml")), relations(package, "ppt/presentation.xml")
    ids = [v for n in deck.iter() if local(n.tag) == "sldId" for k, v in n.attrib.items() if k.endswith("}id")]
    ordinal = 0
    for slide, ref in enumerate(ids, 1):
        root = xml(member(package, links.get(ref) or ""))
        tree = next((n for n in root.iter() if local(n.tag) == "spTree"), root)
        for k, shape in enumerate(_below(tree, "sp", "graphicFrame", "pic", "grpSp", "cxnSp"), 1):
            table = next((t for t in shape.iter() if local(t.tag) == "tbl"), None) if local(shape.tag) == "graphicFrame" else None
            if table is None:
                continue
            rows = [_below(tr, "tc") for tr in _below(table, "tr")]
            widths = [attribute(g, "w") for d in _below(table, "tblGrid") for g in _below(d, "gridCol")]
            width, grid, number = len(widths) or max(map(len, rows), default=0), {}, 0
            for r, cells in enumerate(rows):
                for c, tc in enumerate(cells):
                    if attribute(tc, "hMerge") in ("1", "true") and (r, c - 1) in grid:
                        grid[r, c] = grid[r, c - 1]
                    elif attribute(tc, "vMerge") in ("1", "true") and (r - 1, c) in grid:
                        grid[r, c] = grid[r - 1, c]
                    else:
                        grid[r, c], number = number, number + 1
            columns = []
            for c in range(width):
                align = _one({a for cells in rows if c < len(cells) for a in _aligned(cells[c], "pPr", "algn")})
                head = _texts(rows[0][c]).strip() if rows and c < len(rows[0]) else ""
                columns.append((head, round(int(widths[c]) / EMU, 4) if c < len(widths) else None, align))
            labels = [t for cells in rows[1:] if cells and (t := _texts(cells[0]).strip())]
            yield _profile(f"slide:{slide}:table:{k}", ordinal, f"slide:{slide}/shape:{k}", len(rows), [0], _spans(grid), columns, labels, ("pptx-table",))
            ordinal += 1


READERS = {"docx": docx_tables, "xlsx": xlsx_tables, "pptx": pptx_tables}


def table_structures(files: DataFrame, kind: str) -> DataFrame:
    """(path, source_sha256, error, TABLE...) of the tables in files (path, content) of one kind."""
    read = READERS[kind]
    return parse_files(files, TABLE, lambda n, p: read(p))
