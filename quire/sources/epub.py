"""EPUB books: the XHTML of the spine, in reading order."""

from __future__ import annotations

from quire.sources.base import SourceError
from quire.sources.html import text_of
from quire.sources.packages import attribute, local, member, open_package, xml

MAX_SOURCE, MAX_SPINE = 4 << 20, 64


def read(name: str, payload: bytes):
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    package = open_package(payload, 128, 8 << 20, 100)
    if (member(package, "mimetype") or b"").strip() != b"application/epub+zip":
        raise SourceError("EPUB_MIMETYPE")
    roots = [n for n in xml(member(package, "META-INF/container.xml")).iter() if local(n.tag) == "rootfile"]
    if not roots:
        raise SourceError("EPUB_ROOTFILE")
    opf = attribute(roots[0], "full-path", "")
    folder = opf.rpartition("/")[0]
    book = xml(member(package, opf))
    items = {attribute(n, "id"): attribute(n, "href") for n in book.iter() if local(n.tag) == "item"}
    spine = [attribute(n, "idref") for n in book.iter() if local(n.tag) == "itemref" and attribute(n, "linear") != "no"]
    if len(spine) > MAX_SPINE:
        raise SourceError("EPUB_SPINE_LIMIT")
    for i, ref in enumerate(spine, 1):
        if ref not in items:
            raise SourceError("EPUB_SPINE_ITEM")
        raw = member(package, f"{folder}/{items[ref]}" if folder else items[ref])
        if raw is None:
            raise SourceError("EPUB_SPINE_ITEM")
        for where, text, _ in text_of(raw.decode("utf-8-sig"), strict=False):
            yield ["epub-spine", i, items[ref], where], text, "xhtml"
