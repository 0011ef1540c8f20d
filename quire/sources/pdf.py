"""Text of simple PDF files: the shown strings of each page, for fonts with a one-byte encoding.

This isn't parity with a full PDF library: fonts with their own character maps, encrypted files
and object streams are reported as unsupported, never guessed.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files

MAX_SOURCE, MAX_PAGES = 10 << 20, 50
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|T[djJ]|'|\"|TD|Td", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes, encoding: str = "cp1252") -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("latin-1" if encoding == "cp1252" else encoding, "replace")
    body = re.sub(
        rb"\\([0-7]{1,3}|\r?\n|.)",
        lambda m: _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]),
        token[1:-1],
        flags=re.S,
    )
    return body.decode(encoding, "replace")


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
    raw = m[1] if m else b""
    if b"/FlateDecode" in body[: m.start() if m else 0]:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            raise SourceError("PDF_STREAM_DAMAGED") from None
    if m and b"/Filter" in body[: m.start()]:
        raise SourceError("PDF_FILTER_UNSUPPORTED")
    return raw


def page_tree(payload: bytes) -> tuple[dict[int, bytes], list[bytes], str]:
    """The file's objects, its pages in order, and the encoding of its texts; no page is decoded."""
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    if not payload.startswith(b"%PDF-"):
        raise SourceError("PDF_INVALID")
    if b"/Encrypt" in payload:
        raise SourceError("PDF_ENCRYPTED")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(payload)}
    # A file whose fonts are all of two bytes a character in Unicode order can be read as well.
    fonts = [o for o in objects.values() if re.search(rb"/Type\s*/Font\b", o)]
    two = bool(fonts) and all(re.search(rb"/Encoding\s*/Uni\w+-(UCS2|UTF16)-H", o) for o in fonts)
    found = [o for o in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", o)]
    tree = next((o for o in objects.values() if re.search(rb"/Type\s*/Pages\b", o) and b"/Kids" in o), b"")
    kids = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Kids\s*\[(.*?)\]", tree, re.S) or [b"", b""])[1])]
    if kids and all(k in objects for k in kids):
        found = [objects[k] for k in kids]
    if not found:
        raise SourceError("PDF_UNSUPPORTED")
    return objects, found, "utf-16-be" if two else "cp1252"


def page_text(objects: dict[int, bytes], page: bytes, encoding: str) -> str:
    contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
    out: list[str] = []
    for ref in re.findall(rb"(\d+)\s+\d+\s+R", contents[1] if contents else b""):
        for token in _STRING.findall(_stream(objects.get(int(ref), b""))):
            if token[:1] in b"(<":
                out.append(_literal(token, encoding))
            elif token in (b"T*", b"Td", b"TD", b"'", b'"') and out and out[-1] != "\n":
                out.append("\n")
    return "".join(out).strip()


def pages(name: str, payload: bytes):
    """(page, text, char_count, ocr_required), pages counted from 1."""
    objects, found, encoding = page_tree(payload)
    if len(found) > MAX_PAGES:
        raise SourceError("PDF_PAGE_LIMIT")
    for number, page in enumerate(found, 1):
        text = page_text(objects, page, encoding)
        yield number, text, len(text), len(text) < 20


def pdf_pages(files: DataFrame) -> DataFrame:
    return parse_files(files, "page int, text string, char_count int, ocr_required boolean", pages)
