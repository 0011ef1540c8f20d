"""UTF-8 lines by byte range: plain text, Markdown, logs, tab-separated values."""

from __future__ import annotations

import hashlib

from quire.sources.base import SourceError

MAX_LINE = 8192
BOM = b"\xef\xbb\xbf"


def decode_line(raw: bytes, at: int) -> str:
    """The text of a line without its ending; the mark of a file's beginning isn't text."""
    body = raw
    if raw.endswith(b"\n"):
        body = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1]
    if b"\r" in body or b"\0" in body:
        raise SourceError("UNSUPPORTED_LINE_CONTENT")
    if len(raw) > MAX_LINE:
        raise SourceError("LINE_EXCEEDS_BUDGET")
    return body.removeprefix(BOM if at == 0 else b"").decode()


def physical_lines(payload: bytes):
    """(start, end, line, raw): pieces that end with a line feed, or at the end."""
    at, line = 0, 1
    while at < len(payload):
        end = payload.find(b"\n", at) + 1 or len(payload)
        yield at, end, line, payload[at:end]
        at, line = end, line + 1


def read(name: str, payload: bytes):
    tabs = name.lower().endswith(".tsv")
    for start, end, line, raw in physical_lines(payload):
        text = decode_line(raw, start)
        yield ["line", start, end, line, hashlib.sha256(raw).hexdigest()], text, "fields" if tabs else "line"


def resolve_line(payload: bytes, start: int, end: int, raw_sha256: str) -> str:
    """Read a line again by its byte range; it must be a whole line with this digest."""
    raw = payload[start:end]
    whole = (start == 0 or payload[start - 1 : start] == b"\n") and (end == len(payload) or raw.endswith(b"\n"))
    if not 0 <= start < end <= len(payload) or not whole or raw.find(b"\n") not in (-1, len(raw) - 1):
        raise SourceError("INVALID_LOCATOR")
    if hashlib.sha256(raw).hexdigest() != raw_sha256:
        raise SourceError("STALE_LOCATOR")
    return decode_line(raw, start)
