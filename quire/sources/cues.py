"""Timed text: SubRip and WebVTT cues, in order of time."""

from __future__ import annotations

import re

from quire.sources.base import SourceError

_TIME = r"(?:(\d{2,}):)?(\d{2}):(\d{2})[.,](\d{3})"
_RANGE = re.compile(rf"\s*{_TIME}\s+-->\s+{_TIME}([^\n]*)$")


def _ms(hours, minutes, seconds, milli) -> int:
    if int(minutes) > 59 or int(seconds) > 59:
        raise SourceError("CUE_TIME_INVALID")
    return ((int(hours or 0) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(milli)


def cues(name: str, payload: bytes):
    """(number, id, start_ms, end_ms, settings, text) of each cue."""
    text = payload.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
    vtt = name.lower().endswith(".vtt")
    blocks = [b for b in re.split(r"\n{2,}", text.strip("\n")) if b.strip()]
    if vtt:
        if not blocks or not re.match(r"WEBVTT(\s|$)", blocks[0]):
            raise SourceError("VTT_HEADER_MISSING")
        blocks = blocks[1:]
    seen, last, number = set(), -1, 0
    for block in blocks:
        lines = block.split("\n")
        if vtt and re.match(r"(NOTE|STYLE|REGION)(\s|$)", lines[0]):
            continue
        head = lines.pop(0) if "-->" not in lines[0] else ""
        m = _RANGE.match(lines.pop(0)) if lines else None
        if not m:
            raise SourceError("CUE_TIME_INVALID")
        start, end = _ms(*m.groups()[:4]), _ms(*m.groups()[4:8])
        if end <= start or start < last:
            raise SourceError("CUE_ORDER_INVALID")
        if head and head in seen:
            raise SourceError("CUE_ID_DUPLICATE")
        seen.add(head)
        body = "\n".join(lines)
        if re.search(r"<[^>]*>", body):
            raise SourceError("CUE_MARKUP_UNSUPPORTED")
        number, last = number + 1, start
        yield number, head, start, end, m.group(9).strip(), body


def read(name: str, payload: bytes):
    for number, head, start, end, _, body in cues(name, payload):
        yield ["cue", number, head, start, end], body, "cue"
