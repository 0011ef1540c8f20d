"""Images by their headers: PNG and JPEG sizes, modes, orientation, and whether a place is recorded."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files

MAX_SOURCE, MAX_PIXELS = 10 << 20, 40_000_000
# PNG colour types, and what EXIF orientations turn and mirror.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
ORIENTATION = {1: (0, False), 2: (0, True), 3: (180, False), 4: (180, True), 5: (90, True), 6: (90, False), 7: (270, True), 8: (270, False)}


def _exif(raw: bytes) -> tuple[int, bool]:
    """(orientation, has a GPS block) of a TIFF structure."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8:
        return 1, False
    (at,) = struct.unpack_from(order + "I", raw, 4)
    orientation, gps = 1, False
    if at + 2 <= len(raw):
        (n,) = struct.unpack_from(order + "H", raw, at)
        for k in range(n):
            entry = at + 2 + 12 * k
            if entry + 12 > len(raw):
                break
            tag, _, _ = struct.unpack_from(order + "HHI", raw, entry)
            if tag == 0x0112:
                (orientation,) = struct.unpack_from(order + "H", raw, entry + 8)
            gps |= tag == 0x8825
    return orientation, gps


def header(payload: bytes):
    """(format, width, height, mode, rotation, mirrored, has_gps)"""
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    orientation, gps = 1, False
    if payload.startswith(b"\x89PNG\r\n\x1a\n") and len(payload) >= 33:
        width, height, _, color = struct.unpack_from(">IIBB", payload, 16)
        kind, mode, at = "png", PNG_MODES.get(color, "?"), 8
        while at + 8 <= len(payload):
            (size,) = struct.unpack_from(">I", payload, at)
            if payload[at + 4 : at + 8] == b"eXIf":
                orientation, gps = _exif(payload[at + 8 : at + 8 + size])
            at += 12 + size
    elif payload.startswith(b"\xff\xd8"):
        kind, width, height, mode, at = "jpeg", 0, 0, "?", 2
        while at + 4 <= len(payload) and payload[at] == 0xFF:
            mark, size = payload[at + 1], struct.unpack_from(">H", payload, at + 2)[0]
            if mark == 0xE1 and payload[at + 4 : at + 10] == b"Exif\0\0":
                orientation, gps = _exif(payload[at + 10 : at + 2 + size])
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width, parts = struct.unpack_from(">HHB", payload, at + 5)
                mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "?")
                break
            at += 2 + size
    else:
        raise SourceError("IMAGE_UNSUPPORTED")
    if not width or not height:
        raise SourceError("IMAGE_INVALID")
    if width * height > MAX_PIXELS:
        raise SourceError("IMAGE_PIXEL_LIMIT")
    return kind, width, height, mode, *ORIENTATION.get(orientation, (0, False)), gps


def image_profiles(files: DataFrame) -> DataFrame:
    schema = "format string, width int, height int, mode string, rotation int, mirrored boolean, has_gps boolean"
    return parse_files(files, schema, lambda n, p: iter([header(p)]))
