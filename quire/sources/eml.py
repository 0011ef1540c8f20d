"""Mail messages: headers and text bodies; attachments are listed by ``attachments`` and never decoded."""

from __future__ import annotations

from email import policy
from email.parser import BytesParser

from quire.sources.base import SourceError
from quire.sources.html import text_of

MAX_SOURCE, MAX_PARTS, MAX_DEPTH, MAX_PART, MAX_HEADERS = 1 << 20, 128, 8, 256 << 10, 64 << 10
HEADERS = ("subject", "from", "to", "cc", "date", "message-id")
ENCODINGS = ("", "7bit", "8bit", "quoted-printable", "base64")
CHARSETS = ("utf-8", "us-ascii", "ascii", "iso-8859-1", "windows-1252")


def _parts(message, path=(1,)):
    """(path, part) depth first."""
    if len(path) > MAX_DEPTH:
        raise SourceError("EML_DEPTH_LIMIT")
    yield list(path), message
    if message.is_multipart():
        for i, part in enumerate(message.iter_parts(), 1):
            yield from _parts(part, (*path, i))


def _message(payload: bytes):
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    head = payload.replace(b"\r\n", b"\n").partition(b"\n\n")[0]
    if len(head) > MAX_HEADERS:
        raise SourceError("EML_HEADER_LIMIT")
    parts = list(_parts(BytesParser(policy=policy.default).parsebytes(payload)))
    if len(parts) > MAX_PARTS:
        raise SourceError("EML_PART_LIMIT")
    return parts


def _attached(part) -> bool:
    return part.get_content_disposition() == "attachment" or bool(part.get_filename())


def read(name: str, payload: bytes):
    parts = _message(payload)
    for header in HEADERS:
        for i, value in enumerate(parts[0][1].get_all(header, []), 1):
            yield ["eml-header", header, i], str(value), "header"
    for path, part in parts:
        kind = part.get_content_type()
        if part.is_multipart() or _attached(part) or kind not in ("text/plain", "text/html"):
            continue
        encoding = str(part.get("content-transfer-encoding", "")).strip().lower()
        charset = (part.get_content_charset() or "us-ascii").lower()
        if encoding not in ENCODINGS or charset not in CHARSETS:
            raise SourceError("EML_ENCODING_UNSUPPORTED")
        raw = part.get_payload(decode=True) or b""
        if len(raw) > MAX_PART:
            raise SourceError("EML_PART_TOO_LARGE")
        text = raw.decode(charset)
        if kind == "text/html":
            for where, found, _ in text_of(text):
                yield ["eml-html", path, where], found, kind
        else:
            yield ["eml-body", path, kind, encoding], text, kind


def attachments(name: str, payload: bytes):
    """(part, filename, content_type) of what is attached."""
    for path, part in _message(payload):
        if not part.is_multipart() and _attached(part):
            yield ".".join(map(str, path)), part.get_filename(), part.get_content_type()
