"""Zip packages of documents, checked before anything is parsed."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from quire.sources.base import SourceError

MAX_ENTRIES, MAX_EXPANDED, MAX_RATIO = 10_000, 256 << 20, 200


def open_package(payload: bytes, entries: int = MAX_ENTRIES, expanded: int = MAX_EXPANDED, ratio: int = MAX_RATIO) -> zipfile.ZipFile:
    """A package whose members have safe names, aren't encrypted, and stay within the bounds."""
    try:
        package = zipfile.ZipFile(io.BytesIO(payload))
        members = package.infolist()
    except (zipfile.BadZipFile, ValueError, EOFError):
        raise SourceError("PACKAGE_INVALID") from None
    if len(members) > entries:
        raise SourceError("PACKAGE_ENTRY_LIMIT")
    total, names = 0, set()
    for m in members:
        if m.filename in names or m.filename.startswith("/") or "\\" in m.filename or ".." in m.filename.split("/"):
            raise SourceError("PACKAGE_MEMBER_NAME")
        if m.flag_bits & 1:
            raise SourceError("PACKAGE_ENCRYPTED")
        names.add(m.filename)
        total += m.file_size
        if total > expanded:
            raise SourceError("PACKAGE_SIZE_LIMIT")
        if m.file_size > ratio * max(1, m.compress_size):
            raise SourceError("PACKAGE_RATIO_LIMIT")
    return package


def member(package: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return package.read(name)
    except KeyError:
        return None
    except (zipfile.BadZipFile, RuntimeError, EOFError, NotImplementedError):
        raise SourceError("PACKAGE_MEMBER_DAMAGED") from None


def xml(raw: bytes | None, what: str = "PACKAGE_PART_MISSING"):
    """The root of an XML part; documents with a DTD aren't read."""
    if raw is None:
        raise SourceError(what)
    if re.search(rb"<!(DOCTYPE|ENTITY)", raw[:4096]):
        raise SourceError("XML_DTD_REFUSED")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        raise SourceError("XML_INVALID") from None


def streamed(package: zipfile.ZipFile, name: str, parent: str, children: tuple[str, ...], what: str = "PACKAGE_PART_MISSING"):
    """The children of a part's first ``parent``, one after another as the part is inflated.

    What follows the last child that is asked for is neither inflated nor parsed, so damage there isn't seen.
    """
    if name not in package.namelist():
        raise SourceError(what)
    parser, depth, inside, checked = ElementTree.XMLPullParser(("start", "end")), 0, None, False
    try:
        with package.open(name) as part:
            while chunk := part.read(1 << 15):
                if not checked and re.search(rb"<!(DOCTYPE|ENTITY)", chunk[:4096]):
                    raise SourceError("XML_DTD_REFUSED")
                checked = True
                parser.feed(chunk)
                for event, node in parser.read_events():
                    if event == "start":
                        depth += 1
                        if inside is None and local(node.tag) == parent:
                            inside = depth
                        continue
                    depth -= 1
                    if inside is not None and depth == inside and local(node.tag) in children:
                        yield node
                        node.clear()
        parser.close()
    except ElementTree.ParseError:
        raise SourceError("XML_INVALID") from None
    except (zipfile.BadZipFile, EOFError, NotImplementedError, zlib.error):
        raise SourceError("PACKAGE_MEMBER_DAMAGED") from None


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(node, name: str, default=None):
    """An attribute by its local name."""
    for key, value in node.attrib.items():
        if local(key) == name:
            return value
    return default


def relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations, by id, as names in the package."""
    folder, _, base = part.rpartition("/")
    raw = member(package, f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
    out = {}
    for r in xml(raw) if raw else ():
        target = attribute(r, "Target", "")
        if attribute(r, "TargetMode") == "External":
            continue
        steps: list[str] = [] if target.startswith("/") else folder.split("/") if folder else []
        for step in target.strip("/").split("/"):
            steps = steps[:-1] if step == ".." else [*steps, step] if step != "." else steps
        out[attribute(r, "Id")] = "/".join(steps)
    return out
