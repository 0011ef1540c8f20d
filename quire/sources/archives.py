"""Archives: members of zip and tar, also compressed, and ranges of their bytes, within a budget."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files


@dataclass
class Budget:
    """What one call may use; charging beyond a limit ends it."""

    source: int = 64 << 20
    expanded: int = 128 << 20
    returned: int = 1 << 20
    entries: int = 4096
    depth: int = 8
    ratio: int = 500

    def charge(self, what: str, amount: int) -> None:
        left = getattr(self, what) - amount
        if left < 0:
            raise SourceError("BUDGET_EXHAUSTED")
        setattr(self, what, left)


_OPEN = {"gz": lambda f: gzip.GzipFile(fileobj=f), "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}


def expand(payload: bytes, codec: str, budget: Budget) -> bytes:
    """The bytes below a compression, read in pieces so that the budget ends a bomb early."""
    limit, out = budget.ratio * max(1, len(payload)), bytearray()
    try:
        with _OPEN[codec](io.BytesIO(payload)) as f:
            while piece := f.read(1 << 16):
                budget.charge("expanded", len(piece))
                out += piece
                if len(out) > limit:
                    raise SourceError("RATIO_LIMIT")
    except (OSError, EOFError, lzma.LZMAError, zlib.error):
        raise SourceError("INTEGRITY_FAILED") from None
    return bytes(out)


def profile_of(name: str, payload: bytes) -> str:
    """zip, tar, or a compression, alone or over tar, by signature and name."""
    for mark, kind in ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\0", "xz")):
        if payload.startswith(mark):
            stem = name.lower().rsplit(".", 1)[0]
            return f"tar.{kind}" if kind != "zip" and (stem.endswith(".tar") or name.lower().endswith((".tgz", ".tbz2", ".txz"))) else kind
    if payload[257:262] == b"ustar":
        return "tar"
    raise SourceError("PROFILE_UNKNOWN")


def _members(name: str, payload: bytes, budget: Budget):
    """(member name, size, kind, read) of an archive."""
    budget.charge("source", len(payload))
    profile = profile_of(name, payload)
    if profile == "zip":
        try:
            z = zipfile.ZipFile(io.BytesIO(payload))
        except zipfile.BadZipFile:
            raise SourceError("INTEGRITY_FAILED") from None

        def opener(info):
            def read():
                if info.flag_bits & 1:
                    raise SourceError("MEMBER_ENCRYPTED")
                if info.file_size > budget.ratio * max(1, info.compress_size):
                    raise SourceError("RATIO_LIMIT")
                budget.charge("expanded", info.file_size)
                try:
                    return z.read(info)
                except (zipfile.BadZipFile, EOFError, zlib.error):
                    raise SourceError("INTEGRITY_FAILED") from None

            return read

        for info in z.infolist():
            budget.charge("entries", 1)
            yield info.filename, info.file_size, "directory" if info.is_dir() else "file", opener(info)
    elif profile.startswith("tar"):
        raw = expand(payload, profile[4:], budget) if "." in profile else payload
        try:
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
                for info in t:
                    budget.charge("entries", 1)
                    kind = "file" if info.isreg() else "directory" if info.isdir() else "link" if info.issym() or info.islnk() else "other"

                    def read(info=info, t=t):
                        budget.charge("expanded", info.size)
                        return t.extractfile(info).read()

                    yield info.name, info.size, kind, read
        except (tarfile.TarError, EOFError):
            raise SourceError("INTEGRITY_FAILED") from None
    else:
        raw = expand(payload, profile, budget)
        budget.charge("entries", 1)
        yield name.rsplit(".", 1)[0] or name, len(raw), "file", lambda: raw


def inventory(name: str, payload: bytes, budget: Budget | None = None):
    """(ordinal, name, size, kind, raw_name_sha256) of the members."""
    for i, (member, size, kind, _) in enumerate(_members(name, payload, budget or Budget())):
        yield i, member, size, kind, hashlib.sha256(member.encode("utf-8", "surrogateescape")).hexdigest()


def read_range(name: str, payload: bytes, ordinal: int, start: int, end: int, budget: Budget | None = None):
    """(bytes, start, end, eof, member_sha256): a half-open range of a file member; the digest comes with its end."""
    budget = budget or Budget()
    if not 0 <= start < end:
        raise SourceError("RANGE_INVALID")
    for i, (_, size, kind, read) in enumerate(_members(name, payload, budget)):
        if i == ordinal:
            if kind != "file":
                raise SourceError("MEMBER_NOT_READABLE")
            stop = min(end, size)
            budget.charge("returned", max(0, stop - start))
            raw = read()
            return raw[start:stop], start, stop, stop >= size, hashlib.sha256(raw).hexdigest() if stop >= size else None
    raise SourceError("MEMBER_UNKNOWN")


def resolve_chain(name: str, payload: bytes, chain: list[tuple[int, str]], budget: Budget | None = None) -> tuple[str, bytes]:
    """Follow (ordinal, member name) pairs through nested archives to the leaf's name and bytes."""
    budget = budget or Budget()
    for ordinal, wanted in chain:
        budget.charge("depth", 1)
        for i, (member, _, kind, read) in enumerate(_members(name, payload, budget)):
            if i == ordinal:
                if member != wanted or kind != "file":
                    raise SourceError("SELECTOR_MISMATCH")
                name, payload = member, read()
                break
        else:
            raise SourceError("MEMBER_UNKNOWN")
    return name, payload


def archive_members(files: DataFrame) -> DataFrame:
    return parse_files(files, "ordinal int, name string, size long, kind string, raw_name_sha256 string", inventory)
