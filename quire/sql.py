"""What SQL can use: functions and table functions under names of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.functions import python as P
from quire.sources.base import SourceError


class _Items:
    """text_items(name, content): the text items of one file, or one row with the error."""

    def eval(self, name: str, content: bytes):
        from quire.sources.items import project

        try:
            for ordinal, locator, text, kind in list(project(name or "", bytes(content or b""), "strict")):
                yield ordinal, locator, text, kind, None
        except SourceError as e:
            yield None, None, None, None, str(e)
        except UnicodeDecodeError:
            yield None, None, None, None, "NOT_UTF8"


class _Members:
    """archive_members(name, content)"""

    def eval(self, name: str, content: bytes):
        from quire.sources.archives import inventory

        try:
            for row in list(inventory(name or "", bytes(content or b""))):
                yield (*row, None)
        except SourceError as e:
            yield None, None, None, None, None, str(e)


class _Read:
    """archive_read(name, content, ordinal, start, end)"""

    def eval(self, name: str, content: bytes, ordinal: int, start: int, end: int):
        from quire.sources.archives import read_range

        try:
            yield (*read_range(name or "", bytes(content or b""), ordinal, start, end), None)
        except SourceError as e:
            yield None, None, None, None, None, str(e)


class _Changes:
    """line_changes(old, new): the differing line ranges of two texts."""

    def eval(self, old: str, new: str):
        from difflib import SequenceMatcher

        a, b = ([x for x in (t or "").split("\n") if x.strip()] for t in (old, new))
        for kind, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind != "equal":
                yield {"insert": "added", "delete": "removed", "replace": "replaced"}[kind], i1, i2, j1, j2


TABLE_FUNCTIONS = {
    "text_items": (_Items, "ordinal: long, source_locator: string, text: string, type: string, error: string"),
    "archive_members": (_Members, "ordinal: int, name: string, size: long, kind: string, raw_name_sha256: string, error: string"),
    "archive_read": (_Read, "content: binary, start: long, stop: long, eof: boolean, member_sha256: string, error: string"),
    "line_changes": (_Changes, "kind: string, old_from: int, old_to: int, new_from: int, new_to: int"),
}
FUNCTIONS = {
    "cn_number": P.cn_number, "nfkc": P.nfkc, "nfc": P.nfc, "casefold": P.casefold, "canonical_digest": P.canonical_digest, "json_values_equal": P.json_values_equal,
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
