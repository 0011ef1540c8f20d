"""Text items of all portable formats in one relation, and citations replayed against them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources import cues, eml, epub, html, jsonl, lines, odf
from quire.sources.base import SourceError, parse_files
from quire.sources.catalog import PORTABLE

MAX_ITEMS, MAX_OUTPUT, MAX_LOCATOR = 20_000, 2 << 20, 4096
READERS = {"lines": lines.read, "json": jsonl.read, "html": html.read, "odf": odf.read, "eml": eml.read, "epub": epub.read, "cues": cues.read}
ITEM = "ordinal long, source_locator string, text string, type string"


def project(name: str, payload: bytes, html_mode: str = "strict") -> Iterator[tuple]:
    """(ordinal, locator, text, type) of one file; blank texts are no items, locators don't repeat."""
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in PORTABLE:
        raise SourceError("UNSUPPORTED_FORMAT")
    if not payload:
        raise SourceError("EMPTY_SOURCE")
    read = READERS[PORTABLE[suffix]]
    found = read(name, payload, html_mode) if read is html.read else read(name, payload)
    seen, size, ordinal = set(), 0, 0
    for locator, text, kind in found:
        if not text.strip():
            continue
        key = json.dumps(locator, ensure_ascii=False, separators=(",", ":"))
        size += len(text.encode())
        if key in seen:
            raise SourceError("DUPLICATE_LOCATOR")
        if ordinal >= MAX_ITEMS or size > MAX_OUTPUT or len(key.encode()) > MAX_LOCATOR:
            raise SourceError("DOCUMENT_OUTPUT_LIMIT")
        seen.add(key)
        yield ordinal, key, text, kind
        ordinal += 1


def text_items(files: DataFrame, html_mode: str = "strict") -> DataFrame:
    """(path, source_sha256, error, ordinal, source_locator, text, type) of files (path, content)."""
    return parse_files(files, ITEM, lambda name, payload: project(name, payload, html_mode))


def within_budget(items: DataFrame, max_bytes: int = 65536, max_records: int = 512, start: int = 0) -> DataFrame:
    """What a bounded read from ordinal ``start`` returns of each file: whole items while both budgets last."""
    order = W.partitionBy("source_sha256").orderBy("ordinal")
    used = F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = items.filter((F.col("ordinal") >= start) & (F.col("ordinal") < start + max_records))
    return rows.withColumn("used_bytes", used).filter(F.col("used_bytes") <= max_bytes)
