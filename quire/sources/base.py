"""How parsers run: one file a row, in Arrow batches, an error row where a file can't be read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Files in one Arrow batch of rows that a parser yields.
ROWS_PER_BATCH = 1000
#: Bytes of an Arrow batch that are taken up as Python objects at once; these are many times larger.
PIECE_BYTES = 1 << 20


class SourceError(ValueError):
    """A file breaks a rule of its format; the message is a stable code."""


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``size`` bytes, or one row: a batch itself may have ten thousand documents."""
    for b in batches:
        rows = max(1, int(b.num_rows * size / max(size, b.nbytes)))
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def parse_files(files: DataFrame, schema: str, parse: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of ``schema`` from files (path, content), each with path, source_sha256 and error.

    ``parse(name, content)`` yields tuples; a SourceError ends its file with one row that holds
    the code alone, and what the file yielded before isn't returned: a file reads whole or not.
    """
    own = StructType.fromDDL(schema)
    full = StructType.fromDDL(f"path string, source_sha256 string, error string, {schema}")
    arrow = to_arrow_schema(full)
    width = len(own.fields)

    def run(batches):
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows)) or [()] * (width + 3)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
            rows.clear()
            return out

        for b in pieces(batches):
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                raw = content or b""
                head = (path, hashlib.sha256(raw).hexdigest())
                try:
                    rows.extend((*head, None, *r) for r in list(parse((path or "").rsplit("/", 1)[-1], raw)))
                except (SourceError, UnicodeDecodeError) as e:
                    code = str(e) if isinstance(e, SourceError) else "NOT_UTF8"
                    rows.append((*head, code, *[None] * width))
                if len(rows) >= ROWS_PER_BATCH:
                    yield flush()
        yield flush()

    return files.select("path", "content").mapInArrow(run, full)
