"""Files with given contents, written by the tasks that hold them."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_WRITTEN = "path string, size_bytes long, sha256 string"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each (path, content) below ``folder``, a path or URI of pyarrow's file systems: (path, size_bytes, sha256).

    A file appears under its name when it is whole, by a rename, so a task that is run again writes the same file
    over. Names that leave the folder raise. The result is lazy: an action writes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        head = folder[: len(folder) - len(base)]
        for batch in batches:
            out = []
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                path = posixpath.normpath(posixpath.join(base, name))
                if not path.startswith(posixpath.normpath(base) + "/"):
                    raise ValueError(f"{name} isn't below the folder")
                system.create_dir(posixpath.dirname(path), recursive=True)
                part = posixpath.join(posixpath.dirname(path), f"_{uuid.uuid4().hex}")
                with system.open_output_stream(part) as f:
                    f.write(content or b"")
                system.move(part, path)
                out.append((head + path, len(content or b""), hashlib.sha256(content or b"").hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.string(), pa.int64(), pa.string()))], ["path", "size_bytes", "sha256"])

    return files.select("path", "content").mapInArrow(write, _WRITTEN)
