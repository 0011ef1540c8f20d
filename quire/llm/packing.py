"""Operator 3: packing token ids into fixed windows by concatenation and cutting.

Two passes. The first encodes each document once and writes its ids, with the tokens that
stand before it in its own partition, to a table in the shared folder. The totals of the
partitions (one row each) give by prefix sums where each partition begins in the whole
stream. The second pass reads the table, cuts the stream at every multiple of the window,
and records each piece of a document with its place. Nothing is shuffled, no window needs
another row than its own, and only the last window is not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, text_batches
from quire.llm.token_ids import encoder

TOKENS = "part long, local_start long, doc_id long, n_tokens long, wide int, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, padded_length long"
)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode every whole text once; returns a written table of packed ids.

    Null text is empty: such a document has the end id alone. Rows may repeat; each row is a
    document of its own. Columns besides doc_id and text are ignored.
    """
    text_batches(docs.sparkSession)

    def encode(batches):
        e = encoder(tokenizer)
        wide = e.dtype.itemsize
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, at = e.encode_column(b["text"], end_id)
            n, starts = b.num_rows, at[:-1] + before
            before += int(at[-1])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at * wide), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int64()),
                    pa.array(starts, pa.int64()),
                    b["doc_id"].cast(pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([wide] * n, pa.int32()),
                    packed.cast(pa.binary()),
                ],
                ["part", "local_start", "doc_id", "n_tokens", "wide", "ids"],
            )

    return materialize(docs.select("doc_id", "text").mapInArrow(encode, TOKENS), "tokens")


def partition_starts(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """Where each partition begins in the whole stream, and the length of the stream.

    One row a partition reaches the driver: partitions are bounded by the cluster's tasks,
    not by documents.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        starts[r["part"]] = at
        at += r["n"]
    return starts, at


def pack_tokens(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """Cut a token table into windows; one row for each piece of a document."""
    starts, total = partition_starts(tokens)

    def padded(n: int) -> int:
        return n if n & (n - 1) == 0 else window

    def cut(batches):
        for b in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "crc", "doc_tokens", "seq", "off", "seq_len", "pad")}
            cols = (b[c].to_pylist() for c in ("part", "local_start", "doc_id", "n_tokens", "wide", "ids"))
            for part, local, doc, n, wide, ids in zip(*cols):
                first = starts[part] + local
                values = np.frombuffer(ids, dtype="<u2" if wide == 2 else "<u4").astype("<u4").tobytes()
                at = 0
                while at < n:
                    seq, off = divmod(first + at, window)
                    take = min(window - off, n - at)
                    length = min(window, total - seq * window)
                    rows["doc_id"].append(doc)
                    rows["start"].append(at)
                    rows["length"].append(take)
                    rows["crc"].append(zlib.crc32(values[4 * at : 4 * (at + take)]))
                    rows["doc_tokens"].append(n)
                    rows["seq"].append(seq)
                    rows["off"].append(off)
                    rows["seq_len"].append(length)
                    rows["pad"].append(padded(length))
                    at += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in rows.values()],
                [c.split()[0] for c in PIECES.split(", ")],
            )

    return tokens.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack whole documents: ids, then ``end_id``, concatenated and cut every ``window`` ids.

    Returns a row per piece: doc_id, start (ids of the document before the piece), length,
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (in the sequence), sequence_length and padded_length (the window, or the length
    itself where that is a power of two). An empty table gives no rows; null and empty texts
    give the end id alone; equal rows are packed once each.
    """
    return pack_tokens(token_table(docs, tokenizer, end_id), window)
