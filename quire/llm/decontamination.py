"""Operator 11: decontamination by windows of the benchmark's words.

The benchmark's windows become blocks of sorted hashes with the windows' texts, of bounded size.
A block is broadcast; documents stream past it in place: every window of their words is looked up
by its hash, and a hit counts once its words are compared with the block's text. Where the benchmark
has more windows than a block holds, further blocks follow, and a document carries what was found so
far along; so nothing of documents is shuffled, however often a passage repeats.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. An item with fewer words than
a window, but not none, is one window of its own length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialize, text_batches, utf8
from quire.llm.words import alnum_words, chunks, window_hashes, word_hashes


@dataclass(frozen=True)
class OverlapParams:
    #: Words of a window.
    words: int = 10
    #: Windows and bytes of text in a block: what one pass broadcasts (about 32 bytes a window and the text, 64 MB at most).
    block_windows: int = 1_000_000
    block_bytes: int = 32 << 20
    #: Passes that are chained before what was found is written.
    chained: int = 4


_BLOCK = "block long, lengths binary, hashes binary, begins binary, ends binary, items binary, ids array<string>, text binary"
_SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
_FOUND = T.StructType().add("words", T.LongType()).add("spans", T.ArrayType(_SPAN)).add("items", T.ArrayType(T.StringType()))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.windows, self.bytes = 0, 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[bytes] = []
        self.ids: list[str | None] = []

    def add(self, item: str | None, words: list[bytes], k: int) -> None:
        """The windows of k words of a stretch of an item."""
        hashes = window_hashes(word_hashes(words), k)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        begins = self.bytes + np.concatenate(([0], np.cumsum(sizes)))
        n = len(hashes)
        self.parts.append((np.full(n, k, np.int32), hashes, begins[:n], begins[k : k + n] - 1, np.full(n, len(self.ids), np.int32)))
        self.ids.append(item)
        self.texts.append(b" ".join(words) + b" ")
        self.windows += n
        self.bytes += len(self.texts[-1])

    def close(self, block: int) -> pa.RecordBatch:
        lengths, hashes, begins, ends, items = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((hashes, lengths))
        arrays = [c[order].tobytes() for c in (lengths, hashes, begins, ends, items)]
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, [block, *arrays, self.ids, b"".join(self.texts)]))], _ARROW)


_NAMES = ["block", "lengths", "hashes", "begins", "ends", "items", "ids", "text"]
_ARROW = pa.schema(list(zip(_NAMES, [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string()), pa.binary()])))


def benchmark_blocks(benchmark: DataFrame, p: OverlapParams) -> DataFrame:
    """The benchmark's windows in blocks of bounded size, written: one row each. A long item is spread over blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, full = TaskContext.get().partitionId() << 32, _Open()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = alnum_words(text)
                k = min(p.words, len(words))
                lo = 0
                while k and lo <= len(words) - k:
                    n = min(len(words) - k + 1 - lo, p.block_windows - full.windows)
                    stretch = words[lo : lo + n + k - 1]
                    full.add(item, stretch, k)
                    lo += n
                    if full.windows >= p.block_windows or full.bytes >= p.block_bytes:
                        yield full.close(made)
                        made, full = made + 1, _Open()
        if full.windows:
            yield full.close(made)

    text_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return materialize(rows.coalesce(int(size // p.block_bytes) + 1).mapInArrow(build, _BLOCK), "windows")


class BlockIndex:
    """A block as a worker probes it."""

    def __init__(self, row: dict):
        self.ids, self.text = row["ids"], row["text"]
        lengths = np.frombuffer(row["lengths"], np.int32)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.begins, self.ends = np.frombuffer(row["begins"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.items = np.frombuffer(row["items"], np.int32)
        self.ranges = {int(k): (int(np.searchsorted(lengths, k)), int(np.searchsorted(lengths, k, "right"))) for k in np.unique(lengths)}
        # One probe of a small table passes most windows over before the search.
        self.mask = np.uint64((1 << max(int(16 * len(self.hashes)).bit_length(), 10)) - 1)
        self.seen = {}
        for k, (lo, hi) in self.ranges.items():
            self.seen[k] = np.zeros(int(self.mask) + 1, dtype=bool)
            self.seen[k][self.hashes[lo:hi] & self.mask] = True
        self.known: dict[bytes, set[int]] = {}

    def verified(self, k: int, value: np.uint64, words: list[bytes]) -> set[int]:
        """The items that hold just these words; the hash alone is no proof."""
        text = b" ".join(words)
        if text in self.known:
            return self.known[text]
        lo, hi = self.ranges[k]
        first, last = (lo + int(np.searchsorted(self.hashes[lo:hi], value, side)) for side in ("left", "right"))
        found = {int(self.items[i]) for i in range(first, last) if self.text[self.begins[i] : self.ends[i]] == text}
        if found:
            self.known[text] = found
        return found

    def overlaps(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text the number of words, the hit ranges of words, and the items."""
        split = [alnum_words(t) for t in texts]
        ends = np.cumsum([len(s) for s in split])
        words = list(chain.from_iterable(split))
        del split
        hashes = word_hashes(words)
        edges = np.zeros(len(words) + 1, dtype=np.int32)
        items = defaultdict(set)
        for k, (lo, hi) in self.ranges.items():
            windows = window_hashes(hashes, k)
            spots = np.flatnonzero(self.seen[k][windows & self.mask])
            at = np.searchsorted(self.hashes[lo:hi], windows[spots])
            spots = spots[self.hashes[lo:hi][np.minimum(at, hi - lo - 1)] == windows[spots]]
            docs = np.searchsorted(ends, spots, side="right")
            inside = spots + k <= ends[docs] if len(spots) else spots
            for i, doc in zip(spots[inside].tolist(), docs[inside].tolist()) if len(spots) else ():
                found = self.verified(k, windows[i], words[i : i + k])
                if found:
                    edges[i] += 1
                    edges[i + k] -= 1
                    items[doc] |= found
        hit = np.cumsum(edges[:-1]) > 0
        start = 0
        for doc, end in enumerate(ends.tolist()):
            spans = []
            if doc in items:
                turns = np.flatnonzero(np.diff(np.concatenate(([0], hit[start:end].view(np.int8), [0])))).tolist()
                spans = list(zip(turns[::2], turns[1::2]))
            yield end - start, spans, items.get(doc, set())
            start = end


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _free_name(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def find_overlaps(docs: DataFrame, benchmark: DataFrame, p: OverlapParams = OverlapParams(), into: str = "overlap") -> DataFrame:
    """The documents with a column ``into``: struct(words, spans, items).

    ``spans`` are the ranges of words (from 0, end exclusive) inside occurrences of a benchmark window,
    ``items`` the item_ids whose windows occur, as strings in order. Rows keep all their columns; one
    named ``into`` is refused. Rows that repeat are answered alike. Null and empty texts have no words. Items that
    share an item_id are one; an item without an id hits words but is named by none. An empty benchmark
    hits nothing. A text is held whole by one task, about ten times its bytes.
    """
    spark = docs.sparkSession
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {into}")
    text_batches(spark)
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, _FOUND)])

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = BlockIndex(block.value) if block else None
            for batch in batches:
                texts, found = utf8(batch.column(at)), []
                before = batch.column(batch.num_columns - 1).to_pylist()
                for lo, hi in chunks(texts):
                    rows = index.overlaps(texts[lo:hi]) if index else ((len(alnum_words(t)), [], ()) for t in texts[lo:hi])
                    for old, (n, spans, items) in zip(before[lo:hi], rows):
                        named = {index.ids[i] for i in items} - {None} if items else set()
                        if old:
                            spans = union_spans(spans + [(s["start"], s["end"]) for s in old["spans"]])
                            named |= set(old["items"])
                        found.append({"words": n, "spans": [{"start": a, "end": z} for a, z in spans], "items": sorted(named)})
                field = batch.schema.field(batch.num_columns - 1)
                yield batch.set_column(batch.num_columns - 1, field, pa.array(found, field.type))

        return run

    blocks = benchmark_blocks(benchmark, p)
    names = sorted(r.block for r in blocks.select("block").collect())
    out = docs.withColumn(into, F.lit(None).cast(_FOUND))
    for done, name in enumerate(names, 1):
        held = spark.sparkContext.broadcast(blocks.filter(F.col("block") == name).first().asDict())
        out = out.mapInArrow(scan(held), schema)
        if done % p.chained == 0 and done < len(names):
            out = materialize(out, "overlaps")
    return out if names else out.mapInArrow(scan(None), schema)


def overlap_report(docs: DataFrame, benchmark: DataFrame, p: OverlapParams = OverlapParams()) -> DataFrame:
    """One row per document, counts and digests of ``find_overlaps``.

    Nulls, empty and very long texts, repeated rows, empty tables and further columns are as told there;
    a null doc_id stays null.
    """
    found = find_overlaps(docs.select("doc_id", "text"), benchmark, p)
    hit = F.aggregate("overlap.spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id", F.col("overlap.words").alias("n_words"), hit.alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("overlap.spans") > 0).alias("contaminated"),
    )


def cut_words(text: bytes, spans: list[tuple[int, int]], mark: bytes) -> bytes:
    """The text with each range of words, and what stands between them, replaced by the mark."""
    out, last, turns = [], 0, iter(spans)
    start, end = next(turns, (None, None))
    for i, word in enumerate(_WORD.finditer(text.lower())):  # bytes: A-Z alone
        if start is None:
            break
        if i == start:
            out += [text[last : word.start()], mark]
        if i == end - 1:
            last = word.end()
            start, end = next(turns, (None, None))
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: OverlapParams = OverlapParams(), remove: str = "spans", mark: str = "") -> DataFrame:
    """Documents without the benchmark's windows, in their own columns.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` keeps all rows and replaces hit
    ranges by ``mark``. Texts without a hit, null ones too, stay as they are. See ``find_overlaps`` for
    what else may occur.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    into = _free_name(docs.columns, "overlap")
    found = find_overlaps(docs, benchmark, p, into)
    if remove == "documents":
        return found.filter(F.size(F.col(into)["spans"]) == 0).drop(into)
    at = [c.lower() for c in docs.columns].index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found["spans"]:
                    spans = [(s["start"], s["end"]) for s in found["spans"]]
                    texts[i] = cut_words(texts[i].encode(), spans, mark.encode()).decode()
            batch = batch.select(range(batch.num_columns - 1))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return found.mapInArrow(cut, docs.schema)
