"""Operator 6: language-model scores of whole texts from a log-frequency Bloom filter.

Counts of the training documents: words, character n-grams of words (order 1 to ORDER in bytes, with
a mark at both ends), and word n-grams of order 2 and 3, with a mark before a text and an end after it.
A task counts a block of documents at a time and sends sorted arrays of hashes, one to each slice of
the hash range; they are merged by a tree whose fan-out is bounded (``fan_out``), so what is sent grows
with the input alone, and the last level holds each slice's sums.

A count c is quantised to q = 1 + floor(log(c) / log(BASE)), and (gram, 1) to (gram, q) go into a Bloom
filter of BITS bits an entry. A count is read by probing levels until one is missing. Word n-grams go in
from the count ``cutoff`` on, the same at every size. A filter of MAX_BITS bits at most for each GB of an
executor's memory goes to the workers as a file that they map. A larger one stays cut in slices: each block of texts sends its distinct grams, sorted and
packed, to their slices, whose tasks build their part of the filter, probe it and send the levels back
(``sharded_scores``); the levels are those that a broadcast filter would give.

The model: a word's spelling is the product of its bytes' probabilities, each interpolated over the
character orders; its unigram interpolates its quantised count with its spelling; and

    p(w | u v) = W3 * c(u v w) / c(u v) + W2 * c(v w) / c(v) + (1 - W2 - W3) * p(w)

where the weight of a context that isn't held goes to the order below. Above a unigram, counts are read at
the lower end of their level and contexts' at the upper end: probabilities of all words sum to 1 where
levels hold one count each (1, 2, 3) and nothing is cut off, and to less elsewhere.

The base score needs exact counts of words. The most frequent words, HELD_WORDS at most, go to the workers
with the model; of other words each text's occurrences are joined to the sums by key and summed by text, so
no text is moved for them.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LARGE_ROWS, crc_mod, executor_gb, materialize, mix64, partitions_of, ship, shipped, text_batches, utf8
from quire.llm.words import Words, tokens_of

ORDER = 5
BASE = 1.5
#: MAX_BITS are for each GB of an executor's memory: an eighth of it.
BITS, HASHES, MAX_BITS, MAX_LEVEL = 10, 7, 1 << 30, 80
#: The least count with which a word n-gram is held.
CUTOFF = 2
#: The weight of the lower order in the interpolation of bytes, in counts; and the weights of word orders 2 and 3.
PRIOR, W2, W3 = 4.0, 0.25, 0.35
END = b"\n"
#: Bytes of texts that make one block.
BLOCK_BYTES = 8 << 20
#: What a task takes up at once: words whose n-grams are counted, tokens whose n-grams are counted, distinct words of parts
#: that are summed, and bytes of texts.
WORDS_AT_ONCE, TOKENS_AT_ONCE, WORDS_HELD, BYTES_AT_ONCE = 20_000, 1_000_000, 600_000, 1 << 20
#: Words whose spelling is scored at once.
SPELT_AT_ONCE = 5_000
#: Bytes of training texts whose counts make one node of the merging tree: what a group of it has to hold.
NODE_BYTES = 16 << 20
#: The largest count of which a key is repeated so often, in place of being sorted with its count.
REPEATED = 3
#: Keys in one row of a slice's sums, and bytes of an Arrow batch: what an executor's JVM holds of a group at once.
ROW_KEYS, BATCH_BYTES = 1 << 18, 4 << 20
#: The most parts that one array is cut into, or merged from.
MAX_FAN = 64
#: The most words whose exact counts go to the workers.
HELD_WORDS = 1 << 20

_U = np.uint64
#: The key before a text's first word.
BEGIN = _U(0x9D39247E33776D41)


def _word_keys(words) -> np.ndarray:
    return Words.of(words).keys()


END_KEY = _word_keys([END])[0]


def bigram_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(before * _U(0x9E3779B97F4A7C15) + keys + _U(0x2545F491))


def trigram_keys(pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of trigrams from those of their first two words and of their last."""
    return mix64(pairs * _U(0xD1342543DE82EF95) + keys + _U(0x3C6EF372))


def preceding(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The key before each token of texts that begin at ``starts``."""
    before = np.concatenate([[BEGIN], keys[:-1]])
    before[starts] = BEGIN
    return before


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(slices)) >> _U(32)).astype(np.int64)


#: The key under which the number of predicted bytes is counted.
ALL = mix64(np.array([0x5D0F00D], dtype=_U))


def gram_positions(words: Words | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of marked words, each byte's place in its word, and its word's number."""
    words = words if isinstance(words, Words) else Words.of(words)
    sizes = words.sizes + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = place == sizes[owner] - 1
    marks = (place == 0) | last
    flat = np.where(last, _U(END[0]), _U(0x20))
    flat[~marks] = words.flat[words.starts[owner[~marks]] + place[~marks] - 1]
    return flat, place, owner


def gram_keys(flat: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The key of the gram of each order that ends at each byte; shorter at a word's beginning."""
    keys, total = [], np.zeros(len(flat), dtype=_U)
    for k in range(ORDER):
        reach = place >= k
        shifted = np.concatenate([np.zeros(k, _U), flat])[: len(flat)]
        total = np.where(reach, total + (shifted + _U(1)) * _U(257**k), total)
        keys.append(mix64(total + _U(0x9E3779B97F4A7C15)))
    return keys


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")  # which merges runs that are sorted already
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[edges], np.add.reduceat(counts[order], edges) if len(keys) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order of their first occurrence, and the number of each key among them."""
    encoded = pa.array(keys).dictionary_encode()
    return encoded.dictionary.to_numpy(), encoded.indices.to_numpy()


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting alone: numpy's ``unique`` hashes them, which takes many times as long where most differ."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def count_grams(words: Words | dict[bytes, int], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all orders with their counts, weighted by the words' own."""
    if isinstance(words, dict):
        words, counts = Words.of(words), np.fromiter(words.values(), dtype=np.int64)
    found = [(np.empty(0, _U), np.empty(0))]
    for low in range(0, len(words), WORDS_AT_ONCE):
        flat, place, owner = gram_positions(words[low : low + WORDS_AT_ONCE])
        weight = counts[low : low + WORDS_AT_ONCE].astype(np.float64)[owner]
        keys = gram_keys(flat, place)
        use = [place >= k for k in range(ORDER)]
        # Many words share few grams.
        grams, number = _distinct(np.concatenate([keys[k][x] for k, x in enumerate(use)]))
        found.append((grams, np.bincount(number, weights=np.concatenate([weight[x] for x in use]), minlength=len(grams))))
        found.append((ALL, np.array([weight[place > 0].sum()])))
        found = [_summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
    return found[0]


#: Kinds of counts: words, character n-grams, word n-grams.
_WORD, _CHAR, _NGRAM = range(3)
_BLOB = "kind int, slice int, node int, n int, keys binary, counts binary"
_BLOB_NAMES = [c.split()[0] for c in _BLOB.split(", ")]
_BLOB_SCHEMA = pa.schema([(c, pa.int32()) for c in _BLOB_NAMES[:4]] + [(c, pa.binary()) for c in _BLOB_NAMES[4:]])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, and the differences that follow, each byte place by itself, without those that are all zeros."""
    d = np.diff(keys).astype(">u8").view(np.uint8).reshape(-1, 8)
    wide = 8 - int((~d.any(axis=0)).argmin()) if len(d) else 0
    return bytes([wide]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(d[:, 8 - wide :].T).tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, _U)
    wide = data[0]
    d = np.zeros((n, 8), dtype=np.uint8)
    d[1:, 8 - wide :] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(wide, n - 1).T
    d = d.view(">u8").ravel().astype(_U)
    d[0] = np.frombuffer(data, dtype="<u8", count=1, offset=1)[0]
    return np.cumsum(d, dtype=_U)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in bytes where all fit, and compressed: most are 1."""
    small = counts.max(initial=0) < 256
    return (b"1" if small else b"8") + zlib.compress(counts.astype(np.uint8 if small else "<i8").tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8 if data[:1] == b"1" else "<i8").astype(np.float64)


def _blobs(kind: int, node: int, keys: np.ndarray, counts: np.ndarray, slices: int) -> pa.RecordBatch:
    """One row for each slice that sorted keys lie in."""
    edges = np.searchsorted(_slice_of(keys, slices), np.arange(slices + 1))
    rows = [
        (kind, s, node, int(z - a), pack_keys(keys[a:z]), pack_counts(counts[a:z]))
        for s, (a, z) in enumerate(zip(edges.tolist(), edges[1:].tolist()))
        if z > a
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOB_SCHEMA.types)], _BLOB_NAMES)


def fan_out(parts: int) -> tuple[int, int]:
    """(fan, levels): the tree that spreads the counts of so many partitions over fan ** levels slices."""
    levels = max(1, math.ceil(math.log(max(2, parts), MAX_FAN) - 1e-9))
    return max(2, math.ceil(parts ** (1 / levels) - 1e-9)), levels


def nodes_of(texts: DataFrame) -> tuple[int, int]:
    """(nodes, stride): how many nodes the counts of texts are dealt to, and from which one a partition begins.

    Partitions grow with the table, up to the size of a split, so they alone would make groups that grow too.
    """
    parts = partitions_of(texts)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    nodes = max(parts, -(-size // NODE_BYTES))
    return nodes, max(1, nodes // max(1, texts.rdd.getNumPartitions()))


def _counted(texts: DataFrame, slices: int, nodes: int = (1 << 31) - 1, stride: int = 1) -> DataFrame:
    """Sorted counts of blocks of training texts, cut by slices of the hash range and dealt to nodes in turn."""

    def count(batches):
        # What a worker kept of an earlier model isn't needed any more.
        forget()
        first = TaskContext.get().partitionId() * stride
        of_grams, of_words = itertools.count(first), itertools.count(first)
        grams: list[np.ndarray] = []
        # Distinct words of some texts: their keys, counts and bytes.
        found: list[tuple[np.ndarray, np.ndarray, Words]] = []
        n_grams = n_words = 0

        def flush():
            yield _blobs(_NGRAM, next(of_grams) % nodes, *np.unique(np.concatenate(grams), return_counts=True), slices)
            grams.clear()

        def flush_words():
            keys, counts = np.concatenate([k for k, _, _ in found]), np.concatenate([c for _, c, _ in found])
            shift = np.cumsum([0, *(len(w.flat) for _, _, w in found)])
            words = Words(
                np.concatenate([w.flat for _, _, w in found]),
                np.concatenate([w.starts + z for (_, _, w), z in zip(found, shift)]),
                np.concatenate([w.sizes for _, _, w in found]),
            )
            order = np.argsort(keys)
            keys = keys[order]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            unique, counts = keys[edges], np.add.reduceat(counts[order], edges)
            node = next(of_words) % nodes
            yield _blobs(_WORD, node, unique, counts, slices)
            inner = unique != END_KEY
            yield _blobs(_CHAR, node, *count_grams(words[order[edges[inner]]], counts[inner]), slices)
            found.clear()

        for b in batches:
            for some in in_parts(utf8(b["text"])):
                words, sizes = tokens_of(some)
                keys = words.keys()
                starts = np.cumsum(sizes) - sizes
                pairs = bigram_keys(preceding(keys, starts), keys)
                inner = np.ones(len(keys), dtype=bool)
                inner[starts] = False
                grams += [pairs, trigram_keys(np.concatenate([pairs[:1], pairs[:-1]]), keys)[inner]]
                unique, number = _distinct(keys)
                counts, first = np.bincount(number), np.empty(len(unique), dtype=np.int64)
                first[number[::-1]] = np.arange(len(keys))[::-1]
                mine = words[first]
                # The words' bytes alone, without the texts'.
                at = np.cumsum(mine.sizes) - mine.sizes
                raw = mine.flat[np.repeat(mine.starts - at, mine.sizes) + np.arange(int(mine.sizes.sum()))]
                found.append((unique, counts, Words(raw, at, mine.sizes)))
                n_grams, n_words = n_grams + len(keys), n_words + len(unique)
                if n_grams >= TOKENS_AT_ONCE:
                    yield from flush()
                    n_grams = 0
                if n_words > WORDS_HELD:
                    yield from flush_words()
                    n_words = 0
        if grams:
            yield from flush()
        if found:
            yield from flush_words()

    return texts.select("text").mapInArrow(count, _BLOB)


def in_parts(texts: list[bytes]):
    """Texts in parts of BYTES_AT_ONCE; a longer one is a part of its own."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BYTES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


_SUMMED = "kind int, slice int, n int, keys binary, counts binary, total double, values double, by_level array<long>"


def _merge(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the arrays of one group."""
    rows = (row for b in batches for row in zip(*(b[x].to_pylist() for x in ("n", "keys", "counts"))))
    return totals((unpack_keys(k, n), unpack_counts(c)) for n, k, c in rows)


def totals(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``_summed`` for runs of keys and counts most of which are small: such keys are repeated and sorted alone, without their order."""
    some, more, more_sums = [np.empty(0, _U)], [np.empty(0, _U)], [np.empty(0)]
    for keys, counts in runs:
        small = counts <= REPEATED
        some.append(np.repeat(keys[small], counts[small].astype(np.int64)))
        more.append(keys[~small])
        more_sums.append(counts[~small])
    some = np.concatenate(some)
    some.sort()
    edges = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])[: len(some)])
    sums, some = np.diff(edges, append=len(some)).astype(np.float64), some[edges]
    more, more_sums = _summed(np.concatenate(more), np.concatenate(more_sums))
    at = np.searchsorted(some, more)
    there = at < len(some)
    there[there] = some[at[there]] == more[there]
    sums[at[there]] += more_sums[there]
    return np.insert(some, at[~there], more[~there]), np.insert(sums, at[~there], more_sums[~there])


def summed_slices(counted: DataFrame, fan: int, levels: int, cutoff: int) -> DataFrame:
    """The sums of each slice in rows of ROW_KEYS, and how many grams there are of each level; written.

    Word n-grams below the cutoff are left out here. A group comes to its worker and leaves it in small batches, as the
    JVM holds a batch, and Parquet a row, outside its heap.
    """
    most = ROW_KEYS
    counted.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def pass_on(level: int):
        def merge(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, _, group = (x.as_py() for x in of)
            rows = _blobs(kind, group, *_merge(batches), fan ** (level + 1))
            for i in range(rows.num_rows):
                yield rows.slice(i, 1)

        return merge

    for level in range(1, levels):
        # A group: the arrays of one slice from ``fan`` nodes, or nodes that merged so many.
        grouped = counted.withColumn("group", F.floor(F.col("node") / fan).cast("int"))
        counted = grouped.groupBy("kind", "slice", "group").applyInArrow(pass_on(level), _BLOB)

    def sums(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part = (x.as_py() for x in of)
        every, sizes = _merge(batches)
        if kind == _NGRAM:
            every, sizes = every[sizes >= cutoff], sizes[sizes >= cutoff]
        for low in range(0, len(every), most):
            keys, counts = every[low : low + most], sizes[low : low + most]
            q = quantised(counts)
            by_level = np.bincount(q, minlength=MAX_LEVEL + 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([kind], pa.int32()), "slice": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int32()),
                    "keys": [pack_keys(keys)], "counts": [pack_counts(counts)], "total": [float(counts.sum())],
                    "values": [float(middle(q).sum())], "by_level": pa.array([by_level.tolist()], pa.list_(pa.int64())),
                }
            )

    return materialize(counted.groupBy("kind", "slice").applyInArrow(sums, _SUMMED), "counts", LARGE_ROWS)


def quantised(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for none."""
    q = 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)
    return np.where(counts > 0, np.minimum(q, MAX_LEVEL), 0).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return np.where(levels <= 1, levels, BASE ** (levels - 0.5))


#: The least and the largest count of each level.
LOWEST = np.array([0, *(math.ceil(BASE ** (q - 1) - 1e-6) for q in range(1, MAX_LEVEL + 1))], dtype=np.float64)
HIGHEST = np.array([0, *(math.ceil(BASE**q - 1e-6) - 1 for q in range(1, MAX_LEVEL + 1))], dtype=np.float64)


@dataclass
class LogFrequencyFilter:
    """Bits in ``slices`` regions of ``width`` bits; ``hashes`` bits for each (gram, level). With ``file`` the bits were shipped by that name."""

    bits: np.ndarray
    slices: int
    width: int
    hashes: int
    file: str = ""

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"bits": None} if self.file else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.file:
            self.bits = shipped(self.file)

    def probe(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Whether each (gram, level) may have been put in; a bit that is 0 ends its probes."""
        base, h = placed(keys, levels, self.slices, self.width)
        alive = np.flatnonzero(self._bit(base, h))
        base, h = base.take(alive), h.take(alive)
        # Most grams that aren't there are gone by now, so the second hash is made for few, and few go on in vain.
        step, there = second_hash(h), np.zeros(len(keys), dtype=bool)
        held = np.ones(len(h), dtype=np.uint8)
        for i in range(1, self.hashes):
            h += step
            held &= self._bit(base, h)
            if i == 2:
                some = np.flatnonzero(held)
                alive, base, h, step, held = alive.take(some), base.take(some), h.take(some), step.take(some), held.take(some)
        there[alive] = held
        return there

    def _bit(self, base: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = _bit_of(h, self.width)
        at += base
        place = (at & 7).astype(np.uint8)
        at >>= 3
        return (self.bits.take(at) >> place) & np.uint8(1)

    def levels(self, keys: np.ndarray, first: int = 1, known: np.ndarray | None = None) -> np.ndarray:
        """The level of each gram, by probes of level after level until one is missing: a false positive adds
        the levels that follow without a gap, most often one alone. Grams below level ``first`` are known not to be in;
        ``known`` are levels up to which each gram was put in, which need no probes."""
        out = np.zeros(len(keys), dtype=np.int64) if known is None else known.astype(np.int64)
        alive, level = np.arange(len(keys)), np.maximum(out + 1, first)
        while len(alive):
            there = np.flatnonzero(self.probe(keys, level) & (level <= MAX_LEVEL))
            alive, keys, level = alive.take(there), keys.take(there), level.take(there)
            out[alive] = level
            level += 1
        return out


def placed(keys: np.ndarray, levels: np.ndarray, slices: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the region of each gram begins, and a hash of (gram, level)."""
    return _slice_of(keys, slices) * width, mix64(keys + levels.astype(_U) * _U(0xD6E8FEB86659FD93))


def second_hash(a: np.ndarray) -> np.ndarray:
    return mix64(a + _U(0xA0761D6478BD642F)) | _U(1)


def _bit_of(h: np.ndarray, width: int) -> np.ndarray:
    at = h >> _U(32)
    at *= _U(width)
    at >>= _U(32)
    return at.view(np.int64)


def nth_bit(a: np.ndarray, step: np.ndarray, i: int, width: int) -> np.ndarray:
    return _bit_of(a + _U(i) * step if i else a, width)


def mark(own: np.ndarray, keys: np.ndarray, counts: np.ndarray, slices: int, width: int, hashes: int, first: int = 1) -> None:
    """Put grams of one slice into its bits, from level ``first`` on."""
    q = quantised(counts)
    for level in range(first, int(q.max(initial=0)) + 1):
        some = keys[q >= level]
        _, a = placed(some, np.full(len(some), level), slices, width)
        step = second_hash(a)
        for i in range(hashes):
            own[nth_bit(a, step, i, width)] = True


def region(keys: np.ndarray, counts: np.ndarray, slices: int, width: int, hashes: int, first: int = 1) -> bytes:
    """The bits of one slice of the filter, from level ``first`` on."""
    own = np.zeros(width, dtype=bool)
    mark(own, keys, counts, slices, width, hashes, first)
    return np.packbits(own, bitorder="little").tobytes()


def entries_from(by_level: np.ndarray, first: int) -> int:
    """The filter's entries for grams of which there are so many of each level, put in from level ``first`` on."""
    return int((by_level * np.maximum(0, np.arange(len(by_level)) - first + 1)).sum())


@dataclass
class Shape:
    """The filter's size: ``slices`` regions of ``width`` bits, for word n-grams from level ``least`` on."""

    slices: int
    width: int
    hashes: int
    least: int

    def region(self, rows) -> np.ndarray:
        """The bits of rows (kind, n, keys, counts) of one slice of ``summed_slices``."""
        own = np.zeros(self.width, dtype=bool)
        for kind, n, keys, counts in rows:
            mark(own, unpack_keys(keys, n), unpack_counts(counts), self.slices, self.width, self.hashes, self.least if kind == _NGRAM else 1)
        return np.packbits(own, bitorder="little")


def level_sums(sums: DataFrame) -> dict[int, np.ndarray]:
    """How many grams of each kind there are of each level."""
    every = F.array(*(F.sum(F.get("by_level", F.lit(q))) for q in range(MAX_LEVEL + 1)))
    none = np.zeros(MAX_LEVEL + 1, dtype=np.int64)
    found = {r["kind"]: np.array(r["grams"]) for r in sums.groupBy("kind").agg(every.alias("grams")).collect()}
    return {k: found.get(k, none) for k in (_WORD, _CHAR, _NGRAM)}


def filter_shape(grams: dict[int, np.ndarray], slices: int, cutoff: int) -> Shape:
    """BITS bits for each entry, however many there are."""
    least = int(quantised(np.array([cutoff]))[0])
    entries = sum(entries_from(n, least if kind == _NGRAM else 1) for kind, n in grams.items())
    width = -(-max(64 * slices, BITS * entries) // (64 * slices)) * 64
    return Shape(slices, width, max(1, min(HASHES, round(0.693 * width * slices / max(1, entries)))), least)


def most_bits(spark: SparkSession) -> int:
    """The bits of the largest filter that workers map: more where executors have more memory, so that less is sent to slices."""
    return int(MAX_BITS * max(1.0, executor_gb(spark)))


def build_filter(sums: DataFrame, shape: Shape) -> LogFrequencyFilter:
    """A filter that fits ``most_bits``, its regions collected from the slices. They are made by all tasks at once and
    written, as the driver takes up one partition after the other."""

    def fill(batches):
        rows = (row for b in batches for row in zip(*(b[x].to_pylist() for x in ("slice", "kind", "n", "keys", "counts"))))
        # A slice's rows stand together, as a task wrote them.
        for part, own in itertools.groupby(rows, lambda row: row[0]):
            bits = shape.region(row[1:] for row in own).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], ["slice", "bits"])

    wide = shape.width // 8
    regions = materialize(sums.select("kind", "slice", "n", "keys", "counts").mapInArrow(fill, "slice int, bits binary"), "regions", LARGE_ROWS)

    def collect(bits: np.ndarray) -> None:
        for r in regions.toLocalIterator():
            bits[r["slice"] * wide : (r["slice"] + 1) * wide] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)

    name, bits = ship(sums.sparkSession, shape.slices * wide, collect)
    return LogFrequencyFilter(bits, shape.slices, shape.width, shape.hashes, name)


def fill_of(bits: np.ndarray) -> float:
    ones = np.array([bin(b).count("1") for b in range(256)])
    # In parts, as counting takes eight bytes for each one.
    held = sum(int(np.bincount(bits[low : low + (1 << 20)], minlength=256) @ ones) for low in range(0, len(bits), 1 << 20))
    return held / max(1, 8 * len(bits))


class Answers:
    """The levels that a filter in slices gave for a block's grams; stands in for the filter there."""

    def __init__(self):
        self.keys, self.found = np.empty(0, _U), np.empty(0, np.uint8)

    def take_up(self, keys: np.ndarray, levels: np.ndarray) -> None:
        """Answer for another block from now on."""
        order = np.argsort(keys)
        self.keys, self.found = keys[order], levels[order]

    def levels(self, keys: np.ndarray, first: int = 1, known: np.ndarray | None = None) -> np.ndarray:
        # Sorted keys are found in memory that lies side by side.
        order = np.argsort(keys)
        keys = keys[order]
        at = np.searchsorted(self.keys, keys)
        if (at == len(self.keys)).any() or (self.keys[at] != keys).any():
            raise ValueError(UNSTABLE)
        out = np.empty(len(keys), dtype=np.int64)
        out[order] = self.found[at]
        return out


@dataclass
class Model:
    """What is broadcast: the filter without its bits (None where it stays in slices), a few numbers, and exact counts of frequent words."""

    filter: LogFrequencyFilter | Answers | None
    cutoff: int
    tokens: float
    distinct: int
    values: float
    ends: float
    held: np.ndarray = field(default_factory=lambda: np.empty(0, _U))
    held_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __post_init__(self):
        bits = getattr(self.filter, "bits", None)
        self.digest = "" if bits is None else xxhash.xxh3_64_hexdigest(bits)
        self.fill = getattr(self.filter, "fill", 0.0) if bits is None else fill_of(bits)

    @property
    def whole(self) -> bool:
        """Whether all words' counts are held, so that another word has none."""
        return len(self.held) == self.distinct

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """The count of each word; -1 where it must be looked up."""
        if not len(self.held):
            return np.full(len(keys), 0 if self.whole else -1)
        at = np.minimum(np.searchsorted(self.held, keys), len(self.held) - 1)
        return np.where(self.held[at] == keys, self.held_counts[at], 0 if self.whole else -1)

    @property
    def stop(self) -> float:
        """The probability that a text ends, without regard to its words."""
        return (self.ends + 1) / (self.tokens + 2)


def unigrams(words: Words, keys: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each word or end, and its count at the upper end of its level."""
    # A word whose count is held was put in up to that count's level.
    levels = m.filter.levels(keys, known=quantised(np.maximum(m.exact(keys), 0)))
    spelt = np.concatenate(
        [np.empty(0), *(spellings(words[low : low + SPELT_AT_ONCE], m.filter) for low in range(0, len(words), SPELT_AT_ONCE))]
    )
    spelt = (1 - m.stop) * 10.0 ** np.maximum(spelt, -290)
    spelt[keys == END_KEY] = m.stop
    weight = max(1, m.distinct)
    return (middle(levels) + weight * spelt) / (m.values + weight), HIGHEST[levels]


class RecentLevels:
    """A filter's levels of the grams that were read, by two places for each hash: frequent grams come again and again.

    A gram takes a place from one of its own level or below, as those of high levels come most often and take most probes.
    """

    SLOTS = 1 << 20

    def __init__(self, f: LogFrequencyFilter, first: int = 1):
        self.filter, self.first = f, first
        # A key lies in the places of its own bits alone. Only key 0 would be taken for held before it was read: in its
        # place lies one whose places are others.
        self.keys = np.zeros(self.SLOTS, dtype=_U)
        self.keys[0] = (1 << 20) + 1
        self.held = np.zeros(self.SLOTS, dtype=np.uint8)

    def levels(self, keys: np.ndarray, repeat: bool = False) -> np.ndarray:
        """The levels; ``repeat`` says that the same grams come often within ``keys``."""
        at = self._place(keys, 0)
        out = self.held.take(at).astype(np.int64)
        new = np.flatnonzero(self.keys.take(at) != keys)
        some = keys.take(new)
        at = self._place(some, 1)
        out[new] = self.held.take(at)
        miss = np.flatnonzero(self.keys.take(at) != some)
        new, some = new.take(miss), some.take(miss)
        if repeat:
            some, inverse = np.unique(some, return_inverse=True)
            found = self.filter.levels(some, self.first)
            out[new] = found[inverse]
        else:
            found = out[new] = self.filter.levels(some, self.first)
        for i in range(2):
            at = self._place(some, i)
            fits = np.flatnonzero(self.held.take(at) <= found)
            at, mine = at.take(fits), some.take(fits)
            self.keys[at] = mine
            # Of keys with one place the last is held.
            last = np.flatnonzero(self.keys.take(at) == mine)
            self.held[at.take(last)] = found.take(fits.take(last))
            rest = np.ones(len(some), dtype=bool)
            rest[fits.take(last)] = False
            some, found = some[rest], found[rest]
        return out

    def _place(self, keys: np.ndarray, i: int) -> np.ndarray:
        at = (keys >> _U(20)) if i else keys
        return (at & _U(self.SLOTS - 1)).view(np.int64)


_latest: dict[int, RecentLevels] = {}


def _recent(f: LogFrequencyFilter, order: int = 1, first: int = 1) -> RecentLevels:
    """The levels last read of words' characters (order 1), or of word n-grams of an order from level ``first`` on; of one filter at a time."""
    if any(r.filter is not f for r in _latest.values()):
        _latest.clear()
    if order not in _latest or _latest[order].first != first:
        _latest[order] = RecentLevels(f, first)
    return _latest[order]


def spellings(words: Words | list[bytes], f: LogFrequencyFilter) -> np.ndarray:
    """log10 of the probability of each word's bytes and its end, by the n-grams."""
    flat, place, owner = gram_positions(words)
    # At a word's beginning a longer order has the key of the longest gram there is.
    levels = _recent(f).levels(np.concatenate(gram_keys(flat, place)), repeat=True).reshape(ORDER, len(flat))
    p = np.full(len(flat), 1 / 256)
    begun = place > 0
    every = HIGHEST[_recent(f).levels(ALL)[0]]
    for k in range(ORDER):
        # The context of order k is the gram of order k that ends one byte before; at order 0 it is all.
        seen, use = LOWEST[levels[k]], begun if k == 0 else place >= k
        of = np.full(len(flat), every) if k == 0 else np.concatenate([[0.0], HIGHEST[levels[k - 1]][:-1]])
        p = np.where(use, (np.minimum(seen, of) + PRIOR * p) / (of + PRIOR), p)
    return np.bincount(owner[begun], weights=np.log10(p[begun]), minlength=len(words))


def probabilities(keys: np.ndarray, p1: np.ndarray, high: np.ndarray, starts: np.ndarray, m: Model) -> np.ndarray:
    """The probability of each token given the two before it, of texts that begin at ``starts``.

    ``p1`` are the tokens' unigrams and ``high`` their counts at the upper end.
    """
    first = int(quantised(np.array([m.cutoff]))[0])
    before = preceding(keys, starts)
    of2 = np.concatenate([[0.0], high[:-1]])
    of2[starts] = HIGHEST[quantised(np.array([m.ends]))[0]]
    pairs = bigram_keys(before, keys)
    # A bigram that is held has both its words held as often.
    level2 = np.zeros(len(keys), dtype=np.int64)
    some = np.flatnonzero((of2 >= m.cutoff) & (high >= m.cutoff))
    level2[some] = _recent(m.filter, 2, first).levels(pairs[some])
    begins = np.zeros(len(keys), dtype=bool)
    begins[starts] = True
    context = np.where(begins, 0, np.concatenate([[0], level2[:-1]]))
    # A trigram that is held has both its bigrams held.
    level3 = np.zeros(len(keys), dtype=np.int64)
    some = np.flatnonzero((context > 0) & (level2 > 0))
    level3[some] = _recent(m.filter, 3, first).levels(trigram_keys(pairs[some - 1], keys[some]))
    of3 = HIGHEST[context]
    w3 = np.where(of3 > 0, W3, 0.0)
    w2 = np.where(of2 > 0, W2 + W3 - w3, 0.0)
    ratio3 = np.minimum(1.0, LOWEST[level3] / np.maximum(of3, 1))
    ratio2 = np.minimum(1.0, LOWEST[level2] / np.maximum(of2, 1))
    return w3 * ratio3 + w2 * ratio2 + (1 - w2 - w3) * p1


UNSTABLE = "a block's texts differ from those whose grams were looked up: docs must be a stable scan"
_SCORED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, filter_fill double, "
    "key long, times long"
)
_SCORED_SCHEMA = pa.schema(
    [(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (c.split() for c in _SCORED.split(", "))]
)


class WordValues:
    """What a model says of the words that a worker met last, by a place for each key: unigrams, counts at the upper end,
    exact counts or -1, and those counts' part of the base score."""

    SLOTS = 1 << 20

    def __init__(self, model: Model, slots: int = SLOTS):
        self.model, self.mask = model, _U(slots - 1)
        # A key lies in the place of its own low bits alone, so no key is taken for held before it was met.
        self.keys = np.arange(1, slots + 1, dtype=_U)
        self.held = [np.full(slots, -1, dtype=t) for t in ("f8", "f8", "i8", "f8")]

    def of(self, words: Words, keys: np.ndarray) -> list[np.ndarray]:
        at = (keys & self.mask).astype(np.int64)
        out = [x[at] for x in self.held]
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            some, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            c = self.model.exact(some)
            values = [*unigrams(words[new[first]], some, self.model), c, np.log10(np.maximum(c, 0) + 1.0)]
            at = at[new[first]]
            # A word takes the place of one that is no more frequent.
            fits = np.flatnonzero(self.held[2].take(at) <= c)
            self.keys[at.take(fits)] = some.take(fits)
            last = fits.take(np.flatnonzero(self.keys.take(at.take(fits)) == some.take(fits)))
            for mine, held, v in zip(out, self.held, values):
                mine[new] = v.take(inverse)
                held[at.take(last)] = v.take(last)
        return out


_values: dict[str, WordValues] = {}


def _values_of(m: Model) -> WordValues:
    """The values of the model that a worker used last."""
    if m.digest not in _values:
        _values.clear()
        _values[m.digest] = WordValues(m)
    return _values[m.digest]


_sharded: dict[str, Model] = {}


def forget() -> None:
    """Drop what this worker keeps of models. A function's own reference to these would be a copy, as it goes to workers by value."""
    for kept in (_values, _latest, _sharded):
        kept.clear()


def with_answers(m: Model, keys: np.ndarray, levels: np.ndarray, fill: float) -> Model:
    """The model with a block's levels in place of its filter. A worker has one for all blocks: what it read of words and
    grams in blocks before holds for this one too."""
    if m.digest not in _sharded:
        _sharded.clear()
        _sharded[m.digest] = replace(m, filter=Answers())
        _sharded[m.digest].digest = m.digest
    own = _sharded[m.digest]
    own.filter.take_up(keys, levels)
    own.fill = fill
    return own


def train(texts: DataFrame, cutoff: int = CUTOFF) -> tuple[Model, DataFrame, DataFrame, Shape]:
    """The model of all training texts, the exact counts of words (key, c), the sums of slices and the filter's shape."""
    nodes, stride = nodes_of(texts)
    fan, levels = fan_out(nodes)
    slices = fan**levels
    # The slices of the first level are cut further by each level that follows.
    sums = summed_slices(_counted(texts, fan, nodes, stride), fan, levels, cutoff)
    words = sums.filter(F.col("kind") == _WORD)
    distinct, tokens, values = words.agg(F.sum("n"), F.sum("total"), F.sum("values")).first()
    grams = level_sums(sums)
    shape = filter_shape(grams, slices, cutoff)
    f = build_filter(sums, shape) if shape.width * slices <= most_bits(texts.sparkSession) else None
    # The least level from which on at most HELD_WORDS words lie.
    frequent = int((np.cumsum(grams[_WORD][::-1])[::-1] > HELD_WORDS).sum())

    def expand(least: int):
        def rows(batches):
            for b in batches:
                for n, k, c in zip(*(b[x].to_pylist() for x in ("n", "keys", "counts"))):
                    keys, counts = unpack_keys(k, n), unpack_counts(c)
                    some = quantised(counts) >= least
                    columns = [pa.array(keys[some].view(np.int64)), pa.array(counts[some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "c"])

        return words.select("n", "keys", "counts").mapInArrow(rows, "key long, c long")

    counts = expand(1)
    ends = counts.filter(F.col("key") == int(END_KEY.astype(np.int64))).agg(F.sum("c")).first()[0]
    held = expand(frequent).toArrow()  # HELD_WORDS rows at most
    keys = held["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    m = Model(
        f, cutoff, float(tokens or 0), int(distinct or 0), float(values or 0), float(ends or 0), keys[order], held["c"].to_numpy()[order]
    )
    return m, counts, sums, shape


def scored(some: pa.Table, values: WordValues, m: Model):
    """Batches of _SCORED: a row for each text, without what words need that aren't held, and a row for each such word of a text."""

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCORED_SCHEMA], schema=_SCORED_SCHEMA)

    bytes_of = pc.binary_length(some["text"]).to_numpy(zero_copy_only=False) if some.num_rows else np.empty(0)
    edges = np.flatnonzero(np.diff((np.cumsum(bytes_of) - bytes_of) // BYTES_AT_ONCE, prepend=-1)).tolist()
    for low, high in zip(edges, [*edges[1:], some.num_rows]):
        part, n = some.slice(low, high - low), high - low
        rid = part["rid"].to_numpy()
        words, sizes = tokens_of(utf8(part["text"]))
        starts = np.cumsum(sizes) - sizes
        keys = words.keys()
        p1, upper, c, log = values.of(words, keys)
        yield batch(
            n, rid=rid, doc_id=part["doc_id"].to_pylist(), held_out=part["held_out"].to_pylist(), n_tokens=sizes,
            n_known=np.add.reduceat((c > 0).astype(np.int64), starts), base=np.add.reduceat(log, starts),
            score=np.add.reduceat(np.log10(probabilities(keys, p1, upper, starts, m)), starts), filter_fill=np.full(n, m.fill),
        )
        open_ = np.flatnonzero(c < 0)
        if len(open_):
            mine, number = np.unique(keys[open_], return_inverse=True)
            both, times = np.unique(np.repeat(np.arange(n), sizes)[open_] * len(mine) + number, return_counts=True)
            yield batch(len(both), rid=rid[both // len(mine)], key=mine[both % len(mine)].view(np.int64), times=times)


def blocked(rows: DataFrame) -> DataFrame:
    """Rows with a block: the texts of one partition that begin within the same BLOCK_BYTES."""
    schema, size = rows.selectExpr("*", "0L AS block").schema, BLOCK_BYTES

    def number(batches):
        seen, first = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            ends = seen + np.cumsum(pc.binary_length(b["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = np.concatenate([[seen], ends[:-1]])[: len(ends)]
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + starts // size, pa.int64())], [*b.schema.names, "block"])

    return rows.mapInArrow(number, schema)


def block_grams(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct keys of a block: words and their characters, and word n-grams."""
    words, sizes = tokens_of(texts)
    keys = words.keys()
    pairs = bigram_keys(preceding(keys, np.cumsum(sizes) - sizes), keys)
    unique, first = np.unique(keys, return_index=True)
    upper = [ALL, unique]
    for low in range(0, len(first), WORDS_AT_ONCE):
        flat, place, _ = gram_positions(words[first[low : low + WORDS_AT_ONCE]])
        upper.append(_sorted_distinct(np.concatenate(gram_keys(flat, place))))
    return [_sorted_distinct(np.concatenate(upper)), _sorted_distinct(np.concatenate([pairs, trigram_keys(pairs[:-1], keys[1:])]))]


_ASKED = "block long, slice int, upper boolean, n int, keys binary"
_ANSWERED = "of_block long, slice int, upper boolean, n int, levels binary, fill double"


def sharded_scores(rows: DataFrame, sums: DataFrame, shape: Shape, m: Model, parts: int) -> DataFrame:
    """Scores where the filter is too large for a broadcast: grams go to its slices, levels come back to the blocks.

    A block asks once for each distinct gram, so a gram of all texts is a few bytes of each block. The
    levels of a block come in the order of its grams and take a byte each.
    """

    def ask(batches):
        def requests(block: int, texts: list[bytes]):
            out = []
            for upper, keys in zip((True, False), block_grams(texts)):
                edges = np.searchsorted(_slice_of(keys, shape.slices), np.arange(shape.slices + 1)).tolist()
                out += [(block, s, upper, z - a, pack_keys(keys[a:z])) for s, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _ASKED.split(", ")])

        block, held = None, []
        for b in batches:
            for x, text in zip(b["block"].to_pylist(), utf8(b["text"])):
                if x != block and held:
                    yield requests(block, held)
                    held = []
                block = x
                held.append(text)
        if held:
            yield requests(block, held)

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        bits = shape.region(zip(*(own[x].to_pylist() for x in ("kind", "n", "keys", "counts"))))
        f = LogFrequencyFilter(bits, 1, shape.width, shape.hashes)
        levels = [
            zlib.compress(f.levels(unpack_keys(k.as_py(), n.as_py()), 1 if u.as_py() else shape.least).astype(np.uint8).tobytes(), 1)
            for k, n, u in zip(asked["keys"], asked["n"], asked["upper"])
        ]
        columns = [asked["block"], asked["slice"], asked["upper"], asked["n"], pa.array(levels, pa.binary()), pa.array([fill_of(bits)] * len(levels), pa.float64())]
        return pa.table(columns, [c.split()[0] for c in _ANSWERED.split(", ")])

    m.digest = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def score(some: pa.Table, answers: pa.Table) -> pa.Table:
        some = some.sort_by("rid")
        grams = block_grams(utf8(some["text"]))
        levels = []
        for upper, keys in zip((True, False), grams):
            own = answers.filter(pc.equal(answers["upper"], upper)).sort_by("slice")
            levels.append(np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in own["levels"].to_pylist()] or [np.empty(0, np.uint8)]))
            if len(levels[-1]) != len(keys):
                raise ValueError(UNSTABLE)
        own = with_answers(shared.value, np.concatenate(grams), np.concatenate(levels), float(pc.mean(answers["fill"]).as_py()))
        return pa.Table.from_batches(scored(some, _values_of(own), own), _SCORED_SCHEMA)

    texts = blocked(rows)
    asked = texts.select("block", "text").mapInArrow(ask, _ASKED).repartition(parts, "slice").groupBy("slice")
    answers = asked.cogroup(sums.repartition(parts, "slice").groupBy("slice")).applyInArrow(answer, _ANSWERED)
    blocks = texts.repartition(parts, "block").groupBy("block")
    return blocks.cogroup(answers.repartition(parts, "of_block").groupBy("of_block")).applyInArrow(score, _SCORED)


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, cutoff: int = CUTOFF) -> DataFrame:
    """Learn from the documents outside one fold and score all whole texts.

    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) with exact counts (of 64-bit word hashes); ``score`` is the log10
    probability of the text by the n-gram model. Null text is empty and has its end alone; documents
    without a doc_id are scored and not learned from, and their ``held_out`` is null; rows that repeat
    count each time. An empty table gives no rows; columns besides doc_id and text are ignored.
    ``docs`` is a stable scan: its splits make the blocks, which is verified where blocks are used.
    """
    spark = docs.sparkSession
    text_batches(spark)
    fold = crc_mod(F.col("doc_id"), folds)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold == held).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    model, counts, sums, shape = train(docs.filter(fold != held).select(F.coalesce("text", F.lit("")).alias("text")), cutoff)
    if model.filter is None:
        # As many tasks as the input asks for, so that a task's share doesn't grow with it.
        found = sharded_scores(rows, sums, shape, model, 2 * partitions_of(docs))
    else:
        shared = spark.sparkContext.broadcast(model)

        def score(batches):
            m, held = shared.value, []
            for b in batches:
                held.append(b)
                if sum(x.nbytes for x in held) >= BYTES_AT_ONCE:
                    yield from scored(pa.Table.from_batches(held), _values_of(m), m)
                    held = []
            if held:
                yield from scored(pa.Table.from_batches(held), _values_of(m), m)

        found = rows.mapInArrow(score, _SCORED)
    base, known = F.col("base"), F.col("n_known")
    if not model.whole:
        found = materialize(found, "scores")
        exact = F.coalesce("c", F.lit(0))
        open_words = found.filter("times IS NOT NULL").select("rid", "key", "times").join(counts, "key", "left")
        by_text = open_words.groupBy("rid").agg(
            F.sum(F.col("times") * F.log10(exact + 1)).alias("more"), F.sum(F.when(exact > 0, F.col("times")).otherwise(0)).alias("more_known")
        )
        found = found.filter("times IS NULL").join(by_text, "rid", "left")
        base, known = base + F.coalesce("more", F.lit(0.0)), known + F.coalesce("more_known", F.lit(0))
    each = math.log10(model.tokens + model.distinct + 1)
    return found.select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score", F.lit(cutoff).alias("cutoff"), "filter_fill",
    )
