"""Operator 10: token ids in compact binary files, by an adaptive context-mixing range coder.

A block holds some whole documents' ids and is coded by itself: its model starts afresh and
its checksums cover both the coded bytes and the ids. Inside a block the ids form many lanes
of equal length that are coded side by side, one id of every lane in a step, so that numpy
does each step for all lanes at once; all lanes teach one model. An id's probability is the mixture of

* order 2: the id that last followed the two ids before it (a hashed table),
* order 1: the id that last followed the id before it,
* order 0: the frequencies of the ids so far after an id of the same group, in lanes of the same
  class and in all lanes (ids form two groups: those that end a word, where the tokenizer has such),

with weights that adapt to the share that each prediction of such confidence had in the
probabilities of the ids that came. A lane's class is found before coding (a few rounds of
clustering lanes by their ids, most often by language) and written with the block, as are the groups and
which ids occur at all: the model numbers those alone. Each lane has a carryless range coder of 64 bits that puts out words of 16. All of the model is in integers, so that
every machine decodes alike.

The files are Parquet, as the container that every Spark store can commit and split: a row is
a block (part, block, local_start, n_docs, n_ids, payload), rows are in ascending doc_id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import gathered, mix64, partitions_of, table_path, text_batches
from quire.llm.token_ids import encoder

BLOCK_IDS = 1 << 20
MAX_LANES, LANE_IDS = 4096, 128
_MAGIC = b"QTB2"
_HEAD = struct.Struct("<4sIIIII")
_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 40)
_W16, _W48 = _U(16), _U(48)
#: Bits of the mixing weights; those of the order-0 frequencies follow the distinct ids, up to a bound.
_MIX_BITS, _MAX_ZERO_BITS = 12, 20
_CONFIDENT = 7
#: Classes of lanes, the ids of a lane that clustering reads, and its rounds.
CLASSES, _CLASS_IDS, _CLASS_ROUNDS = 5, 24, 5
_TABLES = 2 * CLASSES


def lane_classes(grid: np.ndarray) -> np.ndarray:
    """The class of each lane of (steps, lanes): hard clustering by the ids' frequencies."""
    some = grid[:: max(1, len(grid) // _CLASS_IDS)][:_CLASS_IDS]
    lanes = some.shape[1]
    # Neighbours most often belong to one document, so they begin in one class.
    of = (mix64(np.arange(lanes, dtype=_U) // _U(4)) >> _U(33)).astype(np.int64) % CLASSES
    values, at = np.unique(some, return_inverse=True)
    at, width = at.reshape(some.shape), len(values)
    prior = 0.5 * np.bincount(at.ravel(), minlength=width) / at.size
    for _ in range(_CLASS_ROUNDS):
        counts = np.bincount((of * width + at).ravel(), minlength=CLASSES * width).reshape(CLASSES, width)
        share = np.log(0.5 * counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) + prior)
        of = np.stack([share[c][at].sum(axis=0) for c in range(CLASSES)]).argmax(axis=0)
    return of.astype(np.uint8)


class _Model:
    """The adaptive predictions of one block, of ids numbered from 0; coder and decoder drive it in the same way."""

    def __init__(self, n_ids: int, vocab: int, of: np.ndarray, groups: np.ndarray):
        self.vocab, self.of, lanes = vocab, of.astype(np.int64) * 2, len(of)
        self.groups = groups.astype(np.int64)
        self.bits = min(_MAX_ZERO_BITS, max(12, (vocab * 24).bit_length()))
        self.one = 1 << self.bits
        if 2 * vocab > self.one:
            raise ValueError(f"a block has more than {self.one // 2} distinct ids")
        self.mask = (1 << max(10, min(19, n_ids.bit_length()))) - 1
        # The tables and the mixture take 32 bits where their numbers fit; the results don't depend on it.
        id_bits = (vocab - 1).bit_length()
        self.kind = np.uint32 if 14 + id_bits + 3 <= 32 else np.uint64
        self.wide = np.int32 if _MIX_BITS + self.bits < 31 else np.int64
        self.above, self.id_mask = self.kind(id_bits + 3), self.kind((1 << id_bits) - 1)
        self.second = np.zeros(self.mask + 1, dtype=self.kind)  # check << above | id << 3 | confidence
        self.first = np.zeros(vocab, dtype=np.uint32)  # id << 3 | confidence
        self.prior = [np.zeros(lanes, dtype=np.int64) for _ in range(2)]  # the last id, the one before
        self.shares = np.tile(np.array([2, 1, 16], dtype=np.int64) << 10, (128, 1))
        self.counts = np.zeros((_TABLES, vocab), dtype=np.int64)
        self.recent: list[np.ndarray] = []
        self.lane_row, self.group_row = self.of * vocab, self.groups * vocab
        self.step, self.due = 0, 1
        self._weights()
        self._zero()

    def _weights(self) -> None:
        total = self.shares.sum(axis=1, keepdims=True)
        f = 1 + self.shares * ((1 << _MIX_BITS) - 3) // total
        f[:, 2] += (1 << _MIX_BITS) - f.sum(axis=1)
        # Weights of the spikes are on the scale of the mixture's whole range.
        self.w2, self.w1, self.w0 = ((f[:, k] << by).astype(self.wide) for k, by in enumerate((self.bits, self.bits, 0)))

    def _zero(self) -> None:
        every = self.counts.reshape(CLASSES, 2, self.vocab).sum(axis=0)
        room = self.one - self.vocab
        general = np.tile(every * (room >> 3) // np.maximum(1, every.sum(axis=1, keepdims=True)), (CLASSES, 1))
        own = np.maximum(1, self.counts.sum(axis=1, keepdims=True))
        f = 1 + general + self.counts * (room - (room >> 3)) // own
        f[np.arange(_TABLES), f.argmax(axis=1)] += self.one - f.sum(axis=1)
        self.zero_freq = f.ravel().astype(self.wide)
        self.zero_cum = (np.cumsum(f, axis=1) - f).ravel().astype(self.wide)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each value of each class's order-0 range."""
        if self._slots is None:
            kind = np.uint16 if self.vocab <= 1 << 16 else np.int32
            self._slots = np.repeat(np.tile(np.arange(self.vocab, dtype=kind), _TABLES), self.zero_freq)
        return self._slots

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: both tables' entries and their places, and the weights."""
        a, b = self.prior[0][:n], self.prior[1][:n]
        h = a * 0x2F0B4F35 + b * 0x1B873593
        self.at2, self.check = h >> 9 & self.mask, (h >> 29 & 0x3FFF).astype(self.kind) << self.above
        self.at1 = a
        self.e2, self.e1 = self.second.take(self.at2), self.first.take(a)
        known = (self.e2 ^ self.check) >> self.above == 0
        self.held2 = self.e2 & self.kind(7)
        self.sure2, self.sure1 = self.held2 * known, self.e1 & np.uint32(7)
        self.p2, self.p1 = (self.e2 >> self.kind(3) & self.id_mask).astype(self.wide), (self.e1 >> np.uint32(3)).astype(self.wide)
        self.base = (self.sure2.astype(np.uint8) * 8 + self.sure1.astype(np.uint8)) * 2 + (self.p2 == self.p1)
        at = self.base.astype(np.intp)
        self.s2, self.s1, self.s0 = self.w2.take(at), self.w1.take(at), self.w0.take(at)
        self.row = self.lane_row[:n] + self.group_row.take(a)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's part of the range begins, and its size."""
        self.at = at = self.row + x
        low = self.s0 * self.zero_cum.take(at) + (x > self.p2) * self.s2 + (x > self.p1) * self.s1
        self.hit2, self.hit1 = x == self.p2, x == self.p1
        self.part0 = self.s0 * self.zero_freq.take(at)
        return low, self.part0 + self.hit2 * self.s2 + self.hit1 * self.s1

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids in whose parts the values lie."""
        at2, at1 = self.row + self.p2, self.row + self.p1
        low2, low1 = self.s0 * self.zero_cum.take(at2), self.s0 * self.zero_cum.take(at1)
        past2 = v >= low2 + (self.p2 > self.p1) * self.s1
        past1 = v >= low1 + (self.p1 > self.p2) * self.s2
        # Without the spikes that begin before it, a value lies in the order-0 range, or short of a spike's end.
        rest = v - past2 * self.s2 - past1 * self.s1
        in2 = past2 & (rest < low2 + self.s0 * self.zero_freq.take(at2))
        in1 = past1 & (rest < low1 + self.s0 * self.zero_freq.take(at1))
        spike = np.maximum(in2 * (self.p2 + 1), in1 * (self.p1 + 1)) - 1
        free = np.flatnonzero(spike < 0)
        part = np.uint32 if self.wide is np.int32 else _U
        slot = np.minimum(rest[free].view(part) // self.s0[free].view(part), part(self.one - 1)).astype(np.int64)
        table = self.of[free] + self.groups.take(self.at1[free])
        spike[free] = self.slots.take((table << self.bits) + slot)
        return spike

    def learn(self, x: np.ndarray) -> None:
        """Take up the ids for which ``interval`` was last called."""
        n = len(x)
        fresh = x.astype(np.uint32) << np.uint32(3) | np.uint32(1)
        held = self.sure2 > 0
        # A hit adds 1 up to the bound, a miss takes 1; an entry of other ids that has no more is replaced.
        up = held & self.hit2
        e2 = self.e2 - self.kind(1) + up + (up & (self.sure2 < _CONFIDENT))
        self.second[self.at2] = np.where(held | (self.held2 > 1), e2, self.check | fresh)
        e1 = self.e1 - np.uint32(1) + self.hit1 + (self.hit1 & (self.sure1 < _CONFIDENT))
        self.first[self.at1] = np.where(self.sure1 > 0, e1, fresh)
        if self.step < 32 or self.step & 3 == 0:
            # An id that no spike stands on is all order 0's; sums of small integers are exact in doubles.
            hit = self.hit2 | self.hit1
            some = np.flatnonzero(hit)
            self.shares[:, 2] += np.bincount(self.base[~hit], minlength=128) << 8
            base, part0 = self.base[some], self.part0[some].astype(np.int64)
            parts = self.hit2[some] * self.s2[some].astype(np.int64), self.hit1[some] * self.s1[some].astype(np.int64), part0
            whole = parts[0] + parts[1] + part0
            for k, part in enumerate(parts):
                self.shares[:, k] += np.bincount(base, weights=(part << 8) // whole, minlength=128).astype(np.int64)
        if self.step & 7 == 0:
            much = self.shares.sum(axis=1, keepdims=True) > 1 << 24
            self.shares = np.where(much, self.shares >> 1, self.shares)
        if self.step < 16 or self.step & 3 == 0:
            self._weights()
        self.prior[1][:n] = self.prior[0][:n]
        self.prior[0][:n] = x
        self.recent.append(self.at)
        self.step += 1
        if self.step == self.due:
            self.due += min(self.due, 64)
            self.counts += np.bincount(np.concatenate(self.recent), minlength=_TABLES * self.vocab).reshape(_TABLES, self.vocab)
            self.recent = []
            self._zero()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps for ``n`` ids."""
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _shifts(low: np.ndarray, rng: np.ndarray):
    """Shift 16 bits out of the coders that can't go on, until all can: the coders' places, and ``low`` before it, each time."""
    a, b, idx = low, rng, None
    while True:
        settled = (a ^ (a + b)) < _TOP
        need = np.flatnonzero(settled | (b < _BOT))
        if not len(need):
            return
        a, b = a[need], b[need]
        b = np.where(settled[need], b, (~a + _U(1)) & (_BOT - _U(1)))
        idx = need if idx is None else idx[need]
        yield idx, a
        a, b = a << _W16, b << _W16
        low[idx] = a
        rng[idx] = b


def encode_ids(ids: np.ndarray, vocab: int, groups: np.ndarray | None = None) -> bytes:
    """Code a block of ids below ``vocab``; ``groups`` marks the ids of the second group."""
    n = len(ids)
    if not n:
        return b""
    occurs = np.bincount(ids, minlength=vocab) > 0
    present = np.flatnonzero(occurs)
    groups = np.zeros(len(present), dtype=bool) if groups is None else groups[present]
    number = (np.cumsum(occurs) - 1).astype(np.int32)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = number[ids]
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    of = lane_classes(grid)
    model = _Model(n, len(present), of, groups)
    all_low, all_range = np.zeros(lanes, dtype=_U), np.full(lanes, ~_U(0), dtype=_U)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []
    for t in range(steps):
        k = -(-(n - t) // steps)
        x, low, rng = grid[t, :k], all_low[:k], all_range[:k]
        model.predict(k)
        begin, part = model.interval(x)
        r = rng >> _U(_MIX_BITS + model.bits)
        low += begin.astype(_U) * r
        rng[:] = part.astype(_U) * r
        for idx, a in _shifts(low, rng):
            out_lane.append(idx.astype(np.uint16))
            out_word.append((a >> _W48).astype("<u2"))
        model.learn(x)
    last = (all_low + _U(0xFFFFFFFF)) >> _U(32)
    for word in (last >> _W16, last & _U(0xFFFF)):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append(word.astype("<u2"))
    lane = np.concatenate(out_lane)
    words = np.concatenate(out_word)[np.argsort(lane, kind="stable")]
    sizes = np.bincount(lane, minlength=lanes).astype("<u4").tobytes()
    side = zlib.compress(of.tobytes() + np.packbits(occurs).tobytes() + np.packbits(groups).tobytes())
    return struct.pack("<I", len(side)) + side + sizes + words.tobytes()


def decode_ids(coded: bytes, n: int, vocab: int) -> np.ndarray:
    """The ids of a block."""
    if not n:
        return np.empty(0, dtype=np.int64)
    lanes, steps = _shape(n)
    (size,) = struct.unpack_from("<I", coded)
    side, coded = np.frombuffer(zlib.decompress(coded[4 : 4 + size]), dtype=np.uint8), coded[4 + size :]
    of, present = side[:lanes], np.flatnonzero(np.unpackbits(side[lanes:], count=vocab))
    groups = np.unpackbits(side[lanes + -(-vocab // 8) :], count=len(present))
    sizes = np.frombuffer(coded, dtype="<u4", count=lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(coded, dtype="<u2", offset=4 * lanes), np.zeros(4, "<u2")]).astype(_U)
    ends = np.cumsum(sizes)
    ptr = ends - sizes
    over = len(words) - 1

    def take(i):
        got = words[np.where(ptr[i] < ends[i], ptr[i], over)]
        ptr[i] += 1
        return got

    every = np.arange(lanes)
    all_code = np.zeros(lanes, dtype=_U)
    for _ in range(4):
        all_code = all_code << _W16 | take(every)
    model = _Model(n, len(present), of, groups)
    all_low, all_range = np.zeros(lanes, dtype=_U), np.full(lanes, ~_U(0), dtype=_U)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    for t in range(steps):
        k = -(-(n - t) // steps)
        low, rng, code = all_low[:k], all_range[:k], all_code[:k]
        model.predict(k)
        r = rng >> _U(_MIX_BITS + model.bits)
        v = np.minimum((code - low) // r, _U((1 << _MIX_BITS + model.bits) - 1)).astype(model.wide)
        x = model.find(v)
        begin, part = model.interval(x)
        low += begin.astype(_U) * r
        rng[:] = part.astype(_U) * r
        grid[t, :k] = x
        for idx, _ in _shifts(low, rng):
            code[idx] = code[idx] << _W16 | take(idx)
        model.learn(x)
    return present[grid.T.reshape(-1)[:n]]


def pack_block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, vocab: int, groups: np.ndarray | None = None) -> bytes:
    """A block: header, the documents' ids and lengths, the coded ids."""
    docs = np.array([(-1 if d is None else d) for d in doc_ids], dtype="<i8").tobytes()
    null = np.packbits([d is None for d in doc_ids]).tobytes()
    table = zlib.compress(docs + null + np.array(counts, dtype="<u4").tobytes())
    body = struct.pack("<I", len(table)) + table + encode_ids(ids, vocab, groups)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(_MAGIC, vocab, len(doc_ids), len(ids), check, zlib.crc32(body)) + body


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents of a block, their lengths and all their ids; raises if a checksum differs."""
    magic, vocab, n_docs, n_ids, check, body_check = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(body) != body_check:
        raise ValueError("not a block, or a damaged one")
    (size,) = struct.unpack_from("<I", body)
    table = zlib.decompress(body[4 : 4 + size])
    docs = np.frombuffer(table, dtype="<i8", count=n_docs).tolist()
    null = np.unpackbits(np.frombuffer(table, dtype=np.uint8, offset=8 * n_docs, count=-(-n_docs // 8)), count=n_docs)
    counts = np.frombuffer(table, dtype="<u4", offset=8 * n_docs + -(-n_docs // 8), count=n_docs)
    ids = decode_ids(body[4 + size :], n_ids, vocab)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("the decoded ids differ from those coded")
    return [None if z else d for d, z in zip(docs, null)], counts.astype(np.int64), ids


_BLOCKS = "part int, block int, local_start long, n_docs long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, each with ``end_id`` after it, into files at ``path`` in ascending doc_id.

    Null text is empty; null doc_ids come first; repeated rows are written once each. A block
    takes documents until ``block_ids`` ids, and a longer document is a block of its own, so a
    task holds one batch of texts (some megabytes of them) and one block.
    """
    text_batches(docs.sparkSession)

    def code(batches):
        e = encoder(tokenizer)
        groups = e.ends | (np.arange(e.size) == end_id)
        part = TaskContext.get().partitionId()
        held_docs, held_ids, held, before, block = [], [], 0, 0, 0

        def close():
            nonlocal held_docs, held_ids, held, before, block
            counts = [len(x) for x in held_ids]
            ids = np.concatenate(held_ids)
            row = [part, block, before, len(counts), len(ids), pack_block(held_docs, counts, ids, e.size, groups)]
            before, block = before + len(ids), block + 1
            held_docs, held_ids, held = [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, row))], schema=_SCHEMA)

        for some in gathered(batches):
            ids, at = e.encode_column(some["text"], end_id)
            at = at.tolist()
            for doc, a, z in zip(some["doc_id"].to_pylist(), at, at[1:]):
                if held and held + z - a > block_ids:
                    yield close()
                held_docs.append(doc)
                held_ids.append(ids[a:z])
                held += z - a
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions_of(docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(code, _BLOCKS).write.option("compression", "uncompressed").parquet(path)


_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_SCHEMA = pa.schema(
    [(n, pa.int32() if n in ("part", "block") else pa.binary() if n == "payload" else pa.int64()) for n in _NAMES]
)
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: the totals of the parts, one row each
    on the driver, give by prefix sums where a part begins.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        starts[r["part"]] = at
        at += r["n"]

    def read(batches):
        for b in batches:
            for part, local, payload in zip(*(b[c].to_pylist() for c in ("part", "local_start", "payload"))):
                docs, counts, ids = read_block(payload)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - counts).tolist(), ends.tolist())]
                first = starts[part] + local
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ends - counts + first), pa.array(counts), pa.array(crcs, pa.int64())],
                    [c.split()[0] for c in _DOCS.split(", ")],
                )

    return blocks.select("part", "local_start", "payload").mapInArrow(read, _DOCS)


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files (in the shared folder unless ``path`` is given) and report what they hold.

    An empty table writes no block and gives no rows; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    path = path or table_path(spark, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(spark, path)
