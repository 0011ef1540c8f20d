"""Operator 1: SentencePiece encoding and decoding on the tokenizers library.

The model file is read as protobuf wire format, without generated classes, and rebuilt as a
tokenizers pipeline: the normaliser (character map, white-space rules, the metaspace mark and
dummy prefix), the pieces with their scores as a unigram model, or as the merges of a BPE model
ranked by score, byte fallback, and the decoder. Where no piece holds a mark after another
character and the normaliser leaves characters alone, a space parts what can't be merged:
then every distinct word is encoded once by each worker, by several threads in batches, and its
ids are compared with the sentencepiece library's own; as no piece reaches across a space, the
words' ids are the text's. Texts with spaces that may merge, and other models', are encoded and
compared whole.

In a text only normal and user-defined pieces may match. Merges reach no others; a rebuilt unigram
model holds them (control, unknown, unused, byte) under names that no text has, and byte fallback
is done on the surfaces of its unknown tokens.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import Memo, text_batches, utf8

MARK = "▁"
#: Fixed value: what an unknown id decodes to.
UNKNOWN_TEXT = " \u2047 "
UNIGRAM, BPE = 1, 2
# The kinds of pieces in the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def wire_fields(data: bytes):
    """(number, value) of each field of a protobuf message; groups don't occur in this format."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't part of a model file")
        if at > len(data):
            raise ValueError("the model file ends within a field")
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a model file says that encoding and decoding need."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in wire_fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire_fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire_fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 24:
                    m.space_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in wire_fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    if not m.pieces:
        raise ValueError("the model file has no pieces")
    if m.space_as_suffix or m.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with leading marks are supported")
    return m


def merges_of(m: PieceModel) -> list[tuple[str, str]]:
    """The merges of a BPE model: every way to part a piece in two pieces, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(ids, key=lambda p: (-m.pieces[ids[p]][1], ids[p]))
    return [(p[:k], p[k:]) for p in ranked for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]


def hidden(m: PieceModel, i: int) -> str:
    """The name of piece ``i`` where no text may match it: it holds a space, and spaces are replaced before the match.

    Only in models that leave spaces alone could a text match the name, by two noncharacters.
    """
    return f" {i} " if m.escape_spaces else f"\ufdd0{i}\ufdd1"


def build_tokenizer(m: PieceModel, decoding: bool = False):
    """The tokenizers pipeline that stands for a model: its encoder, or its decoder with all pieces' own names."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if m.remove_extra_spaces:
        # Marks of the text's own at its end go too.
        steps.append(normalizers.Replace(Regex(f"{MARK if m.escape_spaces else ' '}+$"), ""))
    usual = [s for _, s, kind in m.pieces if kind == NORMAL]
    least = min(usual, default=0.0)
    if decoding:
        pieces = [(UNKNOWN_TEXT if kind == UNKNOWN else p, s) for p, s, kind in m.pieces]
    elif m.model_type == UNIGRAM:
        pieces = [(p, s) if kind in (NORMAL, USER_DEFINED) else (hidden(m, i), least) for i, (p, s, kind) in enumerate(m.pieces)]
    else:
        pieces = [(p, s) for p, s, _ in m.pieces]
    if m.model_type == UNIGRAM:
        model = models.Unigram(pieces, m.unk_id, False)
    else:
        vocab = {p: i for i, (p, _) in enumerate(pieces)}
        model = models.BPE(vocab, merges_of(m), unk_token=pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own and not decoding:
        t.add_tokens(own)
    return t


def parted_by_spaces(m: PieceModel) -> bool:
    """Whether words between spaces have the same ids wherever they stand."""
    plain = not m.charsmap and not m.remove_extra_spaces and m.add_dummy_prefix and m.escape_spaces
    inner = any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))
    return plain and not inner and m.model_type == BPE and all(kind != USER_DEFINED for _, _, kind in m.pieces)


class _Words(Memo):
    """A word cache that forgets a word's verdict only together with the word."""

    def __init__(self, fill, unlike: set[bytes]):
        super().__init__(fill)
        self.unlike = unlike

    def clear(self) -> None:
        super().clear()
        self.unlike.clear()


class PieceCodec:
    """Encodes and decodes with one model; keeps a bounded cache of words."""

    def __init__(self, path: str | bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        data = path
        if isinstance(path, str):
            with open(path, "rb") as f:
                data = f.read()
        m = self.model = parse_model(data)
        self.tokenizer, self.decoder = build_tokenizer(m), build_tokenizer(m, decoding=True)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = parted_by_spaces(m)
        self.unlike: set[bytes] = set()
        self.memo = _Words(self._words, self.unlike)
        # Fixed value: the names of byte pieces.
        bytes_at = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.byte_ids = [bytes_at.get(f"<0x{b:02X}>", m.unk_id) for b in range(256)] if m.byte_fallback else None
        self.silent = np.array([kind == CONTROL for _, _, kind in m.pieces])
        self.marked = [kind != UNKNOWN and p.startswith(MARK) for p, _, kind in m.pieces]
        self.bare = {i for i, (p, _, _) in enumerate(m.pieces) if p == MARK and m.remove_extra_spaces}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts; a unigram model's unknown token stands for the bytes of its surface, with byte fallback."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.model.model_type == UNIGRAM and self.byte_ids:
            unknown, of = self.model.unk_id, self.byte_ids.__getitem__
            some = [k for k, x in enumerate(ids) if unknown in x]
            # Only the slower call keeps the surfaces.
            for k, e in zip(some, self.tokenizer.encode_batch([texts[k] for k in some], add_special_tokens=False)):
                ids[k] = [x for i, t in zip(e.ids, e.tokens) for x in ([i] if i != unknown else map(of, t.encode()))]
        return ids

    def _both(self, texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of texts, and whether each text's are the sentencepiece library's own."""
        some = [t.decode() for t in texts]
        ids = self._ids(some)
        agree = [a == b for a, b in zip(ids, self.own.encode(some, num_threads=1))]
        return [np.asarray(x, dtype="<u4").tobytes() for x in ids], agree

    def _words(self, words: list[bytes]) -> list[bytes]:
        ids, agree = self._both(words)
        self.unlike.update(w for w, same in zip(words, agree) if not same)
        return ids

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """The packed ids of each text, and whether both libraries agree on it."""
        if not self.by_word:
            return self._both(texts)
        out, agree = [], []
        split = [t.split(b" ") for t in texts]
        self.memo.learn(w for words in split if b"" not in words for w in words)
        get = self.memo.__getitem__
        for t, words in zip(texts, split):
            if b"" in words:  # several spaces in a row, or at an end: marks may merge
                ids, same = self._both([t]) if t else ([b""], [True])
                out += ids
                agree += same
            else:
                out.append(b"".join(map(get, words)))
                agree.append(not self.unlike or self.unlike.isdisjoint(words))
        return out, agree

    def decode(self, packed: list[bytes]) -> list[str]:
        """The texts of packed ids; control pieces have none."""
        some = [np.frombuffer(x, dtype="<u4") for x in packed]
        some = [(x[~self.silent[x]] if len(x) else x).tolist() for x in some]
        if self.bare:
            some = [x[next((k for k, i in enumerate(x) if i not in self.bare), len(x)) :] for x in some]
        texts = self.decoder.decode_batch(some, skip_special_tokens=False)
        if not (self.model.add_dummy_prefix or self.model.remove_extra_spaces):
            return texts
        # The mark of the first piece stands for the beginning, not for a space.
        return [t[1:] if x and self.marked[x[0]] else t for x, t in zip(some, texts)]


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 2) -> PieceCodec:
    return PieceCodec(path, threads)


def encode_documents(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """(doc_id, ids, parity): packed little-endian unsigned 32-bit ids of each whole text; null is empty."""
    text_batches(docs.sparkSession)

    def run(batches):
        c = codec(model, threads)
        for b in batches:
            ids, agree = c.encode(utf8(b["text"]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(agree, pa.bool_())], ["doc_id", "ids", "parity"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, parity boolean")


def decode_documents(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """(doc_id, text): the texts of packed ids; null ids give null text."""

    def run(batches):
        c = codec(model, threads)
        for b in batches:
            ids = b["ids"].to_pylist()
            texts = iter(c.decode([x for x in ids if x is not None]))
            back = [None if x is None else next(texts) for x in ids]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(back, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_REPORT = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, text_sha256 string, parity boolean"


def codec_report(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """Encode and decode every whole text; a row for each row of ``docs``.

    n_ids and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), whether the decoded
    text equals the text, the decoded text's sha256, and whether the sentencepiece library gives
    the same ids. Null text is empty; rows are independent, so repeats repeat their results.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        c = codec(model, threads)
        for b in batches:
            texts = utf8(b["text"])
            ids, agree = c.encode(texts)
            back = [t.encode() for t in c.decode(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].cast(pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(zlib.crc32, ids), pa.int64()),
                    pa.array([x == y for x, y in zip(back, texts)], pa.bool_()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array(agree, pa.bool_()),
                ],
                [f.split()[0] for f in _REPORT.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _REPORT)
