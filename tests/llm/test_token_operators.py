"""Operators 1, 3 and 10 against the libraries' own results."""

import os
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_data import ODD

from quire.llm import common, token_files
from quire.llm.packing import pack_documents
from quire.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_path
from quire.llm.sentencepiece_codec import PieceCodec, codec_report, decode_documents, encode_documents, merges_of, parse_model, wire_fields
from quire.llm.token_ids import TextEncoder, encoder

WORDS, PIECES = tokenizer_path(WORD_TOKENIZER), tokenizer_path(PIECE_MODEL)
TRICKY = [
    "Hello, World!! don't it's we'll café É é İstanbul ΑΣ ß ẞ K Å", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "123,4 x\x1cw x\x85y naïve... (hi) 'S 'LL",
    "中文字 emoji😀😀 é", "", " \n\t ", "$$$ a$$$ a_b-c d'e", "x" * 3000,
]


def ids_of(text):
    return encoder(WORDS).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", [WORD_TOKENIZER, "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = TextEncoder(tokenizer_path(name))
    for text, ids in zip(TRICKY, e.encode([t.encode() for t in TRICKY])):
        assert np.frombuffer(ids, e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_starts_anew_at_its_bound():
    e = TextEncoder(WORDS)
    e.memo.limit = 3
    texts = [b"a b c", b"d e f g", b"a d"]
    assert e.encode(texts) == TextEncoder(WORDS).encode(texts)


class CountedMemo(common.Memo):
    """Counts the words that are looked up."""

    looked = 0

    def __getitem__(self, word):
        self.looked += 1
        return super().__getitem__(word)

    def get(self, word, default=None):
        self.looked += 1
        return super().get(word, default)


def test_encoder_looks_a_word_up_once_a_batch():
    e = TextEncoder(WORDS)
    e.memo = CountedMemo(e.memo.fill)
    texts = [b"alpha beta, alpha " * 500, b"beta, gamma\t" * 500]
    got = e.encode(texts)
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [ids_of(t.decode())[:-1] for t in texts]
    # Three words, and their parts without marks; before, each of the 2500 occurrences.
    assert e.memo.looked < 20


@pytest.mark.parametrize("name", [WORD_TOKENIZER, "byte_bpe_50k.json"])
def test_encoder_takes_columns(name):
    e = TextEncoder(tokenizer_path(name))
    texts = ["off", None, *TRICKY, None]
    ids, at = e.encode_column(pa.array(texts).slice(1), 1)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts[1:]]
    assert [ids[a:z].tolist() for a, z in zip(at.tolist(), at.tolist()[1:])] == want
    assert [len(x) for x in e.encode_column(pa.array([], pa.string()), 1)] == [0, 1]


def test_memo_bounds_hold_for_distinct_words():
    m = common.Memo(lambda words: [w * 2 for w in words], limit=3)
    long = b"x" * (common.LONG_WORD + 1)
    assert m.values_of([b"a", long]) == [b"aa", long * 2] and long in m
    assert m.values_of([b"b", b"a"]) == [b"bb", b"aa"] and long not in m
    # A bound is met: the cache starts anew, and what it held before is still given.
    assert m.values_of([b"a", b"c", b"d"]) == [b"aa", b"cc", b"dd"] and set(m) == {b"c", b"d"}


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["x" * 100]}) for k in range(7)]
    some = list(common.gathered(iter(batches), 250))
    assert [b["doc_id"].to_pylist() for b in some] == [[0, 1, 2], [3, 4, 5], [6]]
    assert list(common.gathered(iter([]))) == []


def test_packing(spark, documents):
    docs = documents(ODD)
    rows = pack_documents(docs, WORDS, window=64).collect()
    want = sorted(len(ids_of(t)) for _, t in ODD)
    pieces: dict = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(want)
    texts = {(i, len(ids_of(t))): ids_of(t) for i, t in ODD}
    for key, parts in pieces.items():
        ids = np.array(texts[key], "<u4")
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for s, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == len(by) - 1
    assert pack_documents(documents([]), WORDS).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [0] * 5000, [7, 7, 8] * 700, list(range(49000)), [49407] * 40])
def test_coder_round_trip(ids):
    ids = np.array(ids, dtype=np.int64)
    assert (token_files.decode_ids(token_files.encode_ids(ids, 49408), len(ids), 49408) == ids).all()


def test_coder_random_round_trip_and_size():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 60_000) % 49408
    groups = rng.random(49408) < 0.5
    for g in (None, groups):
        coded = token_files.encode_ids(ids, 49408, g)
        assert (token_files.decode_ids(coded, len(ids), 49408) == ids).all()
    f = np.bincount(ids) / len(ids)
    # Independent ids: not much above their own entropy, learned as it goes.
    assert len(token_files.encode_ids(ids, 49408)) < 1.35 * len(ids) * -(f[f > 0] * np.log2(f[f > 0])).sum() / 8


@pytest.mark.parametrize("top,crc,narrow", [(900, 2373122456, True), (4000, 284185773, True), (49408, 644975131, True), (40_000, None, False)])
def test_coder_tables_of_either_width_code_alike(top, crc, narrow):
    ids = np.concatenate([np.arange(top), np.arange(top)[::-1]])
    if crc:
        rng = np.random.default_rng(5)
        for t in (900, 4000, 49408):
            ids = rng.zipf(1.2, 50_000) % t
            if t == top:
                break
        ids[20_000:40_000] = ids[:20_000]
    coded = token_files.encode_ids(ids, 49408, np.arange(49408) % 3 == 0)
    # The sums are those of the coder whose numbers all had 64 bits: files written by it are still read.
    assert crc is None or zlib.crc32(coded) == crc
    assert (token_files.decode_ids(coded, len(ids), 49408) == ids).all()
    distinct = len(np.unique(ids))
    model = token_files._Model(len(ids), distinct, np.zeros(4, dtype=np.uint8), np.zeros(distinct, dtype=bool))
    assert model.second.itemsize == model.w2.itemsize == model.zero_freq.itemsize == (4 if narrow else 8)


def test_classes_and_contexts_are_used():
    rng = np.random.default_rng(4)
    # Stretches in one of three vocabularies, where an odd id is followed by an even one.
    parts = []
    for k in range(120):
        x = rng.integers(0, 500, 2000) * 2 + 1000 * (k % 3)
        x[1::2] += 1
        parts.append(x)
    ids = np.concatenate(parts)
    plain = len(token_files.encode_ids(ids, 4096)) / len(ids)
    grouped = len(token_files.encode_ids(ids, 4096, np.arange(4096) % 2 == 1)) / len(ids)
    order0 = np.log2(1500 * 2) / 8
    # The class saves log2(3) bits, the group one more.
    assert plain < order0 - 0.05 and grouped < plain - 0.05
    assert (token_files.decode_ids(token_files.encode_ids(ids, 4096), len(ids), 4096) == ids).all()
    followed = np.tile(rng.integers(0, 4000, 40_000), 3)[:100_000]
    assert len(token_files.encode_ids(followed, 4096)) < 0.9 * len(followed) * 12 / 8


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_size_on_the_test_documents():
    rows = duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    e = encoder(WORDS)
    ids = np.concatenate([np.append(np.frombuffer(x, e.dtype), 1) for x in e.encode([t.encode() for (t,) in rows])]).astype(np.int64)
    coded = token_files.encode_ids(ids, e.size, e.ends | (np.arange(e.size) == 1))
    assert len(coded) < 0.86 * len(ids)
    assert (token_files.decode_ids(coded, len(ids), e.size) == ids).all()


def test_block_checksums():
    block = token_files.pack_block([3, None], [2, 1], np.array([4, 5, 1]), 100)
    docs, counts, ids = token_files.read_block(block)
    assert (docs, counts.tolist(), ids.tolist()) == ([3, None], [2, 1], [4, 5, 1])
    for at in (len(block) - 1, 20, 30):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.read_block(bytes(bad))


def test_token_files(spark, documents, tmp_path):
    rows = ODD
    path = str(tmp_path / "files")
    token_files.write_token_files(documents(rows), WORDS, path, block_ids=50)
    got = token_files.read_token_files(spark, path).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = next(ids for i, t in rows if i == r.doc_id and len(ids := ids_of(t)) == r.n_tokens)
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += r.n_tokens
    ordered = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered)
    token_files.write_token_files(documents([]), WORDS, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_piece_codec_parity():
    c = PieceCodec(PIECES)
    texts = [*TRICKY, "  two  spaces ", " lead", "<s> </s> <unk> <0x0A>", "a\nb\tc", "▁mark"]
    ids, agree = c.encode([t.encode() for t in texts])
    assert all(agree) and c.by_word
    for t, x in zip(texts, ids):
        own = np.frombuffer(x, "<u4").tolist()
        assert own == c.own.encode(t)
        assert c.decode([x])[0] == c.own.decode(own)


def test_model_file():
    m = parse_model(open(PIECES, "rb").read())
    assert len(m.pieces) == 32000 and m.byte_fallback and merges_of(m)
    with pytest.raises(ValueError):
        list(wire_fields(b"\x0b"))
    with pytest.raises(ValueError):
        parse_model(b"")


def test_piece_documents(spark, documents):
    docs = documents(ODD)
    report = codec_report(docs, PIECES).collect()
    assert len(report) == len(ODD) and all(r.parity and r.round_trip for r in report)
    encoded = encode_documents(docs.filter("doc_id is not null"), PIECES)
    back = {(r.doc_id, r.text) for r in decode_documents(encoded, PIECES).collect()}
    assert back == {(i, t or "") for i, t in ODD if i is not None}
    assert codec_report(documents([]), PIECES).count() == 0


def _field(number, value):
    """One field of a protobuf message, by its Python type."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback, spaces=False):
    """A small unigram model file, written by hand: plain letters, some words, and pieces that no text may match."""
    letters = "abcdefghijklmnopqrstuvwxyzé0123456789<>/x"
    words = ["▁the", "▁hello", "he", "llo", "an", "and", "▁", "▁a", "s>", "<0", "unk", "ing", "▁word", "or", "un"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("gone", -1.0, 5)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -2.0 - k / 7, 1) for k, w in enumerate(words)] + [(c, -6.0 - k / 9, 1) for k, c in enumerate(dict.fromkeys(letters))]
    body = b"".join(_field(1, _field(1, p) + _field(2, s) + (_field(3, k) if k != 1 else b"")) for p, s, k in pieces)
    body += _field(2, _field(3, 1) + _field(35, int(byte_fallback)) + _field(40, 0) + _field(41, 1) + _field(42, 2))
    return body + _field(3, _field(1, "identity") + _field(3, 1) + _field(4, int(spaces)) + _field(5, 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("spaces", [False, True])
def test_unigram_codec_parity(byte_fallback, spaces):
    c = PieceCodec(unigram_model(byte_fallback, spaces))
    texts = [
        *TRICKY[:5], "<s> hello </s>", "a<0x41>b", "<unk>x", "gone <0xE4>", "the hello and  the   word ", " lead", "é中文😀ÿ", "中", "﷐1﷑ a",
        "the hello and unhelloing wordor", "a" * 400, "▁mark▁", "tab\tand\nline",
    ]
    ids, agree = c.encode([t.encode() for t in texts])
    assert not c.by_word
    for t, x, same in zip(texts, ids, agree):
        own = np.frombuffer(x, "<u4").tolist()
        assert own == c.own.encode(t) and same, t
        assert c.decode([x])[0] == c.own.decode(own)


def test_decoding_of_control_and_unknown_ids():
    for c in (PieceCodec(unigram_model(False)), PieceCodec(PIECES)):
        ids = [1, *c.own.encode("hello and"), 0, *c.own.encode("the"), 2]
        assert c.decode([np.array(ids, "<u4").tobytes()])[0] == c.own.decode(ids)
        assert c.decode([b""]) == [""]


def test_a_mismatch_stays_one():
    c = PieceCodec(PIECES)
    c.memo.limit = 5
    encode = c.own.encode
    c.own = type("Other", (), {"encode": lambda self, some, num_threads=1: [[7] if t == "odd" else ids for t, ids in zip(some, encode(some))]})()
    for words in ([b"odd a"], [b"b c", b"odd"], [b"d e f g h", b"x y", b"odd z"], [b"odd"], [b"odd  spaces", b"plain"]):
        _, agree = c.encode(words)
        assert agree == [b"odd" not in w.split() or b"  " in w for w in words]
    # More words than the old bound of noted mismatches.
    c.memo.limit = 300_000
    c.encode([b"w%d" % k for k in range(100_010)])
    assert c.encode([b"odd", b"w1"])[1] == [False, True]


def test_word_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(common, "MEMO_BYTES", 1000)
    memo = common.Memo(lambda words: [w[:4] for w in words])
    for k in range(200):
        words = [b"%d-%d" % (k, i) * 3 for i in range(20)] + [b"x%d" % k * 400]
        memo.learn(words)
        assert [memo[w] for w in words] == [w[:4] for w in words]
        assert sum(map(len, memo)) < 1000 + 2000 and sum(len(w) > common.LONG_WORD for w in memo) == 1


def test_packing_covers_every_id_once(spark, documents):
    """Pieces of a document follow each other without gap or overlap, sequences are padded to a full length, clashing columns don't matter."""
    docs = documents([(i, t) for i, t in ODD if i is not None and i != 5]).withColumns({c: F.lit(9) for c in ("start", "length", "offset", "sequence_id", "doc_tokens", "tokens", "part")})
    rows = pack_documents(docs, WORDS, window=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in by.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert r.padded_length == 64 or r.padded_length & (r.padded_length - 1) == 0
    assert all(r.sequence_length == fill[r.sequence_id] <= r.padded_length for r in rows)
