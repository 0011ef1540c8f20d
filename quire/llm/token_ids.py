"""Token ids of whole texts by the tokenizers library, with a cache of words.

A tokenizer whose normaliser and splitter never look across white space (``word_local``)
gives every white-space-separated word the same ids wherever it stands, so each worker
encodes a word once. A batch is split and numbered by Arrow: Python sees its distinct words
alone, and their ids are put in the words' places by Arrow. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.common import Memo

#: Words of these letters, marks at their end aside, need no normalisation but lower case.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?$%&*#@+=~^|<>()[]{}\"/\\-_"
_PLAIN = f"^(?P<core>[{_LATIN}]+)(?P<tail>[{re.escape(_MARKS)}]*)$"
_WORDS_PER_CALL = 400


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(spare)}


def word_local(spec: dict) -> bool:
    """Whether white space is dropped before the merges and no rule reaches across it."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
        and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps if s.get("type") == "Replace")
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[^\s" in split["pattern"].get("Regex", "")
        and spec.get("post_processor") is None
    )


class TextEncoder:
    """Encodes UTF-8 texts into little-endian ids, ``dtype`` wide; holds a bounded word cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.local = word_local(spec)
        self.memo = Memo(self._encode_words, limit=1_400_000)
        suffix = spec["model"].get("end_of_word_suffix")
        lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.plain = None
        # The ids that end a word, where the vocabulary marks them.
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        if self.local and suffix and lower and spec["model"]["type"] == "BPE":
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.alphabet = byte_alphabet() | {0x20: " "}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed."""
        ids, at = self.encode_column(pa.array(texts, pa.binary()))
        at = at.tolist()
        return [ids[a:z].tobytes() for a, z in zip(at, at[1:])]

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and where each text's begin (and the last's end).

        Null is empty; ``end`` follows each text, if given.
        """
        after = b"" if end is None else int(end).to_bytes(self.dtype.itemsize, "little")
        if not self.local:
            texts = [(t or b"").decode() for t in texts.cast(pa.binary()).to_pylist()]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            packed = [np.asarray(e.ids, dtype=self.dtype).tobytes() + after for e in found]
            at = list(accumulate(map(len, packed), initial=0))
            return np.frombuffer(b"".join(packed), dtype=self.dtype), np.array(at) // self.dtype.itemsize
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        numbered = split.flatten().dictionary_encode()
        ids = self.memo.values_of(_objects(numbered.dictionary))
        at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        of = numbered.indices.to_numpy()
        if after:
            of = np.insert(of, at[1:], len(ids))
            at += np.arange(len(at))
            ids.append(after)
        # Large: a text's ids may be more bytes than the text.
        placed = pa.array(ids, pa.large_binary()).take(pa.array(of))
        _, ends, data = placed.buffers()
        starts = np.frombuffer(ends, dtype=np.int64, count=len(of) + 1)
        data = np.frombuffer(data, dtype=self.dtype, count=starts[-1] // self.dtype.itemsize) if starts[-1] else np.empty(0, self.dtype)
        return data, starts[at] // self.dtype.itemsize

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words by the library's own pipeline."""
        return [
            np.asarray(e.ids, dtype=self.dtype).tobytes()
            for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        if not self.plain:
            return self._ids([w.decode() for w in words])
        column = pa.array(words, pa.binary()).cast(pa.string())
        parts = pc.extract_regex(column, _PLAIN)
        plain, parts = parts.is_valid(), parts.drop_null()
        cores = pc.utf8_lower(parts.field("core")).dictionary_encode()
        tails = parts.field("tail").dictionary_encode()
        names = _objects(cores.dictionary)
        held = list(map(self.memo.get, names))
        new = [k for k, ids in enumerate(held) if ids is None]
        for k, ids in zip(new, self._encode_plain([names[k] for k in new])):
            held[k] = ids
        before = pa.array(held, pa.binary()).take(cores.indices)
        after = pa.array(self._ids(tails.dictionary.to_pylist()), pa.binary()).take(tails.indices)
        out = np.empty(len(words), dtype=object)
        plain = plain.to_numpy(zero_copy_only=False)
        out[plain] = pc.binary_join_element_wise(before, after, b"").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain).tolist()
        for k, ids in zip(rest, self._ids([words[k].decode() for k in rest])):
            out[k] = ids
        return out.tolist()

    def _encode_plain(self, words: list[bytes]) -> list[bytes]:
        """Many words as few texts; the end-of-word tokens tell them apart."""
        if not words:
            return []
        joined = [b" ".join(words[k : k + _WORDS_PER_CALL]) for k in range(0, len(words), _WORDS_PER_CALL)]
        joined = [j.decode() if j.isascii() else j.decode("latin-1").translate(self.alphabet) for j in joined]
        found = self.plain.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, dtype=self.dtype) for e in found])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the vocabulary's word ends don't match the words")
        packed, at = ids.tobytes(), [0, *(cuts * self.dtype.itemsize).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:])]


def _objects(words: pa.Array) -> list[bytes]:
    """A column's words as UTF-8."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each file and Python worker."""
    return TextEncoder(path)
