"""Words of whole texts as numbers: hashed once a worker, and rolled over windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

from quire.llm.common import Memo, mix64

#: Texts of a batch are taken together up to so many bytes; a longer one is alone.
CHUNK_BYTES = 4 << 20

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def byte_table(changed: dict[bytes, bytes]) -> bytes:
    """A table for ``bytes.translate`` that lower-cases A-Z and maps each byte of a key to the key's value."""
    table = bytearray(range(256))
    table[_UPPER[0] : _UPPER[-1] + 1] = _LOWER
    for source, target in changed.items():
        for b in source:
            table[b] = target[0]
    return bytes(table)


#: All of ASCII but letters and digits parts words.
_ALNUM_TABLE = byte_table({bytes(b for b in range(128) if not chr(b).isalnum()): b" "})


def alnum_words(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text whose A-Z are lower-cased."""
    return text.translate(_ALNUM_TABLE).split()


@lru_cache(maxsize=1)
def _memo() -> Memo:
    return Memo(lambda words: [xxhash.xxh3_64_digest(w) for w in words])


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = _memo()
    memo.learn(words)
    return np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype="<u8")


def window_hashes(h: np.ndarray, k: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """The hash of every k consecutive words; ``seed`` tells windows of different kinds apart."""
    n = max(len(h) - k + 1, 0)
    total = np.full(n, k, dtype=np.uint64) + np.uint64(1) * np.asarray(seed, dtype=np.uint64)
    for i in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return total


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or one that is longer."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


_U = np.uint64
#: A value for each byte, and the base of the polynomial in a byte's place that makes a word's key.
_BYTE, _BASE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)), _U(0xD1342543DE82EF95)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Tokens whose keys are made at once.
_PART = 1 << 17
_powers = np.cumprod(np.concatenate([[_U(1)], np.full(1023, _BASE)]), dtype=_U)


def _power(place: np.ndarray) -> np.ndarray:
    global _powers
    need = int(place.max(initial=0)) + 1
    if need > len(_powers):
        # Only a very long word comes here, and its table isn't kept.
        return np.cumprod(np.concatenate([[_U(1)], np.full(need - 1, _BASE)]), dtype=_U)[place]
    return _powers[place]


@dataclass
class Words:
    """Words as parts of an array of bytes."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words) -> Words:
        words = list(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        return cls(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, some) -> Words:
        return Words(self.flat, self.starts[some], self.sizes[some])

    def keys(self) -> np.ndarray:
        """A 64-bit key of each word's bytes."""
        keys = np.zeros(len(self), dtype=_U)
        for low in range(0, len(self), _PART):
            starts, sizes = self.starts[low : low + _PART], self.sizes[low : low + _PART]
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            values = _BYTE[self.flat[np.repeat(starts, sizes) + place]] * _power(place)
            some = np.flatnonzero(sizes)
            keys[low + some] = np.add.reduceat(values, first[some]) if len(some) else 0
        return mix64(keys + self.sizes.astype(_U))


def tokens_of(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """All tokens of the texts, each text's end after it; and the texts' sizes in tokens. A-Z are lower-cased."""
    flat = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    inside = ~_SPACE[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends] = inside[ends] = True
    starts = np.flatnonzero(first)
    # An end stands where a line feed is, right behind a word or not.
    sizes = np.add.reduceat(inside, starts, dtype=np.int64)
    return Words(flat, starts, sizes), np.diff(np.searchsorted(starts, ends), prepend=-1)
