"""Operator 12: collocations, phrases whose words occur together far more often than apart.

1. Each shard of texts (a bounded number of words of one task) becomes a generalised suffix automaton of
   bounded depth, which enumerates its distinct phrases with their endpos counts; those are summed
   globally. No shard sends a phrase twice.
2. Words and pairs come first; phrases of k words are enumerated only where both phrases of k - 1 words
   in them are frequent, since a phrase can't occur more often than its parts. A bit table of fixed size,
   broadcast, tells that; it may let others pass, which only costs rows: the exact global counts decide.
3. Each way to cut a phrase in two gives a score in exact decimals; the lowest counts.
4. A phrase is subsumed by a longer one that occurs nearly as often. Of the longer ones that hold it the most
   frequent is one word longer: the phrase is where its suffix link leads, or its first words without the last one.
5. Each language's best are ranked in two steps, so no task sorts all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, partitions_of, text_batches, utf8
from quire.llm.suffix_automaton import SuffixAutomaton
from quire.llm.words import byte_table, window_hashes, word_hashes


@dataclass(frozen=True)
class PhraseParams:
    #: Longest phrase in words, least occurrences, and the score's factor.
    words: int = 3
    least: int = 10
    scale: int = 1_000_000
    #: A longer phrase subsumes one from so many hundredths of its occurrences on.
    subsume_percent: int = 50
    #: Phrases returned of each language.
    top: int = 2000
    #: Words of a shard, and bits of the table of frequent phrases at most.
    shard_words: int = 1 << 19
    gate_bits: int = 1 << 28


_BORDER = b"\xff"  # no byte of UTF-8
_TABLE = byte_table({b".,;:!?\x0a\x0b\x0c\x0d": _BORDER, b"\x09": b" "})
_ROWS = "lang string, size int, phrase string, f long"
_PART = 1 << 20
_BATCH = 100_000


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """The text's words and borders, in lists of bounded length."""
    data = text.translate(_TABLE)
    at = 0
    while at < len(data):
        # Cut where a word ends.
        stop = len(data)
        if stop - at > _PART:
            found = [i for i in (data.find(b" ", at + _PART), data.find(_BORDER, at + _PART)) if i >= 0]
            stop = min(found, default=stop)
        yield data[at:stop].replace(_BORDER, b" \xff ").split()
        at = stop


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Words of texts of some languages, one after another with borders between them."""

    def __init__(self, depth: int):
        self.depth = depth
        self.context: list[bytes] = []
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers({_BORDER: 0})
        self.parts: list[np.ndarray] = []
        self.langs: list[tuple[int, int]] = []
        self.names: dict[str, int] = {}
        self.words = self.fresh = 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        if not self.parts and self.context:
            # What stands before the first words; it was counted before.
            self._append(lang, self.context)
            self.fresh = self.words
        self._append(lang, tokens)
        self.context = (self.context + tokens[-self.depth :])[-(self.depth - 1) :] if self.depth > 1 else []

    def end_text(self, lang: str) -> None:
        if self.parts:
            self._append(lang, [_BORDER])
        self.context = []

    def _append(self, lang: str, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        self.langs.append((self.names.setdefault(lang, len(self.names)), len(tokens)))
        self.words += len(tokens)

    def rows(self, sizes: list[int], gate: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, size, phrase, f) of the shard's phrases of the sizes asked for; with size 0, of all words together."""
        if not self.parts:
            return
        words = np.concatenate(self.parts) - 1
        vocabulary = list(self.numbers)[1:]
        langs = np.repeat(*(np.array(c, dtype=np.int64) for c in zip(*self.langs)))
        names = pa.array(list(self.names))
        ends = np.arange(self.fresh, len(words))
        if gate is not None:
            ends = self._gated(words, langs, vocabulary, names, ends, max(sizes) - 1, gate)
        if 1 in sizes:
            real = ends[words[ends] >= 0]
            total = np.bincount(langs[real], minlength=len(names))
            yield from self._batches(names, 0, pa.array([""] * len(names)), total)
        # Phrases of different languages differ: a word's number carries its language.
        keyed = np.where(words >= 0, words + langs * len(vocabulary), -1)
        automaton = SuffixAutomaton(keyed, max(len(vocabulary) * len(names), 1), ends, max(sizes))
        texts = pa.array(vocabulary, pa.binary())
        for size in sizes:
            end, count = automaton.substrings(size)
            for lo in range(0, len(end), _BATCH):
                at = end[lo : lo + _BATCH]
                columns = [texts.take(pa.array(words[at - i])) for i in range(size - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if size > 1 else columns[0]
                yield from self._batches(names.take(pa.array(langs[at])), size, phrase.cast(pa.string()), count[lo : lo + _BATCH])
        self._clear()

    @staticmethod
    def _batches(langs: pa.Array, size: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = pa.array(np.full(len(counts), size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([langs, sizes, phrases, pa.array(counts, pa.int64())], ["lang", "size", "phrase", "f"])

    @staticmethod
    def _gated(words, langs, vocabulary, names, ends, k, gate) -> np.ndarray:
        """The ends whose last k words, and the k words that end one before, may be frequent."""
        hashes = np.concatenate((word_hashes(vocabulary), np.zeros(1, np.uint64)))[words]
        seeds = word_hashes([n.encode() for n in names.to_pylist()])[langs]
        windows = window_hashes(hashes, k, seeds[k - 1 :]) & np.uint64(8 * len(gate) - 1)
        borders = np.concatenate(([0], np.cumsum(words < 0)))
        good = (gate[windows >> np.uint64(3)] >> (windows & np.uint64(7)).astype(np.uint8)) & 1
        good = good.astype(bool) & (borders[k:] == borders[: len(windows)])
        ends = ends[ends >= k]
        return ends[good[ends - k + 1] & good[ends - k]]


def phrase_counts(docs: DataFrame, sizes: list[int], p: PhraseParams, gate: np.ndarray | None = None) -> DataFrame:
    """Global counts (lang, size, phrase, f) of phrases of the given sizes; size 0 holds a language's words."""
    spark = docs.sparkSession
    held = None if gate is None else spark.sparkContext.broadcast(gate)

    def enumerate_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held is None else held.value
        shard = _Shard(max(sizes))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for tokens in _tokens(text):
                    shard.add(lang, tokens)
                    if shard.words >= p.shard_words:
                        yield from shard.rows(sizes, bits)
                shard.end_text(lang)
        yield from shard.rows(sizes, bits)

    text_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(enumerate_phrases, _ROWS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def frequent_gate(frequent: DataFrame, k: int, p: PhraseParams) -> np.ndarray:
    """A bit table of the frequent phrases of k words: 16 bits each, and ``gate_bits`` in all at most."""
    n = frequent.filter(F.col("size") == k).count()
    bits = min(max(1 << int(16 * n).bit_length(), 1 << 10), p.gate_bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = utf8(batch.column(0)), utf8(batch.column(1))
            hashes = word_hashes([w for t in phrases for w in t.split(b" ")]).reshape(-1, k)
            total = window_hashes(hashes.T, k, word_hashes(langs)) if len(hashes) else np.zeros((1, 0), np.uint64)
            at = (total.reshape(-1) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["at", "bit"])

    found = frequent.filter(F.col("size") == k).select("lang", "phrase").mapInArrow(slots, "at long, bit long")
    # At most gate_bits / 32 rows, whatever the corpus.
    table = found.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    gate = np.zeros(bits // 32, dtype="<u4")
    gate[table["at"].to_numpy()] = table["bit"].to_numpy()
    return gate.view(np.uint8)


def frequent_phrases(docs: DataFrame, p: PhraseParams) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of 1 to ``words`` words that occur ``least`` times; size 0 is each language's words."""
    keep = (F.col("f") >= p.least) | (F.col("size") == 0)
    out = materialize(phrase_counts(docs, [1, 2][: p.words], p).filter(keep), "phrases")
    last = out
    for k in range(3, p.words + 1):
        last = materialize(phrase_counts(docs, [k], p, frequent_gate(last, k - 1, p)).filter(keep), "phrases")
        out = out.unionAll(last)
    return out


def cut_scores(frequent: DataFrame, p: PhraseParams) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): each candidate at its lowest cut, ties to the first."""
    cand = frequent.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", first.alias("first"), rest.alias("rest"))
    known = frequent.filter("size > 0")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr(f"(cast({p.scale} as decimal(12,0)) * cast(a as decimal(13,0)) * cast(a as decimal(13,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "size", "a").agg(best.alias("b"))
    return scored.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def subsumed(frequent: DataFrame, p: PhraseParams) -> DataFrame:
    """(lang, phrase) of candidates that a phrase one word longer holds nearly as often."""
    cand = frequent.filter("size > 1")
    words = F.split("phrase", " ")
    link = F.array_join(F.slice(words, F.lit(2), F.col("size")), " ")
    prefix = F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " ")
    inner = cand.filter("size > 2").select("lang", F.explode(F.array(link, prefix)).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("f").alias("longer"))
    own = cand.select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("longer"))
    both = own.unionAll(inner).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    return both.filter(F.col("longer") * 100 >= F.col("a") * p.subsume_percent).select("lang", "phrase")


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, occurrences and bytes.

    A-Z are lower-cased, pieces end at [.,;:!?\\n-\\r], words are [^\\x20\\x09]+, and no phrase crosses pieces or
    texts. Null and empty texts have no words; a null lang is ``und``. Repeated rows count each time. An empty
    table, and a language without a phrase that occurs ``least`` times, give no rows. Texts of any length are
    taken in parts of 4 MB; doc_id and further columns aren't read.
    """
    if p.words < 2:
        raise ValueError("phrases have at least two words")
    frequent = frequent_phrases(docs, p)
    scored = cut_scores(frequent, p).join(subsumed(frequent, p), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(partitions_of(docs)))
    near = scored.withColumn("deal", deal).withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order)))
    near = near.filter(F.col("rank") <= p.top)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= p.top)
    n = frequent.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
