"""Operator 4: language of whole texts by interpolated Kneser-Ney character models.

One model of order ORDER per language, over lower-cased runs of letters with boundary marks, is
fitted from a bounded sample of labelled documents. A model is sorted arrays of 64-bit hashes:
of each order's grams with their interpolated log-probabilities, and of each order's contexts
with their back-off weights. A gram that a model doesn't know goes down the orders.

A run of letters scores the same wherever it stands, so workers score each distinct word once
and a document is the sum over its words. The language with the lowest cross-entropy for each
character is chosen. Part of the sample is kept from the fit to calibrate it: a temperature
makes probabilities of the cross-entropies, and each language's threshold marks as rejected
what fits none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import alone, crc_mod, materialize, mix64, text_batches, utf8

ORDER = 5
UNKNOWN = "und"
#: Labelled documents and characters for each language that a fit reads, about so many at most.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 12_000_000
#: A language of fewer labelled documents is fitted from all of them and not calibrated.
FEW_DOCS = 50
#: The models are broadcast; more values of ``lang`` than this are refused.
MAX_LANGUAGES = 200
#: Symbols that the lowest order shares its probability among.
_SYMBOLS = 1000
_RUNS = re.compile(r"[^\W\d_]+")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after ORDER - 1 marks and before one; where each word begins."""
    pad = "\0" * (ORDER - 1)
    flat = np.frombuffer("".join(f"{pad}{w}\0" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + ORDER for w in words], dtype=np.int64)
    return flat, np.cumsum(sizes) - sizes


def _gram_keys(flat: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each predicted position the keys of its grams of order 1 to ORDER; and their words' numbers.

    Row k of the result has the grams of order k + 1; the contexts are the grams of order k that
    end one position before.
    """
    ends = np.append(starts[1:], len(flat))
    spans = ends - starts - (ORDER - 1)
    owner = np.repeat(np.arange(len(starts)), spans)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(starts + ORDER - 1, spans)
    keys, total = [], np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER):
        total = total * np.uint64(0x100000001B3) + flat[at - k] + np.uint64(1)
        keys.append(mix64(total + np.uint64((k + 1) << 56)))
    return keys, owner


def _context_keys(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each predicted position the keys of its contexts of 1 to ORDER - 1 characters."""
    ends = np.append(starts[1:], len(flat))
    spans = ends - starts - (ORDER - 1)
    at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(starts + ORDER - 1, spans)
    keys, total = [], np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER - 1):
        total = total * np.uint64(0x100000001B3) + flat[at - 1 - k] + np.uint64(1)
        keys.append(mix64(total + np.uint64((k + 1) << 56) + np.uint64(0x5BD1E995)))
    return keys


@dataclass
class KneserNey:
    """Sorted hashes: ``grams[k]`` with ``logp[k]`` of order k + 1, ``contexts[k]`` with ``back[k]``."""

    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and which of the wanted are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(words: dict[str, int]) -> KneserNey:
    """Fit from words and their counts."""
    m = KneserNey()
    if not words:
        return m
    flat, starts = _codes(list(words))
    keys, owner = _gram_keys(flat, starts)
    contexts = _context_keys(flat, starts)
    weight = np.fromiter(words.values(), dtype=np.float64, count=len(words))[owner]
    counts: list[np.ndarray] = [None] * ORDER
    first: list[np.ndarray] = [None] * ORDER
    for k in reversed(range(ORDER)):
        unique, place, inverse = np.unique(keys[k], return_index=True, return_inverse=True)
        m.grams.insert(0, unique)
        first[k] = place
        if k == ORDER - 1:
            counts[k] = np.bincount(inverse, weights=weight)
        else:  # how many different characters precede the gram
            longer = first[k + 1]
            counts[k] = np.bincount(np.searchsorted(unique, keys[k][longer]), minlength=len(unique)).astype(float)
    lower = np.full(len(m.grams[0]), 1 / _SYMBOLS)
    for k in range(ORDER):
        c, place = counts[k], first[k]
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        if k == 0:
            total, kinds = c.sum(), len(c)
            p = np.maximum(c - d, 0) / total + d * kinds / total * lower
            m.contexts.append(np.zeros(1, np.uint64))
            m.back.append(np.array([np.log(d * kinds / total)], dtype=np.float32))
        else:
            unique, inverse = np.unique(contexts[k - 1][place], return_inverse=True)
            total, kinds = np.bincount(inverse, weights=c), np.bincount(inverse)
            below = np.searchsorted(m.grams[k - 1], keys[k - 1][place])
            back = d * kinds / total
            p = np.maximum(c - d, 0) / total[inverse] + back[inverse] * np.exp(m.logp[k - 1][below].astype(float))
            m.contexts.append(unique)
            m.back.append(np.log(back).astype(np.float32))
        m.logp.append(np.log(p).astype(np.float32))
    return m


def log_probabilities(m: KneserNey, keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """The interpolated log-probability at each position, from the longest gram that is known."""
    n = len(keys[0])
    out, todo = np.zeros(n), np.arange(n)
    for k in reversed(range(ORDER)):
        if not m.grams or not len(todo):
            break
        at, there = _find(m.grams[k], keys[k][todo])
        out[todo[there]] += m.logp[k][at[there]]
        todo = todo[~there]
        if k:
            at, there = _find(m.contexts[k], contexts[k - 1][todo])
            out[todo[there]] += m.back[k][at[there]]
        else:
            out[todo] += m.back[0][0] - np.log(_SYMBOLS)
    return out


def _pack(m: KneserNey) -> dict[str, bytes]:
    arrays = {}
    for k in range(len(m.grams)):
        for name in ("grams", "logp", "contexts", "back"):
            arrays[f"{name}{k}"] = getattr(m, name)[k].tobytes()
    return arrays


def _unpack(arrays: dict[str, bytes]) -> KneserNey:
    m = KneserNey()
    for k in range(ORDER if arrays else 0):
        for name, kind in (("grams", np.uint64), ("logp", np.float32), ("contexts", np.uint64), ("back", np.float32)):
            getattr(m, name).append(np.frombuffer(bytes(arrays[f"{name}{k}"]), dtype=kind))
    return m


class Scorer:
    """All languages' models, with the scores of words seen so far; the words held are bounded."""

    LIMIT = 1_200_000

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, len(languages) + 1), dtype=np.float32)

    def _score(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: log-probabilities by language, and the number of predicted characters."""
        runs, of = [], []
        for i, w in enumerate(words):
            for r in _RUNS.findall(w.decode("utf-8", "replace").lower()):
                if r.isalpha() or any(map(str.isalpha, r)):
                    runs.append(r)
                    of.append(i)
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float64)
        if not runs:
            return out
        flat, starts = _codes(runs)
        keys, owner = _gram_keys(flat, starts)
        contexts = _context_keys(flat, starts)
        # A gram of the highest order fixes all lower ones, so each is scored once.
        top, first, inverse = np.unique(keys[-1], return_index=True, return_inverse=True)
        some_keys, some_contexts = [k[first] for k in keys], [c[first] for c in contexts]
        scores = np.column_stack([log_probabilities(m, some_keys, some_contexts) for m in self.models])
        target = np.array(of)[owner]
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(target, weights=scores[inverse, j], minlength=len(words))
        out[:, -1] = np.bincount(target, minlength=len(words))
        return out

    def _learn(self, words: set[bytes]) -> None:
        alone(self.place)
        new = [w for w in words if w not in self.place]
        if not new:
            return
        if len(self.place) + len(new) > self.LIMIT:
            self.place.clear()
            new = list(words)
        n = len(self.place)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = self._score(new)
        self.place.update(zip(new, range(n, n + len(new))))

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: the sums over its words."""
        split = [t.split() for t in texts]
        self._learn(set(chain.from_iterable(split)))
        get = self.place.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                out[i] = self.rows[at].sum(axis=0, dtype=np.float64)
        return out


@dataclass
class LanguageModels:
    """What is broadcast: bounded by the number of languages times the sample of each."""

    languages: list[str]
    packed: list[dict[str, bytes]]
    temperature: float = 1.0
    thresholds: list[float] = field(default_factory=list)

    @property
    def digest(self) -> str:
        h = xxhash.xxh3_64()
        for arrays in self.packed:
            for value in arrays.values():
                h.update(value)
        return h.hexdigest()


_scorers: dict[str, Scorer] = {}


def _scorer(models: LanguageModels, digest: str) -> Scorer:
    if digest not in _scorers:
        _scorers.clear()
        _scorers[digest] = Scorer(models.languages, [_unpack(a) for a in models.packed])
    return _scorers[digest]


def _entropies(rows: np.ndarray) -> np.ndarray:
    return -rows[:, :-1] / np.maximum(rows[:, -1:], 1)


def _posterior(entropies: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (entropies - entropies.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS) -> LanguageModels:
    """Fit a model for each non-null ``lang`` of the rows that ``learn_from`` selects.

    About ``sample_docs`` whole documents of each language, and about SAMPLE_CHARS characters, are read,
    chosen by the hash of their doc_id with a share that follows from the language's counts, four fifths of
    them for the fit and the rest for calibration; all serve the fit where a language has fewer than
    FEW_DOCS. A language needs a letter to be learned.
    """
    spark = docs.sparkSession
    text_batches(spark)
    usable = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chars = F.greatest(F.sum(F.octet_length("text")), F.lit(1))
    shares = materialize(
        usable.groupBy("lang").agg(
            F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count(F.lit(1)), F.lit(float(SAMPLE_CHARS)) / chars).alias("share"),
            (F.count(F.lit(1)) < FEW_DOCS).alias("few"),
        ),
        "shares",
    )
    if shares.count() > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values: set others to null before learning")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = materialize(
        usable.select("doc_id", "lang", "text", draw.alias("draw"))
        .join(F.broadcast(shares), "lang")
        .filter("draw < share")
        .select("lang", "text", (F.col("few") | (F.col("draw") < F.col("share") * 0.8)).alias("fits")),
        "languages",
    )

    def fit_one(table: pa.Table) -> pa.Table:
        words: dict[str, int] = {}
        for t in table["text"].to_pylist():
            for w in _RUNS.findall(t.lower()):
                words[w] = words.get(w, 0) + 1
        arrays = _pack(fit(dict(sorted(words.items()))))
        return pa.table({"lang": table["lang"][:1], "names": [list(arrays)], "arrays": [list(arrays.values())]})

    fitted = sample.filter("fits").groupBy("lang").applyInArrow(fit_one, "lang string, names array<string>, arrays array<binary>")
    rows = sorted((r for r in fitted.collect() if r["names"]), key=lambda r: r["lang"])
    models = LanguageModels([r["lang"] for r in rows], [dict(zip(r["names"], map(bytes, r["arrays"]))) for r in rows])
    if models.languages:
        _calibrate(models, sample.filter("not fits"))
    return models


def _calibrate(models: LanguageModels, held: DataFrame) -> None:
    """Set the temperature and the thresholds from documents that no model was fitted on."""
    digest, shared = models.digest, held.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        scorer = _scorer(shared.value, digest)
        for b in batches:
            h = _entropies(scorer.documents(utf8(b["text"])))
            yield pa.RecordBatch.from_arrays([b["lang"], pa.array(list(h), pa.list_(pa.float64()))], ["lang", "h"])

    rows = held.mapInArrow(measure, "lang string, h array<double>").collect()
    index = {x: i for i, x in enumerate(models.languages)}
    rows = [r for r in rows if r["lang"] in index]
    models.thresholds = [float("inf")] * len(models.languages)
    # A language without a letter in its sample has no model, and one that could spare nothing no threshold.
    if not rows:
        return
    h, y = np.array([r["h"] for r in rows]), np.array([index[r["lang"]] for r in rows])
    loss = lambda t: -np.log(np.maximum(_posterior(h, t)[np.arange(len(y)), y], 1e-9)).mean()
    models.temperature = float(min((2.0**e for e in range(-1, 9)), key=loss))
    for i in range(len(models.languages)):
        own = h[y == i, i]
        if len(own):
            models.thresholds[i] = float(np.quantile(own, 0.99) + 3 * own.std() + 0.05)


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """A row for each row of (doc_id, held_out, text): the language of the whole text.

    ``lang_pred`` is the language of lowest cross-entropy, ``und`` for null text or text without
    a letter (or without any model); ``score`` is its calibrated probability, 0 for ``und``;
    ``rejected`` marks a text whose cross-entropy exceeds what its language's own texts reach.
    """
    text_batches(docs.sparkSession)
    digest, shared = models.digest, docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches):
        m = shared.value
        scorer = _scorer(m, digest)
        limits = np.array(m.thresholds)
        for b in batches:
            n = b.num_rows
            names, score, best, rejected = [UNKNOWN] * n, np.zeros(n), [None] * n, np.zeros(n, dtype=bool)
            if m.languages and n:
                rows = scorer.documents(utf8(b["text"]))
                h = _entropies(rows)
                p, pick = _posterior(h, m.temperature), h.argmin(axis=1)
                for i in np.flatnonzero(rows[:, -1] > 0).tolist():
                    j = pick[i]
                    names[i], score[i], best[i], rejected[i] = m.languages[j], p[i, j], float(h[i, j]), h[i, j] > limits[j]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].cast(pa.int64()), b["held_out"], pa.array(names, pa.string()), pa.array(score),
                    pa.array(best, pa.float64()), pa.array(rejected),
                ],
                [c.split()[0] for c in _PREDICTED.split(", ")],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, _PREDICTED)


def language_report(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents outside one fold, by crc32 of the doc_id, and predict all.

    A null doc_id belongs to no fold: it isn't learned from, and ``held_out`` is null. Of languages that
    tie the first by name is predicted; repeated rows repeat their results, and a very long text is
    summed over its words like any other. An empty table gives no rows. Columns besides doc_id, text and
    lang are ignored, whatever their names.
    """
    fold = crc_mod(F.col("doc_id"), folds)
    models = train(docs, fold != held)
    return identify(docs.select("doc_id", (fold == held).alias("held_out"), "text"), models)
