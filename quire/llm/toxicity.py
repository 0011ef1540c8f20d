"""Operator 7: severity of toxicity by cumulative-link ordinal regression.

Severity is an ordered grade. P(grade > k | x) = sigmoid(w . x - b_k): all grades share the
weights w of the sparse text features, and the thresholds b_0 <= b_1 <= ... part the line
between them. A document's expected severity is the sum of these probabilities.

Features are the distinct words of the whole text, lower-cased and stripped of punctuation,
and their beginnings of three to seven letters (stems under changing endings), hashed to 64 bits
and counted. Only features are kept whose frequency among the fit's documents differs between
grades by more than ``z`` standard deviations; the bound is low, so that few labels suffice, and the
penalty on the weights keeps what is there by chance small. The weights reach every worker by broadcast;
``max_features`` bounds them. The cut between toxic and other documents is chosen out of fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Memo, text_batches, utf8

_MARKS = b"\"'`.,;:!?()[]{}<>*#$%&@^~|/\\-_+="


@dataclass(frozen=True)
class FitParams:
    """``sample`` bounds the labelled documents that the fit reads, about that many; the bound is on the
    fit alone, and which documents it takes depends on the hash of their doc_id. ``z`` is the bound of
    chance, ``folds`` part the documents for the choice of the cut, ``l2`` is the penalty."""

    sample: int = 4_000
    z: float = 2.0
    folds: int = 4
    max_features: int = 20_000
    l2: float = 2.0
    steps: int = 200


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature hashes with their weights, the thresholds between grades, and the probability of
    any severity from which a document counts as toxic."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5


#: The lengths of a word's beginnings that are features.
_STEMS = (3, 4, 5, 6, 7)


def _of_word(word: bytes) -> list[bytes]:
    """The hashes of a lower-case word's features; none for punctuation alone."""
    word = word.strip(_MARKS)
    if not word:
        return []
    text = word.decode("utf-8", "replace")
    stems = [f"{text[:k]}*".encode() for k in _STEMS if len(text) > k]
    return [xxhash.xxh3_64_digest(x) for x in (word, *stems)]


@lru_cache(maxsize=1)
def _word_features() -> Memo:
    return Memo(lambda words: [b"".join(_of_word(w)) for w in words])


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The feature hashes of each text's distinct words, with repeats."""
    split = [set(t.lower().split()) for t in texts]
    memo = _word_features()
    memo.learn(w for s in split for w in s)
    get = memo.__getitem__
    return [np.frombuffer(b"".join(map(get, s)), dtype="<u8") for s in split]


def severity_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the labels: 0 not toxic, 1 toxic, 2 toxic in a document of low quality.

    Labels without a toxic flag, or with one other than 0 or 1, teach nothing. Of several labels
    of a document the most severe counts.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.filter("doc_id is not null and toxic in (0, 1)")
    return known.groupBy("doc_id").agg(F.max(grade).alias("grade"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Sample:
    """The labelled documents of a fit: their features as columns of a sparse table."""

    def __init__(self, rows: list[np.ndarray], grades: np.ndarray):
        self.n, sizes = len(rows), np.array([len(r) for r in rows])
        self.keys, column = np.unique(np.concatenate(rows), return_inverse=True)
        self.grades, self.levels = grades, np.unique(grades)
        self.toxic = grades > self.levels[0]
        # A document's column once, and how often its words have it.
        pair = np.repeat(np.arange(self.n), sizes) * len(self.keys) + column
        pair, self.times = np.unique(pair, return_counts=True)
        self.owner, self.column = np.divmod(pair, max(1, len(self.keys)))

    def surprise(self, use: np.ndarray) -> np.ndarray:
        """How far each feature's share of toxic documents, of those in ``use``, is from all documents' in standard deviations."""
        mine = use[self.owner]
        column, toxic = self.column[mine], self.toxic[self.owner[mine]]
        total, among = (np.bincount(column, weights=w, minlength=len(self.keys)) for w in (None, toxic.astype(float)))
        share = self.toxic[use].mean()
        return np.where(total >= 2, np.abs(among - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9)), 0)

    def fit(self, use: np.ndarray, p: FitParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, weights, thresholds) from the documents in ``use``, by gradient steps with momentum on the penalised likelihood."""
        surprise = self.surprise(use)
        keep = np.flatnonzero(surprise > p.z)
        if len(keep) > p.max_features:
            keep = np.sort(keep[np.argsort(-surprise[keep], kind="stable")[: p.max_features]])
        place = np.full(len(self.keys), -1)
        place[keep] = np.arange(len(keep))
        mine = use[self.owner] & (place[self.column] >= 0)
        row = np.cumsum(use) - 1
        owner, column, times = row[self.owner[mine]], place[self.column[mine]], self.times[mine].astype(float)
        grades, n = self.grades[use], int(use.sum())
        above = (grades[:, None] > self.levels[None, :-1]).astype(float)
        mean = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
        w, thresholds = np.zeros(len(keep)), np.log((1 - mean) / mean)
        moves = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, thresholds)]
        for t in range(1, p.steps + 1):
            margin = np.bincount(owner, weights=w[column] * times, minlength=n)
            error = _sigmoid(margin[:, None] - thresholds[None, :]) - above
            gw = np.bincount(column, weights=error.sum(axis=1)[owner] * times, minlength=len(w)) / n + p.l2 * w / n
            for x, g, (move, scale) in zip((w, thresholds), (gw, -error.mean(axis=0)), moves):
                move += 0.1 * (g - move)
                scale += 0.01 * (g * g - scale)
                x -= 0.3 / (1 + t / 100) * (move / (1 - 0.9**t)) / (np.sqrt(scale / (1 - 0.99**t)) + 1e-8)
            thresholds = np.maximum.accumulate(thresholds, out=thresholds)
        return keep, w, thresholds

    def p_toxic(self, some: np.ndarray, keep: np.ndarray, w: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """The probability of any severity of the documents in ``some``."""
        weights = np.zeros(len(self.keys))
        weights[keep] = w
        mine = some[self.owner]
        margin = np.bincount(self.owner[mine], weights=weights[self.column[mine]] * self.times[mine], minlength=self.n)
        return _sigmoid(margin[some] - thresholds[0])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, p: FitParams) -> OrdinalModel:
    """The model of all rows, with the cut that serves best out of fold.

    A model fitted without each fold is read on it; the cut parts toxic from other documents best,
    by F1, in these readings.
    """
    if len(rows) == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    s = _Sample(rows, grades)
    # Folds deal out the documents of each grade in turn.
    fold = np.empty(s.n, dtype=np.int64)
    fold[np.argsort(grades, kind="stable")] = np.arange(s.n) % p.folds
    read = np.full(s.n, 0.5)
    for f in range(p.folds):
        use = fold != f
        if not use.all() and len(np.unique(grades[use])) == len(s.levels):
            read[~use] = s.p_toxic(~use, *s.fit(use, p))
    keep, w, thresholds = s.fit(np.ones(s.n, dtype=bool), p)
    return OrdinalModel(s.keys[keep], w, thresholds, best_cut(read, s.toxic)[0])


def best_cut(p: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The middle of the gap between probabilities where F1 is highest, the highest such gap where some tie, and that F1."""
    values, inverse = np.unique(np.round(p, 6), return_inverse=True)
    if len(values) < 2:
        return 0.5, 0.0
    hits = np.bincount(inverse, weights=toxic, minlength=len(values))[::-1].cumsum()[::-1]
    taken = np.bincount(inverse, minlength=len(values))[::-1].cumsum()[::-1]
    f1 = 2 * hits / (taken + toxic.sum())
    best = len(values) - 1 - int(f1[1:][::-1].argmax())
    return float((values[best - 1] + values[best]) / 2), float(f1[best])


def train(docs: DataFrame, grades: DataFrame, p: FitParams = FitParams()) -> OrdinalModel:
    """Fit on about ``p.sample`` of the documents that have a grade.

    The share of labelled documents is set by their count, so the fit, in one task, holds the
    same amount at every size of the corpus. Without labels, or with one grade only, the model
    is empty and gives every document severity 0.
    """
    spark = docs.sparkSession
    text_batches(spark)
    count = grades.count()
    if not count:
        return fit_ordinal([], np.empty(0), p)
    share = min(1.0, p.sample / count)
    # 2**53 divides the range of the hash evenly and stays exact in a double.
    chosen = grades.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))

    def collect(batches):
        for b in batches:
            packed = [f.tobytes() for f in features(utf8(b["text"]))]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["grade"].cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "grade", "words"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    sets = rows.mapInArrow(collect, "doc_id long, grade int, words binary")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("words", "ascending")])
        sets = [np.frombuffer(x, dtype="<u8") for x in table["words"].to_pylist()]
        m = fit_ordinal(sets, table["grade"].to_numpy(), p)
        packed = {"keys": m.keys.tobytes(), "weights": m.weights.tobytes(), "thresholds": m.thresholds.tobytes(), "cut": m.cut}
        return pa.table({k: [v] for k, v in packed.items()})

    one = sets.groupBy().applyInArrow(fit, "keys binary, weights binary, thresholds binary, cut double").collect()
    if not one:
        return fit_ordinal([], np.empty(0), p)
    r = one[0]
    return OrdinalModel(*(np.frombuffer(bytes(x), dtype=t) for x, t in zip(r, ("<u8", "<f8", "<f8"))), r["cut"])


_GRADED = "expected_severity double, severity int, toxic boolean, p_toxic double"


def grade_documents(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with expected_severity, severity, toxic and p_toxic.

    ``toxic`` marks documents whose probability of any severity exceeds the model's cut, and
    ``severity`` is then the highest grade that is more likely reached than not, 1 at least. Null text has no features and is graded by the thresholds alone; rows are
    independent. The model, bounded by ``max_features``, is broadcast with the function.
    """
    text_batches(docs.sparkSession)
    keys, weights, thresholds = model.keys, model.weights, model.thresholds
    text_at = docs.columns.index(text)
    added = [c.split()[0] for c in _GRADED.split(", ")]
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns of the result: {sorted(clash)}")

    def grade(batches):
        table = {k.tobytes(): float(w) for k, w in zip(keys, weights)}
        memo = _word_weights(xxhash.xxh3_64_hexdigest(keys.tobytes() + weights.tobytes()))
        memo.fill = lambda words: [sum(table.get(f, 0.0) for f in _of_word(w)) for w in words]
        for b in batches:
            split = [set(t.lower().split()) for t in utf8(b.column(text_at))]
            memo.learn(w for s in split for w in s)
            get = memo.__getitem__
            margin = np.array([math.fsum(map(get, s)) for s in split])
            p = _sigmoid(margin[:, None] - thresholds[None, :])
            toxic = (p[:, :1] > model.cut).any(axis=1)
            severity = np.where(toxic, 1 + (p[:, 1:] > 0.5).sum(axis=1), 0).astype(np.int32)
            out = [
                pa.array(p.sum(axis=1)), pa.array(severity), pa.array(toxic),
                pa.array(p[:, 0] if len(thresholds) else np.zeros(len(split))),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *added])

    return docs.mapInArrow(grade, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_GRADED).fields]))


@lru_cache(maxsize=2)
def _word_weights(model: str) -> Memo:
    """The summed weights of words, for one model."""
    return Memo(lambda words: [0.0] * len(words))


def toxicity_report(docs: DataFrame, labels: DataFrame, p: FitParams = FitParams()) -> DataFrame:
    """A row for each document: doc_id, expected_severity, severity, toxic, p_toxic."""
    model = train(docs, severity_grades(labels), p)
    graded = grade_documents(docs.select("doc_id", "text"), model)
    return graded.drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, p: FitParams = FitParams()) -> DataFrame:
    """``docs`` without the documents graded toxic, with their own columns."""
    model = train(docs, severity_grades(labels), p)
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    kept = grade_documents(plain, model, f"_{docs.columns.index('text')}").filter(~F.col("toxic"))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
