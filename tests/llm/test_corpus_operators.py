"""Operators 11 to 13 against brute force, on planted cases and odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_data import ODD

from quire.llm import collocations as coll
from quire.llm import importance as imp
from quire.llm.collocations import PhraseParams, collocations
from quire.llm.decontamination import OverlapParams, decontaminate, find_overlaps, overlap_report
from quire.llm.importance import DrawParams, drawn_documents, importance_sample
from quire.llm.suffix_automaton import SuffixAutomaton

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows, schema="item_id long, text string, extra int"):
    return spark.createDataFrame([(*r, 1) for r in rows], schema)


# Operator 11


def plain_overlaps(docs, items, n=10):
    """(doc_id, n_words, n_hit, items) by comparing every window with every window."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, named = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i : i + k]))
                if found is not None:
                    hit |= set(range(i, i + k))
                    named |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), sorted(named)))
    return out


BENCH = [
    (1, "The quick brown fox jumps over the lazy dog and runs away again"), (2, "short item"), (3, None), (4, "..."), (None, "an item without any id"),
    (21, "Lazy dog and runs away again the quick brown fox jumps over"), (3, "short item"), (5, "é ß 中文"),
]
LEAKS = [
    (100, "see: the QUICK brown fox, jumps over the lazy dog and stop"), (101, "the quick brown fox jumps over the lazy cat and runs away again"),
    (102, "Short--item, and short\nitem. an item without any id!"), (103, "x " * 5000 + BENCH[0][1] + " y" * 5000), (104, BENCH[0][1] + " " + BENCH[5][1]),
    (105, "shortitem"), (106, "short É ß 中文 item"), (107, "short é ß 中文 item"),
]


@pytest.mark.parametrize("block", [1_000_000, 2, 7])
def test_overlaps_equal_brute_force(spark, documents, block):
    rows = LEAKS + ODD
    p = OverlapParams(block_windows=block, chained=2)
    docs = documents(rows)
    want = plain_overlaps(rows, BENCH)
    assert any(x[2] == 10 for x in want) and any(x[3] == ["1", "21"] for x in want)
    expected = sorted((d is None, d or 0, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want)
    got = overlap_report(docs, table(spark, BENCH), p).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected


def test_overlap_hash_hits_are_verified(spark, documents, monkeypatch):
    """With a hash that tells nothing apart the words decide."""
    from quire.llm import decontamination as d

    index = d.BlockIndex.__new__(d.BlockIndex)
    open_block = d._Open()
    monkeypatch.setattr(d, "window_hashes", lambda h, k: np.full(max(len(h) - k + 1, 0), 7, np.uint64))
    for item, text in BENCH:
        w = [x.encode() for x in alnum(text)]
        if w:
            open_block.add(str(item), w, min(10, len(w)))
    row = open_block.close(0).to_pylist()[0]
    index.__init__(row)
    found = list(index.overlaps([t.encode() for _, t in LEAKS]))
    for (doc, n, hit, items), (words, spans, at) in zip(plain_overlaps(LEAKS, [(str(i), t) for i, t in BENCH]), found):
        assert (n, hit) == (words, sum(z - a for a, z in spans))
        assert items == sorted({index.ids[i] for i in at})


def test_decontaminate(spark, documents):
    docs = documents(LEAKS + [(1, None), (2, ""), (3, "clean text stays, as it is!")])
    bench = table(spark, BENCH)
    kept = {r.doc_id for r in decontaminate(docs, bench, remove="documents").collect()}
    assert kept == {101, 105, 1, 2, 3, 106}
    cut = decontaminate(docs, bench, mark="[x]")
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[100] == "see: [x] stop" and texts[102] == "[x], and [x]!" and texts[107] == "short [x] item"
    assert texts[101] == LEAKS[1][1] and texts[1] is None and texts[3] == "clean text stays, as it is!"
    assert not decontaminate(cut, bench).exceptAll(cut).count()
    with pytest.raises(ValueError):
        decontaminate(docs, bench, remove="all")
    with pytest.raises(ValueError):
        find_overlaps(docs.withColumn("overlap", F.lit(1)), bench)
    assert decontaminate(docs.withColumn("overlap", F.lit(1)), bench, remove="documents").count() == 6


def test_overlaps_of_empty_tables(spark, documents):
    docs, none = documents(LEAKS), table(spark, [])
    assert {(r.n_hit, r.contaminated) for r in overlap_report(docs, none).collect()} == {(0, False)}
    assert {r.n_words for r in overlap_report(docs, none).collect()} == {len(alnum(t)) for _, t in LEAKS}
    assert overlap_report(docs.limit(0), table(spark, BENCH)).count() == 0


# Operator 12


def test_automaton_equals_all_substrings():
    rng = np.random.default_rng(5)
    for _ in range(150):
        w = rng.integers(-1, 4, int(rng.integers(1, 60)))
        depth = int(rng.integers(1, 6))
        a = SuffixAutomaton(w, 4, np.arange(len(w)), depth)
        ends = collections.defaultdict(set)
        for k in range(1, depth + 1):
            for i in range(k - 1, len(w)):
                if (w[i - k + 1 : i + 1] >= 0).all():
                    ends[tuple(w[i - k + 1 : i + 1])].add(i)
            at, count = a.substrings(k)
            assert {tuple(w[i - k + 1 : i + 1]): n for i, n in zip(at, count)} == {s: len(e) for s, e in ends.items() if len(s) == k}
            if k > 1:
                for i, link in zip(a.end[k], a.link[k]):
                    j = a.end[k - 1][link]
                    assert tuple(w[i - k + 2 : i + 1]) == tuple(w[j - k + 2 : j + 1])
        # A state is a set of end positions along a chain of suffixes.
        classes = {(frozenset(e), s[-1]) for s, e in ends.items()}
        assert a.states == len(classes)


def plain_phrases(rows, p):
    f = collections.defaultdict(lambda: collections.Counter())
    n = collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, p.words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {s: a for s, a in c.items() if len(s) > 1 and a >= p.least}
        scored = []
        for s, a in cand.items():
            longer = [b for t, b in cand.items() if len(t) > len(s) and any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))]
            if any(100 * b >= p.subsume_percent * a for b in longer):
                continue
            score, _, left, right = min((p.scale * a * a // (c[s[:k]] * c[s[k:]]), k, c[s[:k]], c[s[k:]]) for k in range(1, len(s)))
            scored.append((-score, -a, " ".join(s).encode(), left, right))
        for rank, (score, a, s, left, right) in enumerate(sorted(scored)[: p.top], 1):
            out.append((lang, rank, s.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(3)
    vocab = ["der", "Die", "é", "wow\x1c", "a|b", "中", "k", "l"]
    rows = []
    for i in range(80):
        words = [vocab[x] for x in np.minimum(rng.geometric(0.35, 60) - 1, 7)]
        for j in rng.integers(0, 60, 8):
            words[j] += str(rng.choice([".", ",", "!\n", ";", "\t"]))
        rows.append((i, " ".join(words), [None, "de", "en"][i % 3]))
    rows += [(i, t, "xx") for i, t in ODD] + [(900 + i, "new york city hall", "en") for i in range(12)] + [(950, "rare words here", "fr")]
    return rows


@pytest.mark.parametrize("words, shard, gate", [(3, 1 << 21, 1 << 28), (3, 50, 1 << 10), (4, 7, 1 << 10), (2, 33, 1 << 10), (5, 1000, 1 << 12)])
def test_collocations_equal_brute_force(spark, documents, words, shard, gate):
    rows, p = phrase_rows(), PhraseParams(words=words, least=5, top=40, shard_words=shard, gate_bits=gate)
    got = sorted(tuple(r) for r in collocations(documents(rows), p).collect())
    want = plain_phrases(rows, p)
    assert got == want and len(want) > 40 and "fr" not in {r[0] for r in want}


def test_collocations_of_long_texts(spark, documents, monkeypatch):
    """A text's parts join: no phrase is lost or counted twice where it is cut."""
    text = ("alpha beta gamma\tdelta. " * 400).encode()
    monkeypatch.setattr(coll, "_PART", 50)
    assert [w for part in coll._tokens(text) for w in part] == text.translate(coll._TABLE).replace(b"\xff", b" \xff ").split()
    docs = documents([(1, text.decode() * 20, "en")])
    got = {r.phrase: r.a for r in collocations(docs, PhraseParams(shard_words=997)).collect()}
    assert got == {"alpha beta gamma": 8000, "beta gamma delta": 8000}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_017
    rows = [("x", 1, "a", big + 5), ("x", 1, "b", big + 7), ("x", 2, "a b", big), ("x", 0, "", 9 * big)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    got = coll.cut_scores(frequent, PhraseParams()).first()
    assert (got.l, got.r, got.score) == (big + 5, big + 7, 1_000_000 * big * big // ((big + 5) * (big + 7)))


def test_collocations_of_an_empty_table(spark, documents):
    assert collocations(documents([(1, "x", "en")]).limit(0)).count() == 0
    assert collocations(documents([(1, None, "en"), (2, "", None)])).count() == 0


# Operator 13


def plain_draw(rows, target, p):
    def features(text):
        w = alnum(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % p.buckets for k in range(1, p.runs + 1) for i in range(len(w) - k + 1)]

    docs = [(doc, *features(text)) for doc, text in rows]
    s = collections.Counter(b for _, _, f in docs for b in f)
    t = collections.Counter(b for _, text in target for b in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(p.scale * math.log((t[b] + 1.0) * (big_s + p.buckets) / ((s[b] + 1.0) * (big_t + p.buckets))))
    out = []
    for doc, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-p.scale * math.log(-math.log((h + 0.5) / 4294967296))), n >= p.least_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i for i, r in enumerate(fit[: len(fit) * p.percent // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in out]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def draw_rows(n=300):
    rng = np.random.default_rng(9)
    return [(i, " ".join(f"w{x}" for x in rng.geometric(0.02, int(rng.integers(1, 60))))) for i in range(n)]


TARGET = [(1, "w1 w2 W3 w1 w2"), (2, None), (3, "w50, w51; é")]


@pytest.mark.parametrize("p", [DrawParams(), DrawParams(buckets=50, runs=3, least_words=5, percent=40, seed=1), DrawParams(runs=1, least_words=0, percent=100)])
def test_draw_equals_brute_force(spark, documents, p):
    rows = draw_rows() + [(1000 + (i or 0), t) for i, t in ODD]
    got = importance_sample(documents(rows, parts=7), table(spark, TARGET), p).collect()
    want = plain_draw(rows, TARGET, p)
    if p.least_words:
        assert ordered(map(tuple, got)) == ordered(want)
    # Rows that repeat a doc_id tie, so which of them has which rank isn't told.
    assert ordered(r[:4] for r in map(tuple, got)) == ordered(r[:4] for r in want)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r[4] is not None for r in want) + 1))


def test_draw_takes_what_is_like_the_target(spark, documents):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'t' if i % 4 == 0 else 'c'}{x}" for x in rng.integers(0, 30, 40))) for i in range(400)]
    target = [(1, " ".join(f"t{x}" for x in range(30)) * 3)]
    drawn = {r.doc_id for r in drawn_documents(documents(rows), table(spark, target)).collect()}
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 45


def test_draw_of_odd_tables(spark, documents):
    docs = documents([(None, "a " * 30), (None, "a " * 30), (1, None), (1, "b " * 25)])
    got = importance_sample(docs, table(spark, []), DrawParams(percent=100)).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and [r.rank for r in got if r.n_features == 0] == [None]
    assert importance_sample(docs.limit(0), table(spark, TARGET)).count() == 0
    with pytest.raises(ValueError):
        importance_sample(docs, docs, DrawParams(buckets=0))


def test_rank_places_are_those_of_one_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 100).alias("v"), "id")
    got = imp.ranked(rows, [F.col("v").desc(), F.col("id").asc()], 9).collect()
    want = {r.id: i for i, r in enumerate(sorted(got, key=lambda r: (-r.v, r.id)), 1)}
    assert {r.id: r.place for r in got} == want


def test_draw_plan_is_native(spark, documents):
    plan = importance_sample(documents(draw_rows(20)), table(spark, TARGET))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
