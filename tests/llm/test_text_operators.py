"""Operators 2, 4, 5, 6, 7 and 8 against brute force, held-out accuracy or planted cases."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_data import ODD

from quire.llm import exact_dedup, language_id, lm_scoring, near_dedup, secrets, toxicity
from quire.llm.components import components
from quire.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from quire.llm.queries import SECRET_BASE_SQL, secret_model
from quire.llm.near_dedup import FIVE_WORDS, NearParams, drop_near_duplicates, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# Operator 2


@pytest.fixture(scope="module")
def model(spark):
    return secret_model(spark)


def test_models_tell_held_out_samples_apart(spark, model):
    held = secrets.labelled_samples(spark, 2000, seed=77)
    found = held.withColumn("hit", secrets.log_ratio(F.col("sample"), model.ratios) > model.threshold)
    rate = {r.random: r.rate for r in found.groupBy("random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert rate[True] > 0.95 and rate[False] < 0.01
    # Short ones too.
    short = found.filter("random and length(sample) < 20").agg(F.avg(F.col("hit").cast("int"))).first()[0]
    assert short > 0.9


def test_log_ratio_equals_a_plain_model(spark):
    """Counts, smoothing and ratios against a plain dictionary."""
    rows = [(w, r) for r, words in ((True, ["a1b2", "zz9x"]), (False, ["user", "use_r"])) for w in words]
    m = secrets.train(spark.createDataFrame(rows, "sample string, random boolean"), spark.createDataFrame([("usr1", False)], "sample string, random boolean"))
    size = len(secrets.ALPHABET) + 1

    def logp(text, random):
        pairs = [p for w, r in rows if r == random for p in zip(w, w[1:])]
        return sum(math.log((pairs.count(p) + 0.5) / (sum(q[0] == p[0] for q in pairs) + 0.5 * size)) for p in zip(text, text[1:]))

    texts = ["a1b2user", "use", "x", "", "é1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.log_ratio(F.col("t"), m.ratios).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(logp(r.t, True) - logp(r.t, False), abs=1e-3)
    assert m.threshold == pytest.approx(max(0, logp("usr1", True) - logp("usr1", False)), abs=1e-3)


def test_no_samples_find_nothing(spark):
    empty = spark.createDataFrame([], "sample string, random boolean")
    m = secrets.train(empty, empty)
    assert set(m.ratios) == {0.0} and m.threshold == math.inf


def test_short_random_strings_are_added(spark, documents, model):
    """Random strings that no pattern finds, of 12 characters and more, among ordinary words with digits."""
    rng = np.random.default_rng(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, where = [], {}
    for i in range(150):
        key = "".join(rng.choice(list(letters), 12 + i % 8)) + "7Qx"
        text = f"the update_customer_table_2 of server/config/report12 and chapter-12-section-3 in é {key} end"
        rows.append((i, text))
        where[i] = (text.index(key), text.index(key) + len(key))
    got = {r.doc_id: r.spans for r in secrets.secret_report(documents(rows), model).collect()}
    caught = sum("markov:%d:%d" % where[i] in got[i].split(",") for i in where)
    other = sum(len([s for s in got[i].split(",") if s and s != "markov:%d:%d" % where[i]]) for i in where)
    assert caught >= 0.95 * len(rows) and other <= 0.02 * len(rows)


def test_base_spans_equal_their_sql(spark, documents):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(SECRETS))]
    docs = documents(rows)
    want = duckdb.sql(SECRET_BASE_SQL.replace("FROM documents", "FROM '%s/*.parquet'" % docs.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))).fetchall()
    got = secrets.secret_report(docs, secret_model(spark)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want) and len(got) == len(rows)


SECRETS = [
    'password: "hunter2hunter2" and Token = abc', "token:token: abcdefgh", "API-KEY=zzzzzz api_key='abcdef' apikey:abcde", "x AKIA" + "A1B2" * 4 + " AKIAshort",
    "deadbeef" * 4 + " deadbeef", "é😀 secret==abcdef\nmore", "token=AKIA" + "Z" * 16, "id thQ7vX2kLp9ZtR4mBw8Yc1 and UserNameTable0042x", "secret\t: abcdefg",
]


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(out)]


def test_secrets(spark, documents, model):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(SECRETS))]
    got = {(r.doc_id, r.spans): r for r in secrets.secret_report(documents(rows), model).collect()}
    assert len(got) == len({(i, tuple(base_spans(t))) for i, t in rows})
    by = {i: t for i, t in rows}
    for (doc_id, spans), r in got.items():
        want = base_spans(by[doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in spans.split(",") if s and not s.startswith("markov")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in secrets.KINDS)
    assert sum(r.n_markov for r in got.values()) == 1
    assert secrets.secret_report(documents([]), model).count() == 0


def test_redaction(spark, documents, model):
    docs = documents([(i, t) for i, t in enumerate([*SECRETS, None, "clean"])])
    out = {r.doc_id: r for r in secrets.redact_secrets(docs, model).collect()}
    assert secrets.redact_secrets(docs, model).columns == docs.columns
    assert out[0].text == "[SECRET]\" and Token = abc" and out[0].n_chars == len(out[0].text)
    assert out[len(SECRETS)].text is None and out[len(SECRETS) + 1].text == "clean"
    clash = docs.withColumn("base", F.lit("b")).withColumn("added", F.lit(1))
    assert secrets.redact_secrets(clash, model).columns == clash.columns
    assert {r.base for r in secrets.redact_secrets(clash, model).collect()} == {"b"}


# Operator 5


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 8])
def test_binomial_rounds(spark, parts):
    rounds = exact_dedup.binomial_rounds(parts)
    assert 2**rounds >= parts > 2**rounds // 2
    docs = spark.createDataFrame([(i, f"t{i % 5}", i) for i in range(40)], "doc_id long, text string, row_id long").repartition(parts)
    merged = exact_dedup.tree_merge(exact_dedup.digest_table(docs, 2**rounds), rounds)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == rounds
    got = merged.collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(i, 8) for i in range(5)]
    # In the end every digest is at its own node.
    if rounds:
        assert all(r.node == r.home for r in got)


def test_dropping_from_a_joined_input(spark, documents):
    left = documents([(i, f"text {i % 30}") for i in range(90)], 5)
    right = spark.createDataFrame([(i, i % 7) for i in range(90)], "doc_id long, row_id long")
    for hint in ("broadcast", "merge", "shuffle_hash"):
        joined = left.join(right.hint(hint), "doc_id").repartition(6)
        out = drop_exact_duplicates(joined)
        assert out.columns == joined.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, f"text {i}") for i in range(30)]


def test_exact_duplicates(spark, documents):
    rows = [*ODD, *((i, "copy" if i % 3 else f"c o\tpy{' ' * (i % 5)}") for i in range(20, 90)), (91, "Copy")]
    got = exact_duplicates(documents(rows, 7)).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), math.inf if i is None else i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[1], len(v)) for k, v in groups.items()}
    for r in got:
        keep, n = want[r.text_sha256]
        assert (math.inf if r.keep_id is None else r.keep_id, r.group_size) == (keep, n)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and kept.keys() == want.keys()
    left = drop_exact_duplicates(documents(rows, 7))
    assert left.count() == len(want) and "extra" in left.columns
    assert exact_duplicates(documents([])).count() == 0


# Operator 8


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


def near_rows():
    rng = np.random.default_rng(5)
    rows, i = [], 20
    for size, change in ((40, 0.01), (60, 0.02), (200, 0.01), (12, 0.05), (400, 0.03)):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(12):
            mutated = [w if rng.random() > change else f"m{rng.integers(0, 9999)}" for w in base]
            rows.append((i, " ".join(mutated)))
            i += 1
    return rows


@pytest.mark.parametrize("p", [NearParams(block_docs=4), FIVE_WORDS])
def test_near_duplicates(spark, documents, p):
    rows = [*near_rows(), *((i, t) for i, t in ODD if i is not None and i != 5), (5, "one"), (200, "a b"), (201, "A  B"), (202, "a b c")]
    sets, label = brute_components(rows, p.words, p.percent)
    got = near_duplicates(documents(rows), p).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_near_duplicates_odd_rows(spark, documents):
    got = near_duplicates(documents(ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (4, 5, 6, 7)} == {(4, 4), (5, 4), (6, 6), (7, 6)}
    assert all(r.kept and r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert near_duplicates(documents([])).count() == 0
    left = drop_near_duplicates(documents(ODD))
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 6, 8, 9, 10, None}


def chain_rows(n, step=10, size=110):
    """Documents that share most shingles with the next in a chain, and are linked with none at 85 of 100."""
    return [(1000 + i, " ".join(f"c{k}" for k in range(i * step, i * step + size))) for i in range(n)]


def moved_sets(docs, p):
    """Copies of sets that the two verifications move, and the members of candidate buckets."""
    signed = near_dedup.signatures(docs, p)
    classes = signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    members = near_dedup.bucket_members(classes)
    none = docs.sparkSession.createDataFrame([], "v long, label long")
    stars, left = near_dedup.star_groups(members, p).count(), near_dedup.open_groups(members, none, p).count()
    return stars + left, members.select("rep").distinct().count()


def test_a_giant_component_of_unlinked_members(spark, documents):
    """A chain of buckets connects all documents, none are linked; what is moved grows with the documents, not with their square."""
    p = NearParams(block_docs=4)
    docs = documents(chain_rows(160))
    got = near_duplicates(docs, p).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 160
    few, n = moved_sets(documents(chain_rows(80)), p)
    many, m = moved_sets(docs, p)
    # All blocks of one component would take 160 * 40 copies; here each document is in few buckets.
    assert n > 70 and m > 150 and many < 2.5 * few and many < 160 * 25


def test_links_that_a_centre_would_lose(spark, documents):
    """Members of one bucket that are linked with each other and not with its smallest, the centre of the star."""
    base = [f"b{k}" for k in range(200)]
    changed = lambda at: [f"x{at}-{k}" if at <= k < at + 12 else w for k, w in enumerate(base)]
    other = changed(30)
    rows = [(1, " ".join(base[:186] + [f"y{k}" for k in range(14)])), (2, " ".join(other)), (3, " ".join(other[:199]))]
    rows += [(10 + k, " ".join(changed(40 + 5 * k))) for k in range(6)]
    sets, label = brute_components(rows, 3, 85)
    assert label[3] == 2 and label[2] != 1
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows), NearParams(block_docs=2)).collect()}
    assert got == label


def test_connected_members_give_no_edge():
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64)]
    assert near_dedup.linked([7, 7, 7, 9], sets, 85) == [(9, 7)]
    assert near_dedup.linked([7, 7, 9, 9], [sets[0], sets[2], sets[1], sets[3]], 85) == [(9, 7)]
    assert near_dedup.linked([1, 2, 3, 4], sets, 85) == [(2, 1), (4, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def test_band_hashes_agree_for_equal_sets_and_rarely_for_others():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    b = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    assert (near_dedup.band_hashes(a, 40, 7) == near_dedup.band_hashes(a.copy(), 40, 7)).all()
    assert not (near_dedup.band_hashes(a, 40, 7) == near_dedup.band_hashes(b, 40, 7)).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    hits = []
    for _ in range(40):
        pool = np.unique(rng.integers(0, 2**63, 230).astype(np.uint64))
        a, b = np.sort(pool[:215]), np.sort(pool[15:230])
        hits.append((near_dedup.band_hashes(a, 280, 1) == near_dedup.band_hashes(b, 280, 1)).mean())
    assert abs(np.mean(hits) - 200 / 230) < 0.02


def test_shingle_sets_hash_words_by_columns(monkeypatch):
    """No word is hashed by itself, and sets are those of the texts' own words, wherever parts of texts end."""
    texts = ["", " \n", "a", "A b", "a b c a B c a\tb", "b a", "x" * 3000 + " y z w", *(f"w{i % 5} w{i % 3} w{i % 7} w{i}" for i in range(40))]
    for size in (1, 60, 1 << 20):
        monkeypatch.setattr(near_dedup, "_TEXT_BYTES", size)
        with monkeypatch.context() as m:
            m.setattr(near_dedup.xxhash, "xxh3_64_digest", None)
            got = near_dedup.shingle_sets([t.encode() for t in texts], 3)
        for text, own in zip(texts, got):
            w = text.lower().split()
            want = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
            assert len(own) == len(want) and (np.sort(own) == own).all()
        assert set(near_dedup.shingle_sets([b"a b c"], 3)[0].tolist()) < set(got[4].tolist())


def test_empty_bins_borrow_along_their_own_order():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 2, 30, 5000)]
    at = np.arange(280 * 280, dtype=np.uint64)
    probe = (near_dedup.mix64(at + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).reshape(280, 280)
    for s, got in zip(sets, near_dedup.all_band_hashes(sets, 280, 1)):
        least = {}
        for x in s.tolist():
            least.setdefault(((x >> 32) * 280) >> 32, x)
        values = [least[b] if b in least else least[min(least, key=probe[b].tolist().__getitem__)] for b in range(280)]
        factor = near_dedup._tables(280, 1)[1][:, 0]
        assert (got == near_dedup.mix64(np.array(values, dtype=np.uint64) * factor + factor)).all()
    assert near_dedup.all_band_hashes([], 40, 7).shape == (0, 40)


# Operator 7


def toxic_rows(n=400):
    rng = np.random.default_rng(9)
    plain = [f"plain{x}" for x in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = [str(rng.choice(plain)) for _ in range(60)]
        if bad:
            for k in range(1 + i % 3):
                text[k * 7] = str(rng.choice(["vile", "nastyly", "nastyest"]))
        rows.append((i, " ".join(text)))
        labels.append((i, None if i % 7 == 0 else int(i % 2 == 0), int(bad)))
    return rows, labels


def test_toxicity(spark, documents):
    rows, labels = toxic_rows()
    held = {i for i, _ in rows if i % 4 == 1 or i % 20 == 0}
    given = [x for x in labels if x[0] not in held] + [(None, 1, 1), (5, 1, None), (3, 1, 9), (3, 1, 0)]
    lab = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    extra = [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in toxicity.toxicity_report(documents([*rows, *extra]), lab).collect()}
    truth = {i: bool(t) for i, _, t in labels}
    right = [got[i].toxic == truth[i] for i in held]
    assert sum(right) / len(right) > 0.97
    assert not any(got[i].toxic for i, _ in extra)
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    left = toxicity.drop_toxic(documents(rows), lab)
    assert left.columns == documents(rows).columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows if not got[i].toxic}


def test_toxicity_without_labels(spark, documents):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(documents(ODD), lab).collect()
    assert len(got) == len(ODD) and not any(r.toxic or r.expected_severity for r in got)


def test_toxicity_of_no_documents(spark, documents):
    lab = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    empty = documents([])
    assert toxicity.toxicity_report(empty, lab).count() == 0 and toxicity.drop_toxic(empty, lab).columns == empty.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_labelled_toxic_documents_are_caught(sf):
    """Some labelled documents of the tables hold nothing toxic any more (junk replaced their text), so not all can be."""
    docs, labels = f"/root/testdata/{sf}/documents.parquet", f"/root/testdata/{sf}/labels.parquet"
    if not os.path.exists(docs):
        pytest.skip("no test tables")
    rows = duckdb.sql(
        f"""SELECT coalesce(any_value(text), ''), max(CASE WHEN toxic = 0 THEN 0 WHEN quality = 0 THEN 2 ELSE 1 END)
        FROM '{docs}' JOIN '{labels}' USING (doc_id) WHERE toxic IN (0, 1) GROUP BY doc_id ORDER BY doc_id"""
    ).fetchall()
    sets, grades = toxicity.features([t.encode() for t, _ in rows]), np.array([g for _, g in rows])
    m = toxicity.fit_ordinal(sets, grades, toxicity.FitParams())
    w = dict(zip(m.keys.tolist(), m.weights.tolist()))
    p = 1 / (1 + np.exp(m.thresholds[0] - np.array([sum(w.get(k, 0.0) for k in s.tolist()) for s in sets])))
    toxic, hit = grades > 0, p > m.cut
    assert (hit & toxic).sum() >= 0.98 * toxic.sum() and (hit & ~toxic).sum() <= 0.005 * (~toxic).sum()


def test_cut_breaks_ties_upwards():
    assert toxicity.best_cut(np.array([0.1, 0.4, 0.4, 0.8]), np.array([0, 0, 1, 1]) > 0)[0] == pytest.approx(0.25)
    # Above 0.3 and above 0.9 are equally good; the higher cut is taken.
    cut, f1 = toxicity.best_cut(np.array([0.2, 0.4, 0.4, 0.4, 0.9, 0.95]), np.array([0, 1, 0, 0, 0, 1]) > 0)
    assert cut == pytest.approx(0.925) and f1 == pytest.approx(2 / 3)
    assert toxicity.best_cut(np.array([0.5, 0.5]), np.array([True, False])) == (0.5, 0.0)


def test_thresholds_share_weights():
    rows = [np.array([k], np.uint64) for k in (1, 2, 3)] * 60
    m = toxicity.fit_ordinal(rows, np.array([0, 1, 2] * 60), toxicity.FitParams(z=1.0, l2=0.02))
    assert list(m.thresholds) == sorted(m.thresholds) and len(m.thresholds) == 2
    w = dict(zip(m.keys.tolist(), m.weights.tolist()))
    assert w.get(1, 0) < w.get(2, 0) < w.get(3, 0)


# Operator 4

SAMPLES = {"en": "the and of to that with house water these which", "de": "der und die nicht mit haus wasser diese welche schön", "fr": "le et les pas avec maison eau cette quelle été"}


def language_rows(n=240):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        out.append((i, " ".join(rng.choice(SAMPLES[lang].split(), 12)), None if i % 17 == 0 else lang))
    return out


def test_language(spark, documents):
    rows = language_rows()
    odd = [(1000, None), (1001, ""), (1002, "123 ... ²"), (1003, "HOUSE"), (1004, "wasser " * 9000), (None, "maison")]
    got = language_id.language_report(documents([*rows, *((i, t, None) for i, t in odd)])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    held = [i for i, _, _ in rows if by[i].held_out]
    assert held and all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert all(by[i].lang_pred == list(SAMPLES)[i % 3] for i in held)
    assert [by[i].lang_pred for i in (1000, 1001, 1003, 1004, None)] == ["und", "und", "en", "de", "fr"]
    assert all(0 <= r.score <= 1 for r in got) and by[1000].score == 0
    assert language_id.language_report(documents([])).count() == 0


def test_kneser_ney_sums_to_one():
    m = language_id.fit({"banana": 3, "bandana": 2, "cab": 1})
    # The lowest order shares its probability among so many symbols: the end, the letters and others.
    symbols = ["\0", *(chr(c) for c in range(97, 123)), *(chr(0x4E00 + k) for k in range(language_id._SYMBOLS - 27))]
    for stem in ("ban", "b", "", "zq", "banan"):
        words = [stem + ("" if c == "\0" else c) for c in symbols]
        total = 0.0
        for w in words:
            flat, starts = language_id._codes([w])
            p = language_id.log_probabilities(m, language_id._gram_keys(flat, starts)[0], language_id._context_keys(flat, starts))
            total += math.exp(p[len(stem)])
        assert total == pytest.approx(1.0, abs=0.002)


def test_rejection(spark, documents):
    """Texts of no learned language are rejected, those of a learned one aren't; the prediction stays a learned value."""
    rows = language_rows(900)
    rng = np.random.default_rng(6)
    strange = [(5000 + k, " ".join("".join(rng.choice(list("бвгджзклмнпрст"), 7)) for _ in range(20)), None) for k in range(30)]
    noise = [(6000 + k, " ".join("".join(rng.choice(list("qxzjkvw"), 8)) for _ in range(20)), None) for k in range(30)]
    clash = documents([*rows, *strange, *noise, rows[0], rows[0]]).withColumns({c: F.lit(True) for c in ("held_out", "rejected", "h", "share", "few", "fits", "draw")})
    got = language_id.language_report(clash).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 62 and len({tuple(r) for r in got if r.doc_id == rows[0][0]}) == 1
    assert all(by[i].rejected and by[i].lang_pred in SAMPLES for i in [*range(5000, 5030), *range(6000, 6030)])
    assert sum(by[i].rejected for i, _, _ in rows) <= 0.02 * len(rows)


def test_a_language_of_one_document_is_learned(spark, documents):
    rows = language_rows(200)
    for i in range(7000, 7012):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        got = language_id.language_report(documents([*rows, (i, "жбан щука", "xx"), (8000, "щука жбан", None)])).collect()
        assert {r.lang_pred for r in got if r.doc_id == 8000} == {"xx"}
        break


def test_too_many_languages_are_refused(spark, documents, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.language_report(documents(language_rows(60)))


# Operator 6


def brute_lm(rows, held, cutoff):
    """The model from plain dictionaries: log10 probabilities of all rows' texts."""
    train = [words_of(t) for i, t in rows if i is not None and not held(i)]
    q = lambda c: 0 if not c else 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
    mid = lambda c: c if c <= 1 else 1.5 ** (q(c) - 0.5)
    low = lambda c: math.ceil(1.5 ** (q(c) - 1) - 1e-6) if c else 0
    high = lambda c: math.ceil(1.5 ** q(c) - 1e-6) - 1 if c else 0
    word = collections.Counter(w for t in train for w in [*t, "\n"])
    pair, triple, char = (collections.Counter() for _ in range(3))
    for t in train:
        s = ["<", *t, "\n"]
        pair.update(zip(s, s[1:]))
        triple.update(zip(s, s[1:], s[2:]))
        for w in t:
            b = b" " + w.encode() + b"\n"
            for k in range(1, 6):
                char.update(b[i : i + k] for i in range(len(b) - k + 1))
            char[""] += len(b) - 1
    pair, triple = ({k: c for k, c in x.items() if c >= cutoff} for x in (pair, triple))
    n, v, ends = sum(word.values()), len(word), len(train)
    stop = (ends + 1) / (n + 2)

    def spelling(w):
        b, out = b" " + w.encode() + b"\n", 1.0
        for i in range(1, len(b)):
            p = 1 / 256
            for k in range(5):
                if i >= k:
                    of = high(char[b[i - k : i]]) if k else high(char[""])
                    p = (min(low(char[b[i - k : i + 1]]), of) + 4 * p) / (of + 4)
            out *= p
        return out

    def unigram(w):
        return (mid(word[w]) + max(1, v) * (stop if w == "\n" else (1 - stop) * spelling(w))) / (sum(map(mid, word.values())) + max(1, v))

    def next_word(a, b, w):
        of2 = high(ends if b == "<" else word[b])
        of3 = high(pair.get((a, b), 0)) if a else 0
        w3 = 0.35 if of3 else 0
        w2 = 0.6 - w3 if of2 else 0
        r3, r2 = (min(1, low(x) / max(1, of)) for x, of in ((triple.get((a, b, w), 0), of3), (pair.get((b, w), 0), of2)))
        return w3 * r3 + w2 * r2 + (1 - w2 - w3) * unigram(w)

    scores = []
    for _, t in rows:
        s = [None, "<", *words_of(t), "\n"]
        scores.append(sum(math.log10(next_word(*s[k : k + 3])) for k in range(len(s) - 2)))
    return scores, next_word, word


@pytest.mark.parametrize(("cutoff", "broadcast", "words"), [(1, 1 << 30, 1 << 20), (2, 1 << 30, 4), (2, 0, 1 << 20), (1, 0, 0)])
def test_lm_scores(spark, documents, monkeypatch, cutoff, broadcast, words):
    """The same scores with the filter broadcast or in slices, and with exact counts of all, some or no words held."""
    monkeypatch.setattr(lm_scoring, "MAX_BITS", broadcast)
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", words)
    monkeypatch.setattr(lm_scoring, "BITS", 60)  # so that no probe is false
    monkeypatch.setattr(lm_scoring, "BYTES_AT_ONCE", 50)
    monkeypatch.setattr(lm_scoring, "TOKENS_AT_ONCE", 150)
    odd = [(i, t if t is None or len(t) < 1000 else t[:300]) for i, t in ODD]
    rows = [*odd, *((50 + i, f"alpha beta w{i % 9} Gamma") for i in range(60)), (200, "gamma beta alpha w3"), (201, "alpha beta w3 gamma")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = documents(rows).withColumns({c: F.lit(3) for c in ("block", "key", "c", "score", "held_out")})
    got = lm_scoring.score_documents(docs, cutoff=cutoff).collect()
    c = collections.Counter(w for i, t in rows if i is not None and not held(i) for w in [*words_of(t), "\n"])
    n, v = sum(c.values()), len(c)
    scores, _, _ = brute_lm(rows, held, cutoff)
    want = collections.Counter()
    for (i, t), s in zip(rows, scores):
        w = [*words_of(t), "\n"]
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        want[(i, None if i is None else held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 4), round(s, 4))] += 1
    own = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got)
    assert own == want
    by = {r.doc_id: r for r in got}
    # The order of words matters; usual texts score higher than odd ones.
    assert by[201].score > by[200].score + 1 and by[50].score / by[50].n_tokens > by[8].score / by[8].n_tokens
    assert {r.cutoff for r in got} == {cutoff} and all(0 < r.filter_fill < 0.3 for r in got)


def test_lm_scores_of_no_documents(spark, documents):
    assert lm_scoring.score_documents(documents([])).count() == 0
    assert all(math.isfinite(r.score) for r in lm_scoring.score_documents(documents([(None, "a b"), (None, None)])).collect())


def test_probabilities_sum_to_one():
    """Over all words that were counted, with a spelling that gives them all its mass; counts of at most 3 are held as they are."""
    rng = np.random.default_rng(3)
    # Every word occurs three times, and no count exceeds 3.
    texts = [[f"w{x}".encode() for x in rng.permutation(8)] for _ in range(2)]
    texts.append(texts[0][4:] + texts[0][:4])
    vocabulary = [*sorted({w for t in texts for w in t}), lm_scoring.END]
    known = {w: k for w, k in zip(vocabulary, lm_scoring._word_keys(vocabulary))}
    grams = collections.Counter()
    for t in texts:
        keys = np.array([known[w] for w in [*t, lm_scoring.END]], dtype=np.uint64)
        pairs = lm_scoring.bigram_keys(lm_scoring.preceding(keys, np.array([0])), keys)
        grams.update(keys.tolist() + pairs.tolist() + lm_scoring.trigram_keys(pairs[:-1], keys[1:]).tolist())
    assert max(grams.values()) == 3
    keys = np.array(sorted(grams), dtype=np.uint64)
    width = 1 << 16
    bits = np.frombuffer(lm_scoring.region(keys, np.array([grams[k] for k in keys.tolist()], dtype=float), 1, width, 7), np.uint8)
    m = lm_scoring.Model(lm_scoring.LogFrequencyFilter(bits, 1, width, 7), 1, 27.0, len(vocabulary), 27.0, 3.0)
    p1 = rng.dirichlet(np.ones(len(vocabulary)))
    totals = []
    for t in texts:
        for k in range(len(t)):
            context = [known[w] for w in t[:k]]
            total = 0.0
            for w, p in zip(vocabulary, p1):
                keys = np.array([*context, known[w]], dtype=np.uint64)
                high = lm_scoring.HIGHEST[m.filter.levels(keys)]
                total += lm_scoring.probabilities(keys, np.full(len(keys), p), high, np.array([0]), m)[-1]
            totals.append((total, all(grams[int(x)] < 3 for x in context[-1:])))
    assert max(t for t, _ in totals) < 1 + 1e-9
    # Where no count was cut to 3 above, the sum is 1.
    assert all(t == pytest.approx(1.0) for t, whole in totals if whole and t > 0) or min(t for t, _ in totals) > 0.6


def test_spellings_sum_to_one_at_most():
    words = {b"ab": 1, b"abc": 1, b"b": 1}
    keys, counts = lm_scoring.count_grams(words)
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(lm_scoring.region(keys, counts, 1, 1 << 15, 7), np.uint8), 1, 1 << 15, 7)
    # All words of up to two letters of an alphabet of all bytes but the end; the rest is longer words' mass.
    some = [b"", *(bytes([a]) for a in range(256) if a != 10), *(bytes([a, b]) for a in range(256) for b in range(256) if 10 not in (a, b))]
    total = (10.0 ** lm_scoring.spellings(some, f)).sum()
    longer = sum(10.0 ** lm_scoring.spellings([b"abc"], f))
    assert 0.3 < total + longer <= 1 + 1e-9


def test_tokens_are_words_and_ends():
    texts = ["", " ", "A b\u00a0C\n", "\x0b\x0cx", "\u2028y Z" * 3, "a" * 5000 + " " * 5000 + "\u00c4"]
    raw = [t.encode() for t in texts]
    words, sizes = lm_scoring.tokens_of(raw)
    want = [[*(w.lower() for w in t.split()), b"\n"] for t in raw]
    got = [bytes(words.flat[a : a + n]) for a, n in zip(words.starts.tolist(), words.sizes.tolist())]
    assert got == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    assert (words.keys() == lm_scoring._word_keys(got)).all()
    some = {bytes(x) for x in np.random.default_rng(2).integers(97, 100, (50000, 12)).astype(np.uint8)}
    some |= {w[:k] for w in list(some)[:5000] for k in range(1, 12)}
    assert len(np.unique(lm_scoring._word_keys(some))) == len(some)


def test_sorted_counts_are_packed_whole():
    rng = np.random.default_rng(5)
    for keys in (np.empty(0, np.uint64), np.array([0], np.uint64), np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))):
        assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(keys), len(keys)) == keys).all()
    for counts in (np.ones(10), np.array([255, 256, 70000.0])):
        assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(counts)) == counts).all()


def test_counts_merge_in_a_tree(spark, documents, monkeypatch):
    """With a small fan-out the counts go through several levels, and no array is cut into more parts than it."""
    monkeypatch.setattr(lm_scoring, "MAX_FAN", 2)
    assert lm_scoring.fan_out(7) == (2, 3) and lm_scoring.fan_out(1)[1] == 1
    docs = documents([(i, f"a b{i % 4} c{i % 3}") for i in range(80)], 7).select("text")
    fan, levels = 2, 3
    sums = lm_scoring.summed_slices(lm_scoring._counted(docs, fan), fan, levels, 1)
    assert sums.select("kind", "slice").distinct().count() == sums.count() and sums.agg(F.max("slice")).first()[0] < 8
    m, counts, _, _ = lm_scoring.train(docs, 1)
    want = collections.Counter(w for i in range(80) for w in ["a", f"b{i % 4}", f"c{i % 3}", "\n"])
    keys = {int(k.astype(np.int64)): w for w, k in zip(want, lm_scoring._word_keys([w.encode() for w in want]))}
    assert {keys[r.key]: r.c for r in counts.collect()} == dict(want)
    assert (m.tokens, m.distinct, m.ends) == (320, 9, 80)


def test_filter_keeps_its_bits_an_entry_at_every_size():
    """However many grams there are, the cutoff stays and the filter grows."""
    by_level = np.array([0, 1000, 500, 100, 10, 1] + [0] * 75)
    for times in (1, 10**6):
        grams = {k: by_level * times for k in range(3)}
        shape = lm_scoring.filter_shape(grams, 4, 2)
        entries = times * (2 * (1000 + 2 * 500 + 3 * 100 + 4 * 10 + 5) + 500 + 2 * 100 + 3 * 10 + 4)
        assert (shape.hashes, shape.least) == (7, 2) and 0 <= 4 * shape.width - lm_scoring.BITS * entries < 256


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    counts = np.floor(np.exp(rng.uniform(0, 9, len(keys))))
    q = lm_scoring.quantised(counts)
    width = -(-10 * int(q.sum()) // 64) * 64
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(lm_scoring.region(keys, counts, 1, width, 7), np.uint8), 1, width, 7)
    found = f.levels(keys)
    assert (found >= q).all() and (found == q).mean() > 0.98
    other = rng.integers(0, 2**63, 3000).astype(np.uint64)
    assert (f.levels(other) > 0).mean() < 0.03


def test_filter_reads_high_counts_level_by_level():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    counts = np.floor(np.exp(rng.uniform(0, 9, len(keys))))
    q = lm_scoring.quantised(counts)
    n = lm_scoring.HASHES
    width = -(-lm_scoring.BITS * int(q.sum()) // 64) * 64
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(lm_scoring.region(keys, counts, 1, width, n), np.uint8), 1, width, n)
    found = f.levels(keys)
    assert n == 7 and (found >= q).all() and (found == q).mean() > 0.98
    # A false positive adds a level or two, never a jump to the next power of two.
    assert (found - q).max() <= 2


def _some_filter():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    counts = np.floor(np.exp(rng.uniform(0, 9, len(keys))))
    width = -(-10 * int(lm_scoring.quantised(counts).sum()) // 64) * 64
    return keys, counts, lm_scoring.LogFrequencyFilter(np.frombuffer(lm_scoring.region(keys, counts, 1, width, 7), np.uint8), 1, width, 7)


def test_grams_that_were_read_are_not_probed_again(monkeypatch):
    """Neither word n-grams, nor grams whose own bits lead to one place of the cache; the levels stay those of the filter."""
    keys, counts, f = _some_filter()
    probed, levels = [], lm_scoring.LogFrequencyFilter.levels
    monkeypatch.setattr(lm_scoring.LogFrequencyFilter, "levels", lambda f, keys, *a, **k: probed.append(len(keys)) or levels(f, keys, *a, **k))
    m = lm_scoring.Model(f, 2, 1e5, 4000, 1e5, 10.0)
    words = np.tile(keys[:500], 2)
    one = lm_scoring.probabilities(words, np.full(1000, 1e-3), np.full(1000, 9.0), np.array([0]), m)
    del probed[:]
    assert (lm_scoring.probabilities(words, np.full(1000, 1e-3), np.full(1000, 9.0), np.array([0]), m) == one).all() and sum(probed) == 0
    recent = lm_scoring.RecentLevels(f)
    place = np.uint64(recent.SLOTS - 1)
    same = keys[np.argsort(keys & place)]
    pair = (same[0] & ~place) | (same[1] & place)
    odd = np.array([0, 1, recent.SLOTS, recent.SLOTS + 1, same[1], pair], dtype=np.uint64)
    for _ in range(2):
        assert (recent.levels(odd) == levels(f, odd)).all() and (recent.levels(keys, True) == levels(f, keys)).all()
    del probed[:]
    assert (recent.levels(np.array([same[1], pair])) == levels(f, np.array([same[1], pair]))).all() and sum(probed) <= 1


def test_known_levels_are_not_probed(monkeypatch):
    keys, counts, f = _some_filter()
    want, probed, probe = f.levels(keys), [], lm_scoring.LogFrequencyFilter.probe
    monkeypatch.setattr(lm_scoring.LogFrequencyFilter, "probe", lambda f, keys, levels: probed.append(len(keys)) or probe(f, keys, levels))
    assert (f.levels(keys, known=lm_scoring.quantised(counts)) == want).all()
    assert sum(probed) < 1.1 * len(keys)


def test_totals_of_sorted_runs_are_sums():
    rng = np.random.default_rng(7)
    for n in (0, 1, 3000):
        keys = rng.integers(0, 800, n).astype(np.uint64)
        for counts in (np.ones(n), rng.integers(1, 9, n).astype(np.float64), np.full(n, 70000.0)):
            got, want = lm_scoring.totals(zip(np.split(keys, [n // 3]), np.split(counts, [n // 3]))), lm_scoring._summed(keys, counts)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and got[1].dtype == np.float64


def test_words_values_keep_the_frequent(monkeypatch):
    """Of two words of one place the more frequent stays; values are the same whichever does."""
    keys, counts, f = _some_filter()
    words = [b"a%d" % i for i in range(300)]
    of = lm_scoring.Words.of(words)
    own = of.keys()
    order = np.argsort(own)
    m = lm_scoring.Model(f, 2, 1e5, 4000, 1e5, 10.0, own[order], np.arange(1, 301)[order])
    few, many = lm_scoring.WordValues(m, 64), lm_scoring.WordValues(m, 1 << 16)
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(few.of(of, own), many.of(of, own)))
    for i in range(300):
        few.of(of[i : i + 1], own[i : i + 1])
    best = {}
    for k, c in zip((own & np.uint64(63)).tolist(), range(1, 301)):
        best[k] = max(best.get(k, 0), c)
    assert {k: int(few.held[2][k]) for k in best} == best
