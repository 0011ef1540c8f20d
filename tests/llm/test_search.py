"""Operator 9 against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import topk_search
from quire.llm.queries import OP9_SQL
from quire.llm.topk_search import top_k_of_sample

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, k=10, every=100):
    usable = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = []
    for a, (q, terms) in enumerate(usable):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(terms, w)), c) for b, (c, w) in enumerate(usable) if a != b)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(n, width=16, same=0):
    rng = np.random.default_rng(6)
    return [(i, [0.5] * width if i < same else [float(x) for x in rng.normal(size=width)], 0, "x") for i in range(n)]


ODD = [(9000, None, 0, ""), (9100, [], 0, ""), (9200, [1.0, None], 0, ""), (9300, [float("nan")], 0, ""), (9400, [float("inf")], 0, ""), (None, [1.0], 0, "")]


def repeated():
    """Rows that repeat a vec_id: with other vectors, the same vector, and among the queries."""
    rows = [(i % 40 * 50, v, *rest) for i, v, *rest in vectors(200)]
    return [*rows, *rows[:30], (100, [1.0], 0, "short"), (100, [1.0], 0, "short"), (7, [3.0] * 20, 0, "long")]


CASES = [vectors(500), vectors(330, same=150), vectors(4), vectors(1), [*vectors(120), *ODD], repeated(), [(i, [1e5, -1e5] * 8, 0, "") for i in range(150)]]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("small", [False, True])
def test_search(spark, rows, small, monkeypatch):
    if small:
        for name, value in {"SHARD_ROWS": 64, "FIRST_ROWS": 16, "QUERY_ROWS": 2, "QUERIES_AT_ONCE": 2, "MERGE": 2, "PROBE_TERMS": 3, "SPARSE": 0.5}.items():
            monkeypatch.setattr(topk_search, name, value)
    # Columns of the result's and the operator's own names are ignored.
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("query_id", "rank", "score", "terms", "query", "own")})
    got = top_k_of_sample(df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows)


def test_search_equals_its_sql(spark):
    import duckdb

    embeddings = pa.table({"vec_id": [r[0] for r in repeated()[:230]], "embedding": [r[1] for r in repeated()[:230]]})
    want = duckdb.sql(OP9_SQL).fetchall()
    df = spark.createDataFrame([r[:2] for r in repeated()[:230]], "vec_id long, embedding array<double>")
    got = top_k_of_sample(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and embeddings.num_rows


def test_no_vectors(spark):
    assert top_k_of_sample(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("scales", [np.linspace(3, 0.01, 64), np.ones(64), np.repeat([5.0, 0.05], 32)])
def test_maxscore_keeps_the_best(scales):
    rng = np.random.default_rng(7)
    rows = np.floor(1024 * rng.normal(size=(3000, 64)) * scales)
    ids, queries = np.arange(3000), rows[:40]
    best, competitive = topk_search.Best(40, 10), []
    for a in range(0, 3000, 500):
        competitive.append(topk_search.search_shard(ids[a : a + 500], rows[a : a + 500], queries, np.arange(40), best))
    got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.ids.tolist()))
    want = [(q, *x) for q in range(40) for x in sorted((-int(s), i) for i, s in enumerate(rows @ queries[q]))[:10]]
    assert got == sorted(want)
    # The threshold goes from shard to shard: later ones have few competitive vectors left.
    assert competitive[0] == 40 * 500 and max(competitive[1:]) < 40 * 50


def test_terms_are_split_by_bounds():
    queries, low, high = np.array([[4.0, 1.0, 1.0]]), np.array([-1.0, -1.0, 0.0]), np.array([1.0, 1.0, 1.0])
    order, essential = topk_search.split_terms(queries, low, high, np.array([-1.5]))
    # The least score is -5; the two narrow terms add 3 at most, so only the widest is essential.
    assert order.tolist() == [0, 1, 2] and essential == 1
    assert topk_search.split_terms(queries, low, high, np.array([-np.inf]))[1] == 3
