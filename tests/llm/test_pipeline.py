"""The pipeline on planted cases, stage by stage, and the registered queries."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def corpus(n=200):
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 3000, 80)]
        if i % 8 == 0:
            text[5], text[9] = "vile", "nasty"
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append([i, " ".join(text), "en", "s", 0])
    clean = [r for r in rows if r[0] % 8][:3]
    base = clean[2][1].split()
    rows += [[500, clean[0][1] + "  ", "en", "s", 0], [501, clean[1][1], "en", "s", 0], [502, " ".join([*base[:40], "changed", *base[41:]]), "en", "s", 0]]
    rows += [[503, "see password: hunter22222 here", "en", "s", 0], [504, None, None, None, None], [505, "", "en", "s", 0]]
    return rows, labels, [r[0] for r in clean]


def test_pipeline(spark, tmp_path):
    rows, labels, (a, b, c) = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    toxic = {i for i, _, t in labels if t}
    every = {r[0] for r in rows}
    assert seen["toxicity"] == every - toxic
    # The copy with more characters stays; null and empty texts are equal.
    assert seen["exact_dedup"] == seen["toxicity"] - {a, 501, 505}
    assert seen["near_dedup"] == seen["exact_dedup"] - {502}
    assert seen["secrets"] == seen["near_dedup"] == seen["packing"]
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert text[503] == "see [SECRET] here"
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert {tuple(r) for r in direct.select("doc_id", "length", "ids_crc32").collect()} and direct.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit()))
def test_registered_queries_cover_their_tables(spark, name):
    out = entry.queries()[name](spark, DATA)
    if name.startswith("op9"):
        n = spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id % 100 = 0").count()
        assert out.select("query_id").distinct().count() == n
    elif name.startswith("op12"):  # a row for each phrase: phrases of every language that has some
        langs = {r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()}
        assert {r.lang for r in out.select("lang").distinct().collect()} == {x or "und" for x in langs}
    else:
        n = spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert out.select("doc_id").distinct().count() == n


CLASH = ["row_id", "kept", "sha", "severity", "toxic", "base", "added", "label", "rep", "block", "start", "doc_tokens", "sequence_id"]


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """Empty tables, rows that repeat, null keys, and columns with the names of results: every stage keeps the columns."""
    text = " ".join(f"w{k}" for k in range(60))
    some = [(1, text), (1, text), (None, text + " more"), (2, None), (3, ""), (None, None)][: 2 * rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    data = [(i, t, None, None, None, *range(len(CLASH))) for i, t in some]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        left.append(docs.count())
        assert name == "packing" or docs.columns == columns
    # Of equal texts one row stays, of null and empty ones too; the longer text without a doc_id is no other's copy.
    assert left == ([0] * 5 if not rows else [6, 3, 3, 3, 3])
