"""Steps whose cost must not grow faster than their input."""

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import audits, profiles, templates
from quire.plans import files
from quire.sources import blocks, pixels
from quire.sources.base import pieces


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_template_profile_looks_ahead_in_one_pass(spark):
    units = spark.range(1, 9).selectExpr(
        "1 AS doc", "id AS idx", "CASE WHEN id IN (4, 7) THEN 'table' ELSE 'paragraph' END AS kind", "CASE WHEN id % 3 = 0 THEN 'Heading 1' END AS style",
        "CASE WHEN id IN (4, 7) THEN NULL ELSE concat('part ', id) END AS text", "id AS n_rows", "2L AS n_cols",
    )
    sections = spark.createDataFrame([(1, "a", "part 3", ""), (2, "b", "part 5", ""), (3, "c", "part 8", "")], "ord int, section string, heading string, mode string")
    found = templates.template_profile(units, sections, ["Heading 1"])
    # A frame that ends with the partition is added up again for every row.
    assert "unboundedfollowing" not in plan_of(found).lower()
    rows = found.orderBy("ord").select("para_start", "para_end", "has_table", "table_rows").collect()
    assert [tuple(r) for r in rows] == [(3, 6, True, 4), (5, 6, False, None), (8, None, False, None)]


def test_evidence_is_never_broadcast(spark, tmp_path):
    # Files that a plan takes for small, whose rows aren't.
    spark.range(2000).selectExpr("id AS o_orderkey", "timestamp'2024-01-02' AS o_orderdate", "id * 1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    found = files.evidence_bundle(spark, str(tmp_path))
    assert found.filter("status = 'pass'").count() == 2800
    assert "BroadcastExchange" not in plan_of(found)


def test_number_report_finds_totals_of_large_keys(spark, tmp_path):
    rows = spark.range(5_000_000, 5_002_000).selectExpr("id AS c_custkey", "concat('Customer', id) AS c_name", "id % 4 AS c_nationkey")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    found = files.number_report(spark, str(tmp_path)).orderBy("doc").collect()
    line = "[high] table 1 column 2: table_total_mismatch"
    assert [tuple(r) for r in found] == [(0, line), (3, line)]


def test_batches_are_taken_up_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 300_000] * 10)], ["text"])
    found = list(pieces([batch, batch.slice(0, 0)], 1 << 20))
    assert sum(b.num_rows for b in found) == 10 and max(b.num_rows for b in found) == 3
    assert [b.num_rows for b in pieces([batch], 1000)] == [1] * 10


def test_content_blocks_make_files_once(spark, tmp_path):
    def make(batches):
        for b in batches:
            for name in b["path"].to_pylist():
                with open(f"{tmp_path}/{name}.{uuid.uuid4().hex}", "w"):
                    pass
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([b"a,b\n"] * b.num_rows, pa.binary())], ["path", "content"])

    made = spark.createDataFrame([("one.csv",), ("two.csv",), ("odd.txt",)], "path string").mapInArrow(make, "path string, content binary")
    found = blocks.content_blocks(made)
    assert sorted(r["path"] for r in found.collect()) == ["one.csv", "two.csv"]
    assert len(list(tmp_path.iterdir())) == 3


def test_counts_are_dealt_by_bytes(spark, monkeypatch):
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    monkeypatch.setattr(lm_scoring, "NODE_BYTES", 1000)
    texts = spark.createDataFrame([("a word " * 1000,)] * 4, "text string").coalesce(2)
    nodes, stride = lm_scoring.nodes_of(texts)
    assert (nodes, stride) == (28, 14)
    fan, levels = lm_scoring.fan_out(nodes)
    sums = lm_scoring.summed_slices(lm_scoring._counted(texts, fan, nodes, stride), fan, levels, 1)
    # Words: "a", "word" and the ends.
    assert sorted(n for r in sums.filter("kind = 0").collect() for n in lm_scoring.unpack_counts(r["counts"]).tolist()) == [4, 4000, 4000]


def test_few_rows_are_unfiltered_without_diagonals(monkeypatch):
    filters = np.array([4, 3, 1, 0, 2, 4], np.uint8)
    rows = np.random.default_rng(1).integers(0, 256, (6, 40, 3), dtype=np.uint8)
    above = rows[0] // 2
    monkeypatch.setattr(pixels, "_STEPS", 0)
    wanted = pixels.unfilter(filters, rows, above)
    monkeypatch.undo()
    monkeypatch.setattr(np, "select", None)  # what a diagonal ends with
    assert (pixels.unfilter(filters, rows, above) == wanted).all()


def test_nearest_numbers_need_no_shuffle(spark):
    rows = [(1, 1, "價 12 壹佰零伍 元 105 and 九十九 99"), (1, 2, "價 壹佰零伍 元 (106)")]
    found = audits.amounts_in_words(spark.createDataFrame(rows, "doc int, idx int, text string"))
    assert "Exchange" not in plan_of(found) and "Window" not in plan_of(found)
    assert sorted(tuple(r)[1:5] for r in found.collect()) == [(1, "壹佰零伍", 105, 12.0), (2, "壹佰零伍", 105, 106.0)]


def test_a_repeated_paragraph_is_looked_at_once(spark, monkeypatch):
    seen, real = [], audits.numeral_value
    monkeypatch.setattr(audits, "numeral_value", lambda text: seen.append(text) or real(text))
    found = audits._nearest_numbers.func(pa.array(["價 12 九十九 and 98 ٣", "九十九 98", None] * 1000)).to_pylist()
    assert found[:3] == [[{"words": "九十九", "words_value": 99, "number": "12"}], [], None] and len(found) == 3000
    assert seen == ["九十九"]
    rows = spark.createDataFrame([(1, 1, "價 1,200.5 九十九")], "doc int, idx int, text string")
    # Java's matcher goes through a class of many characters one by one.
    assert "RLIKE" not in plan_of(audits.amounts_in_words(rows).drop("snippet"))


def test_a_slice_is_summed_in_small_rows(spark, monkeypatch):
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    monkeypatch.setattr(lm_scoring, "ROW_KEYS", 100, raising=False)
    texts = spark.range(1000).selectExpr("concat('w', id % 500, ' x') AS text").coalesce(1)
    sums = lm_scoring.summed_slices(lm_scoring._counted(texts, 2), 2, 1, 1)
    rows = sums.filter("kind = 0").collect()
    assert max(r["n"] for r in rows) <= 100
    assert sorted(c for r in rows for c in lm_scoring.unpack_counts(r["counts"]).tolist()) == [2] * 500 + [1000] * 2
    model, counts, sums, shape = lm_scoring.train(texts, 1)
    keys = np.concatenate([lm_scoring.unpack_keys(r["keys"], r["n"]) for r in sums.filter("kind = 0").collect()])
    assert (model.filter.levels(keys) > 0).all() and counts.count() == 502


def test_workers_map_one_filter(spark):
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    texts = spark.range(200).selectExpr("concat('w', id % 50, ' x') AS text").coalesce(1)
    f = lm_scoring.train(texts, 1)[0].filter
    shared = spark.sparkContext.broadcast(f)
    # The bits are in a file, and not with each worker.
    assert len(pickle.dumps(f)) < 1000 < len(f.bits)

    def look(batches):
        for b in batches:
            mine = shared.value.bits
            yield pa.RecordBatch.from_pydict({"same": [not mine.flags.owndata and not mine.flags.writeable], "sum": [int(mine.sum())]})

    found = spark.range(1).coalesce(1).mapInArrow(look, "same boolean, sum long").collect()
    assert [tuple(r) for r in found] == [(True, int(f.bits.sum()))]


def test_leaves_leave_the_worker_as_rows(spark):
    found = profiles.shred_profiles(spark.createDataFrame([(1, '{"a": [], "b/c": [2, 0.5, "x"]}'), (2, "{")], "id int, json string"))
    plan = plan_of(found)
    assert "MapInArrow" in plan and "Generate" not in plan and "EvalPython" not in plan
    rows = [tuple(r) for r in found.orderBy("id", "path").collect()]
    assert rows[:4] == [(1, "/a", "list", "[]", None), (1, "/b~1c/0", "int", "2", None), (1, "/b~1c/1", "float", "0.5", None), (1, "/b~1c/2", "str", "x", None)]
    assert rows[4][:4] == (2, None, None, None) and rows[4][4]


def test_words_of_a_block_are_taken_apart_once(monkeypatch):
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    monkeypatch.setattr(lm_scoring, "BYTES_AT_ONCE", 10)
    seen, real = [], lm_scoring.gram_positions
    monkeypatch.setattr(lm_scoring, "gram_positions", lambda words: seen.append(len(words)) or real(words))
    upper, grams = lm_scoring.block_grams([b"one two three one"] * 50)
    assert sum(seen) == 4 and (np.diff(upper) > 0).all() and (np.diff(grams) > 0).all()


def test_a_worker_keeps_levels_of_blocks_before():
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    m = lm_scoring.Model(None, 2, 100.0, 10, 100.0, 5)
    m.digest = uuid.uuid4().hex
    texts = [b"one two three one"]
    words, _ = lm_scoring.tokens_of(texts)
    keys = np.concatenate(lm_scoring.block_grams(texts))
    own = lm_scoring.with_answers(m, keys, np.ones(len(keys), np.uint8), 0.5)
    first = lm_scoring._values_of(own).of(words, words.keys())
    # The next block's answers hold none of these words.
    own = lm_scoring.with_answers(m, keys[:0], np.empty(0, np.uint8), 0.25)
    again = lm_scoring._values_of(own).of(words, words.keys())
    assert own.fill == 0.25 and all((a == b).all() for a, b in zip(first, again))
    with pytest.raises(ValueError, match="stable scan"):
        own.filter.levels(keys[:1])
    # Another model begins anew.
    m.digest = uuid.uuid4().hex
    with pytest.raises(ValueError, match="stable scan"):
        lm_scoring._values_of(lm_scoring.with_answers(m, keys[:0], np.empty(0, np.uint8), 0.5)).of(words, words.keys())
    lm_scoring.forget()


def test_a_mapped_filter_follows_the_memory_of_executors(spark, monkeypatch):
    lm_scoring = pytest.importorskip("quire.llm.lm_scoring")
    texts = spark.range(200).selectExpr("concat('w', id % 50, ' x') AS text").coalesce(1)
    wanted = lm_scoring.train(texts, 1)[0].filter
    size = 8 * len(wanted.bits)
    monkeypatch.setattr(lm_scoring, "MAX_BITS", size // 2)
    monkeypatch.setattr(lm_scoring, "executor_gb", lambda _: 1.0, raising=False)
    assert lm_scoring.train(texts, 1)[0].filter is None
    monkeypatch.setattr(lm_scoring, "executor_gb", lambda _: 2.1, raising=False)
    assert (lm_scoring.train(texts, 1)[0].filter.bits == wanted.bits).all()
