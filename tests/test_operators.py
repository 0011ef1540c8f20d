from pyspark.sql import functions as F

from quire.operators import audits, binding, blocks, clauses, evidence, profiles, scoring, structure
from quire.sinks import artifacts
from quire.streaming import ledger, sessions


def cells(spark, grid):
    rows = [("d", 0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "doc string, table_ix int, row_ix int, col_ix int, value string")


def test_table_totals(spark):
    bad = cells(spark, [["項目", "金額"], ["A", "2000"], ["B", "2800"], ["合計", "5000"]])
    good = cells(spark, [["項目", "金額"], ["A", "2000"], ["B", "2800"], ["合計", "4800"]])
    assert [(r.col_ix, r.diff) for r in audits.table_totals(bad).collect()] == [(1, 200.0)]
    assert audits.table_totals(good).count() == 0


def test_amounts_and_dates(spark):
    rows = [("bad", 0, "總價：新台幣壹萬貳仟元整（21,000）"), ("good", 0, "總價：新台幣壹萬貳仟元整（12,000）"), ("dates", 0, "起始 2024/01/01，結束 2024-12-31。")]
    p = spark.createDataFrame(rows, "doc string, idx int, text string")
    assert [(r.doc, r.words_value, r.number_value) for r in audits.amounts_in_words(p).collect()] == [("bad", 12000, 21000.0)]
    found = audits.number_findings(cells(spark, [["a", "1"]]), p).collect()
    assert {(r.doc, r.check, r.severity) for r in found} == {("bad", "amount_words_mismatch", "high"), ("dates", "date_format_inconsistent", "medium")}


def test_clauses(spark):
    rows = [("a", "intro"), ("a", "第一條 甲"), ("a", "文"), ("a", "第二條 乙"), ("b", "第一條 甲"), ("b", "文"), ("b", "第二條 丙"), ("b", "第三條 丁")]
    p = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(rows)], "doc string, idx int, text string")
    docs = spark.createDataFrame([("a", 0), ("b", 1)], "doc string, doc_order int")
    found = clauses.clauses(p)
    got = {r.clause: r.status for r in clauses.align_clauses(found, docs).collect()}
    assert got == {"第一條": "same", "第二條": "differs", "第三條": "missing_in_some"}
    assert [r.clause for r in clauses.first_seen(found, docs).orderBy("rank").collect()] == ["第一條", "第二條", "第三條"]


def test_versions(spark):
    pairs = spark.createDataFrame([(1, "a\nb\n\nc", "a\nx\nc\nd"), (2, "a", "a"), (3, None, "z")], "pair_id long, old string, new string")
    got = {(r.pair_id, r.kind) for r in clauses.version_changes(pairs).collect()}
    assert got == {(1, "replaced"), (1, "added"), (3, "added")}


def test_profiles(spark):
    before = spark.createDataFrame([(1, '{"size":50,"t":"a  b","e":[],"rows":[{"k":1,"v":1},{"k":"1","v":2}]}')], "id long, json string")
    after = spark.createDataFrame([(1, '{"size":60,"t":"a b","n":1.0,"rows":[{"k":"1","v":2},{"k":1,"v":9}]}')], "id long, json string")
    shred = lambda d: profiles.shred_profiles(d, {"/rows": "k"})
    plain = lambda d: profiles.shred_profiles(d)
    got = {(r.path, r.kind) for r in profiles.leaf_diff(plain(before), plain(after), ["id"], "collapse_whitespace").collect()}
    assert {("/size", "changed"), ("/e", "removed"), ("/n", "added"), ("/rows/0/k", "type_changed")} <= got and ("/t", "changed") not in got
    twice = spark.createDataFrame([(1, '{"rows":[{"k":1},{"k":1}]}')], "id long, json string")
    assert shred(twice).first().error == "PROFILE_ARRAY_KEY"


def test_evidence(spark):
    e = spark.createDataFrame([("e1", "55", 0.5), ("e2", "50", 0.9), ("e3", None, 0.9)], "evidence_id string, value string, confidence double")
    c = spark.createDataFrame([(1, ["e1"]), (2, ["e1", "e2"]), (3, ["e3"]), (4, ["gone"])], "check_id int, evidence_ids array<string>")
    items = evidence.check_items(c, e)
    got = {r.check_id: r.status for r in evidence.with_confidence(evidence.presence(items), items, 0.8).collect()}
    assert got[1] == "review" and got[3] == "fail"
    assert {r.check_id: r.reason for r in evidence.equality(items).collect()}[2] == "VALUE_MISMATCH"
    assert [r.evidence_id for r in evidence.unknown_evidence(c, e).collect()] == ["gone"]
    want = spark.createDataFrame([(1, "55", True), (2, None, False), (3, None, True)], "check_id int, expected string, has_expected boolean")
    assert {r.check_id: r.status for r in evidence.equality(items, want).collect()} == {1: "pass", 2: "fail", 3: "pass"}


def test_scoring(spark):
    gold = spark.createDataFrame([("d", "a", "1.0", True), ("d", "b", None, False)], "doc string, field string, gold string, mandatory boolean")
    pred = spark.createDataFrame([("d", "a", " 1 "), ("d", "c", "x")], "doc string, field string, predicted string")
    scored, extra = scoring.score_fields(gold, pred), scoring.hallucinations(gold, pred)
    assert all(r.correct for r in scored.collect())
    row = scoring.acceptance(scored, extra, ["doc"]).first()
    assert (row.all_accuracy, row.hallucination_count, row.accepted) == (1.0, 1, False)


def test_span_binding(spark):
    pages = spark.createDataFrame([("s", 1, "Amount due: 1100.00", True)], "source_sha256 string, page int, text string, complete boolean")
    rows = [(1, "s", 1, 0, 11, "Amount due:", 12, 19, "1100.00"), (2, "s", 1, 0, 11, "Amount dux:", 12, 19, "1100.00"), (3, "s", 1, 0, 99, "x", 12, 19, "1"),
            (4, "s", 1, 0, 11, "Amount due:", 11, 19, "1100.00"), (5, "s", 1, 0, 11, "Amount due:", 12, 19, "1.00")]
    checks = spark.createDataFrame(rows, "check_id int, source_sha256 string, page int, quote_start int, quote_end int, quote string, value_start int, value_end int, value string")
    got = {r.check_id: r.reason for r in binding.bind_spans(pages, checks, 2).collect()}
    assert got == {1: "SOURCE_SPAN_VERIFIED", 2: "QUOTE_MISMATCH", 3: "RANGE_OUT_OF_BOUNDS", 4: "VALUE_CONVERSION_FAILED", 5: "VALUE_MISMATCH"}


def test_headings_and_labels(spark):
    p = spark.createDataFrame([("d", 0, "All about 1. Scope"), ("d", 1, "1. SCOPE"), ("d", 2, "x")], "doc string, idx int, text string")
    w = spark.createDataFrame([("s", "1 Scope"), ("t", "nowhere")], "section string, heading string")
    assert [(r.section, r.idx, r.exact) for r in structure.locate_headings(p, w).collect()] == [("s", 1, True)]
    rows = spark.createDataFrame([(1, "品 名"), (2, "產品品名"), (3, "zzz")], "row_id int, label string")
    keys = spark.createDataFrame([(0, "品名"), (1, "品")], "ord int, key string")
    assert {(r.row_id, r.key, r.how) for r in structure.match_labels(rows, keys).collect()} == {(1, "品名", "exact"), (2, "品名", "contained")}


def test_blocks(spark):
    content = [
        ("heading", 2, "T", None, None, None, None, None), ("paragraphs", None, None, None, ["a", " ", "b"], None, None, None),
        ("table", None, None, None, None, None, 1, [["x", "y"]]), ("key_values", None, None, None, None, [("k", "v")], None, None), ("odd", None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame([("d", i, c) for i, c in enumerate(content)], f"doc string, block int, content {blocks.BLOCK}")
    assert [r.text for r in blocks.flatten_blocks(d, ["doc"]).orderBy("ordinal").collect()] == ["T", "a", "b", "x y", "k: v"]
    assert [(r.block, r.code) for r in blocks.block_violations(d, ["doc"]).collect()] == [(4, "UNKNOWN_KIND")]
    assert [r.total_bytes for r in blocks.block_metrics(d, ["doc"]).orderBy("block").collect()] == [1, 4, 6, 8, 8]


def test_artifacts(spark):
    out = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "1", 2), ("b", "1", 3), ("c", "9", 4)], "output_name string, sha256 string, n int")
    store = spark.createDataFrame([("c", "8")], "output_name string, sha256 string")
    first, conflicts = artifacts.create_if_absent(out, store, "n")
    assert {(r.output_name, r.n) for r in first.collect()} == {("a", 0), ("b", 2)}
    assert {(r.output_name, r.n) for r in conflicts.collect()} == {("a", 1), ("c", 4)}


def test_ledger(spark):
    e = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c")], "key string, revision int, state string")
    chain = ledger.chained(e, ["key"], "revision", F.col("state"))
    assert ledger.broken_chain(chain, ["key"], "revision", F.col("state")).count() == 0
    forged = chain.withColumn("digest", F.when(F.col("revision") == 2, "x").otherwise(F.col("digest")))
    assert [r.revision for r in ledger.broken_chain(forged, ["key"], "revision", F.col("state")).collect()] == [2, 3]
    c = spark.createDataFrame([("k", 1, 4), ("k", 2, 7), ("k", 3, 1)], "key string, n int, cost int")
    assert [r.granted for r in ledger.reserve(c, ["key"], "n", "cost", 10).orderBy("n").collect()] == [True, False, False]


def test_reservation_stream(spark, tmp_path):
    rows = [("s", "1", 4), ("s", "1", 4), ("s", "2", 5), ("s", "3", 4), ("t", "1", 9)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "session string, request_id string, cost long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("session string, request_id string, cost long").parquet(source)
    q = sessions.reservations(stream, 10).writeStream.format("memory").queryName("decided").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.request_id, r.status) for r in spark.table("decided").collect()}
    assert got == {("s", "1", "granted"), ("s", "1", "replayed"), ("s", "2", "granted"), ("s", "3", "refused"), ("t", "1", "granted")}
