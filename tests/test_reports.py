from quire.operators import checklist, formulas, invariants
from quire.sql import register
from quire.sinks import writers
from quire.sources import ooxml


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT cn_number('壹億') AS x").first().x == 10**8
    rows = spark.sql("SELECT t.* FROM (SELECT X'6F6E650A74776F' AS c) s, LATERAL text_items('a.txt', s.c) t ORDER BY ordinal").collect()
    assert [r.text for r in rows] == ["one", "two"]
    assert spark.sql("SELECT * FROM text_items('a.bin', X'00')").first().error == "UNSUPPORTED_FORMAT"
    got = spark.sql("SELECT t.kind FROM (SELECT 'a\\nb' AS o, 'a\\nc\\nd' AS n) s, LATERAL line_changes(s.o, s.n) t").collect()
    assert [r.kind for r in got] == ["replaced"]
    assert spark.sql("SELECT * FROM archive_members('a.zip', X'00')").first().error == "PROFILE_UNKNOWN"


def test_structure_report(spark):
    docs = spark.createDataFrame([("a", None), ("b", None), ("c", "PACKAGE_INVALID")], "doc string, error string")
    marks = spark.createDataFrame([("a", "bookmark", "x"), ("a", "reference", "x"), ("b", "reference", "y")], "doc string, kind string, name string")
    text = [("a", 0, "Contents"), ("a", 1, "One....... 3"), ("b", 0, "fine")]
    paragraphs = spark.createDataFrame(text, "doc string, idx int, text string")
    got = {(r.doc, r.id): (r.passed, r.status) for r in invariants.structure_report(docs, marks, paragraphs).collect()}
    # What needs a reference, a policy or the units of pages is skipped without them.
    rest = [i for i in invariants.INVARIANTS if i not in ("cross_references", "toc_is_field")]
    assert {k: v for k, v in got.items() if k[1] in rest} == {(d, i): (None, "skipped") for d in "abc" for i in rest}
    assert {k: v for k, v in got.items() if k[1] not in rest} == {
        ("a", "valid_docx"): (True, "checked"), ("b", "valid_docx"): (True, "checked"), ("c", "valid_docx"): (False, "checked"),
        ("a", "cross_references"): (True, "checked"), ("b", "cross_references"): (False, "checked"), ("c", "cross_references"): (None, "skipped"),
        ("a", "toc_is_field"): (False, "checked"), ("b", "toc_is_field"): (True, "checked"), ("c", "toc_is_field"): (None, "skipped"),
    }


def test_docx_relations(spark):
    blocks = [{"kind": "heading", "level": 1, "text": "T"}, {"kind": "paragraphs", "paragraphs": ["p"]}, {"kind": "table", "rows": [["a"]]}]
    files = spark.createDataFrame([("x/a.docx", writers.to_docx(blocks)), ("x/b.docx", b"bad")], "path string, content binary")
    rows = ooxml.docx_paragraphs(files).orderBy("path", "idx").collect()
    assert [(r.kind, r.level, r.text, r.error) for r in rows] == [("paragraph", 1, "T", None), ("paragraph", 0, "p", None), ("table", 0, None, None), (None, None, None, "PACKAGE_INVALID")]
    assert ooxml.docx_structure(files).filter("kind = 'section'").count() == 1
    written = writers.write_blocks(
        spark.sql("SELECT 'a.csv' AS output_name, array(named_struct('kind', 'paragraphs', 'paragraphs', array('x', 'y'), 'text', CAST(NULL AS STRING))) AS blocks UNION ALL SELECT '../a.csv', NULL"), "csv"
    )
    assert {(r.output_name, r.code, r.content and bytes(r.content)) for r in written.collect()} == {("a.csv", "WRITTEN", b"x\ny\n"), ("../a.csv", "OUTPUT_NAME_INVALID", None)}


def test_pagination(spark):
    rows = [("d", 0, "Heading 1", "a", None), ("d", 1, "Heading 1", "b", True), ("d", 2, "Heading 1", "c", False)]
    p = spark.createDataFrame(rows, "doc string, idx int, style string, text string, page_break_before boolean")
    assert [(r.idx, r.expected) for r in invariants.pagination(p, ["Heading 1"]).collect()] == [(2, True)]


def test_checklist(spark):
    bodies = spark.createDataFrame([("d", "s1", "All about safety and use"), ("d", "s2", "TBD"), ("d", "s3", "long enough text")], "doc string, section string, body string")
    rows = [("s1", "A", ["safety"], ["dose", "use"]), ("s2", "B", ["x"], None), ("s3", "C", ["zzz"], None), ("s4", "D", None, None)]
    wanted = spark.createDataFrame(rows, "section string, title string, keywords array<string>, required_keywords array<string>")
    got = {(r.section, r.check, r.missing) for r in checklist.audit(bodies, wanted, ["tbd"]).collect()}
    assert got == {("s1", "required_keywords_missing", "dose"), ("s2", "section_placeholder", ""), ("s3", "keywords_absent", ""), ("s4", "section_missing", "")}
    config = spark.createDataFrame([("a", "H", "replace"), ("a", "H", "odd"), ("", "", "replace")], "id string, heading string, mode string")
    assert {(r.id, r.issue) for r in checklist.config_issues(config, ["replace"]).collect()} == {("a", "DUPLICATE_ID"), ("a", "UNKNOWN_MODE"), ("", "EMPTY_ID"), ("", "NO_HEADING")}


def test_formulas(spark):
    text = (
        "Composizione\nMaterie prime % Ingredienti CAS#\n-- 80,0 Alcohol denat. 64-17-5\nPresentazione degli ingredienti (INCI)\n"
        "Ingredienti % CAS# Funzioni\n1. Alcohol denat. 72,50 64-17-5 200-578-6 Solvent Annex III\n2. Parfum 25,0\n3. Aqua 3 7732-18-5 Solvent\nTotale 100\nX 1 50-00-0 y\n"
    )
    rows = formulas.formulas(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).collect()
    assert [(r.name, r.percent, r.cas, r.function) for r in rows] == [
        ("Alcohol denat.", 72.5, "64-17-5", "200-578-6 Solvent"), ("Parfum", 25.0, "-", "Perfuming"), ("Aqua", 3.0, "7732-18-5", "Solvent"),
    ]
