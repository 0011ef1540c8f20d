"""Content blocks, ranges, configurations, tables and borders: planted cases beside the queries over files."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions.python import iso_instant, numeral_value
from quire.operators import conformance, contracts, profiles, reports, scoring
from quire.operators.evidence import date_order, type_violations, version_match
from quire.sinks import writers
from quire.sources import blocks, configs, ooxml, ranges, tables

FILES = "path string, content binary"


def docx(parts):
    return writers.to_docx(parts)


def test_docx_blocks_are_bounded_and_say_so(spark):
    many = [{"kind": "paragraphs", "paragraphs": [f"p{k}" for k in range(450)]}, {"kind": "heading", "level": 2, "text": "H"}, {"kind": "table", "rows": [[f"r{k}", "", ""] for k in range(501)]}]
    files = spark.createDataFrame([("a.docx", docx(many)), ("b.docx", docx([{"kind": "paragraphs", "paragraphs": [" "]}])), ("c.docx", b"x"), ("d.txt", b"x")], FILES)
    rows = blocks.content_blocks(files).orderBy("path", "block").collect()
    a = [r for r in rows if r.path == "a.docx"]
    assert [(r.block_id, r.content.kind) for r in a] == [("p1", "paragraphs"), ("p2", "paragraphs"), ("p3", "paragraphs"), ("h4", "heading"), ("t5", "table")]
    assert [len(r.content.paragraphs) for r in a[:3]] == [200, 200, 50] and a[3].content.level == 2
    assert len(a[4].content.rows) == 500 and a[4].content.rows[0] == ["r0"] and a[4].content.header_rows == 1 and all(r.truncated for r in a)
    assert [(r.path, r.block_id, r.content.text) for r in rows if r.path == "b.docx"] == [("b.docx", "h1", "Document")]
    assert {(r.path, r.error) for r in blocks.block_errors(files).collect()} == {("c.docx", "PACKAGE_INVALID"), ("d.txt", "FORMAT_NOT_SUPPORTED")}


def test_sheet_names(spark):
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["a/b", "a:b", "", None, "x" * 70, "x" * 64, "A-b"])], "n int, name string")
    plain = names.withColumn("doc", F.lit(1)).withColumn("name", blocks.sheet_name(F.col("name")))
    got = [r.name for r in blocks.distinct_names(plain, ["doc"], "n", "name").orderBy("n").collect()]
    assert got == ["a-b", "a-b-2", "Sheet", "Sheet-2", "x" * 64, "x" * 62 + "-2", "A-b"]


def test_csv_blocks(spark):
    files = spark.createDataFrame([("d/t.csv", b"a,b,,\n1,,\n"), ("e.csv", b""), ("f.csv", b"\xff")], FILES)
    rows = {r.path: r for r in blocks.content_blocks(files).collect()}
    assert rows["d/t.csv"].content.rows == [["a", "b"], ["1"]] and rows["d/t.csv"].content.name == "t" and rows["d/t.csv"].block_id == "s1"
    assert rows["e.csv"].content.rows == [[""]] and "f.csv" not in rows


def test_ranges_refuse_what_is_too_wide(spark):
    none = spark.createDataFrame([], "source_sha256 string, error string, page int, ocr_required boolean")
    with pytest.raises(ValueError):
        ranges.pdf_range(none, 1, 51)
    with pytest.raises(ValueError):
        ranges.pdf_range(none, 0, 5)
    pages = spark.createDataFrame([("s", None, k, k == 3) for k in range(1, 8)], "source_sha256 string, error string, page int, ocr_required boolean")
    units, found = ranges.pdf_range(pages, 2, 3)
    r = found.first()
    assert [u.page for u in units.orderBy("page").collect()] == [2, 3, 4]
    assert (r.start, r.end, r.returned, r.next_start, r.known_total, r.disposition, r.omitted) == (2, 5, 3, 5, 7, "partial_unknown", ["image_only_pages"])


def test_worksheets_follow_one_another(spark):
    book = writers.to_xlsx([{"kind": "sheet", "name": "A", "rows": [["1", "2"], ["3"]]}, {"kind": "sheet", "name": "B", "rows": [["x"]]}])
    cells = ooxml.workbook_cells(spark.createDataFrame([("a.xlsx", book)], FILES))
    rows, found = ranges.xlsx_range(cells, 0, 1, 500)
    r = found.first()
    assert (r.next_sheet, r.next_start, r.disposition, r.sheet_name, r.visible) == (1, 1, "partial_known", "A", "visible")
    assert [x["values"] for x in rows.orderBy("row").collect()] == [["1", "2"], ["3", None]]
    last = ranges.xlsx_range(cells, 1)[1].first()
    assert (last.next_start, last.disposition) == (None, "complete")
    with pytest.raises(ValueError, match="UNSUPPORTED_CONTRACT"):
        ranges.xlsx_range(cells, 0, 1, 5, "3")


def test_docx_range_knows_its_total_at_the_end_alone(spark):
    rows = spark.createDataFrame([("s", k) for k in range(1, 6)], "source_sha256 string, block int")
    first, last = ranges.docx_range(rows, None, 1, 3)[1].first(), ranges.docx_range(rows, None, 4, 3)[1].first()
    assert (first.next_start, first.known_total, first.disposition) == (4, None, "partial_unknown")
    assert (last.next_start, last.known_total, last.disposition) == (None, 5, "complete")
    stories = spark.createDataFrame([("s", None, "word/header1.xml")], "source_sha256 string, error string, part string")
    assert ranges.docx_range(rows, stories, 4, 3)[1].first().omitted == ["header"]


MAPPING = {
    "template_rules": {"heading_styles": ["Heading 1"], "pagination": {"mode": "break_before_styles"}},
    "sections": [{"id": "a", "heading": "One  Two"}, {"id": "a", "heading": "one two", "mode": "odd"}, {"id": "", "heading": "", "table_fill": "no"}],
    "front_matter": [{"field": "f"}, {"style": "s"}],
}


def test_mappings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MAPPING))
    (tmp_path / "bad.json").write_text("{")
    read = configs.read_mappings(spark, str(tmp_path))
    issues = {(r.path.rsplit("/", 1)[1], r.subject, r.issue) for r in configs.mapping_issues(read).collect()}
    assert issues == {
        ("bad.json", "", "CONFIG_INVALID"), ("m.json", "", "NO_BREAK_STYLES"), ("m.json", "a", "DUPLICATE_ID"), ("m.json", "a", "UNKNOWN_MODE"), ("m.json", "", "EMPTY_ID"),
        ("m.json", "", "NO_HEADING"), ("m.json", "", "UNKNOWN_TABLE_FILL"), ("m.json", "", "ANCHOR_WITHOUT_FIELD"), ("m.json", "f", "ANCHOR_WITHOUT_PLACE"),
    }
    specs = configs.section_specs(read).orderBy("ord").collect()
    assert [(s.id, s.mode) for s in specs] == [("a", "paragraphs"), ("a", "odd"), ("", "paragraphs")]
    assert configs.section(configs.sections(read), "a").first().heading == "One  Two"
    assert {r.heading: r.id for r in configs.headings_index(read).collect()}.keys() >= {"onetwo"} or configs.headings_index(read).count() == 2


def test_checklists_golden_and_pages(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"placeholders": ["tbd"], "sections": [{"section": "s", "title": "S", "keywords": ["k"]}]}))
    got = configs.read_checklists(spark, str(tmp_path / "c.json")).first()
    assert (got.placeholders, got.section, got.keywords, got.required_keywords, got.error) == (["tbd"], "s", ["k"], None, None)
    (tmp_path / "gold" / "dev").mkdir(parents=True)
    (tmp_path / "gold" / "dev" / "d1.json").write_text(json.dumps({"name": {"value": "x", "mandatory": True}, "n": 3, "t": "plain"}))
    gold = {(r.split, r.doc, r.field, r.gold, r.mandatory) for r in configs.read_golden(spark, str(tmp_path / "gold")).collect()}
    assert gold == {("dev", "d1", "name", "x", True), ("dev", "d1", "n", "3", False), ("dev", "d1", "t", "plain", False)}
    pages = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a")], "file string, page int, text string")
    configs.write_pages(configs.pages_document(pages), str(tmp_path / "pages"))
    assert [(r.page, r.text, r.char_count) for r in configs.read_pages(spark, str(tmp_path / "pages")).collect()] == [(1, "a", 1), (2, "b", 1)]
    (tmp_path / "other.json").write_text('{"schema": "x", "pages": []}')
    assert configs.read_pages(spark, str(tmp_path / "other.json")).first().error == "PAGES_SCHEMA_UNKNOWN"


def test_table_structures(spark):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tblGrid><w:gridCol w:w="2000"/><w:gridCol w:w="1000"/></w:tblGrid>'
    cell = lambda t, props="": f'<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>'
    rows = f'<w:tr><w:trPr><w:tblHeader/></w:trPr>{cell("Head", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr>'
    rows += f'<w:tr>{cell("A", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("1")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("2")}</w:tr>'
    raw = writers._package({"[Content_Types].xml": writers._types({}), "word/document.xml": word + rows + "</w:tbl></w:body></w:document>"})
    t = tables.table_structures(spark.createDataFrame([("a.docx", raw)], FILES), "docx").first()
    assert (t.error, t.table_id, t.row_count, t.column_count, t.header_rows, t.merge_ranges) == (None, "table:0001", 3, 2, [0], ["A1:B1", "A2:A3"])
    assert [(c.header, c.width_points, c.alignment) for c in t.columns] == [("Head", 100.0, "center"), ("Head", 50.0, "center")] and t.fixed_row_labels == ["A", "A"]
    book = writers.to_xlsx([{"kind": "sheet", "name": "S", "rows": [["k", "v"], ["a", "1"]]}])
    x = tables.table_structures(spark.createDataFrame([("a.xlsx", book)], FILES), "xlsx").first()
    assert (x.table_id, x.anchor, x.row_count, x.column_count, x.fixed_row_labels, [c.header for c in x.columns]) == ("sheet:0001", "S", 2, 2, ["a"], ["k", "v"])
    deck = writers.to_pptx([{"kind": "slide", "text": "t", "paragraphs": ["x"]}])
    assert tables.table_structures(spark.createDataFrame([("a.pptx", deck)], FILES), "pptx").count() == 0
    with pytest.raises(ValueError):
        conformance.template_issues(spark.range(0), spark.range(0), conformance.Policy(protected=("no",)))


def test_borders(spark):
    kinds = spark.createDataFrame([("text/csv", "csv"), ("text/plain", "csv"), ("x", "odd")], "m string, k string")
    assert [r.c for r in kinds.select(contracts.media_code(F.col("m"), F.col("k")).alias("c")).collect()] == ["OK", "MEDIA_TYPE_INVALID", "MEDIA_TYPE_INVALID"]
    texts = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ("{",), (None,)], "t string")
    assert [r.e for r in texts.select(contracts.strict_error("t").alias("e")).collect()] == [None, "JSON_DUPLICATE_KEY", "JSON_NONFINITE_NUMBER", "JSON_INVALID", "JSON_INVALID"]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+01:00",), ("2024-01-02T03:04:05",), ("20240105",), ("2024-13-01",), (None,)], "t string")
    got = [(r.x.micros, r.x.zoned) for r in times.select(iso_instant("t").alias("x")).collect()]
    assert [z for _, z in got] == [True, True, False, False, None, None] and got[0][0] - got[1][0] == 3_600_000_000
    out = spark.createDataFrame([("a", "text/csv", bytearray(b"x" * 5)), ("b", "text/csv", bytearray(b"x" * 50))], "output_name string, media_type string, content binary")
    assert [(r.delivery, r.payload_base64 is None) for r in contracts.deliver(out, 10).orderBy("output_name").collect()] == [("inline", False), ("sink", True)]
    assert contracts.capabilities(spark).count() == 5 and contracts.portable_capabilities(spark).count() > 10


def test_span_requests_and_reports(spark):
    pages = spark.createDataFrame([("s", 1, "Total 1,234.50 now", False, False)], "source_sha256 string, page int, text string, ocr_required boolean, truncated boolean")
    spans = spark.createDataFrame(
        [("a", "s", 1, 6, 14, "1,234.50", "1234.5", "number"), ("b", "s", 1, 0, 5, "Total", "x", "number"), ("c", "s", 1, 0, 99, "", None, "string"), ("d", "t", 1, 0, 1, "", None, "string"),
         ("e", "s", 2, 0, 1, "", None, "string"), ("f", "s", 1, 3, 3, "", None, "string")],
        "span_id string, source_sha256 string, page int, start int, end int, quote string, value string, value_type string",
    )
    got = {r.span_id: (r.status, r.reason) for r in contracts.verify_spans(spans, pages).collect()}
    assert got["a"] == ("pass", "SOURCE_SPAN_VERIFIED") and got["b"] == ("fail", "VALUE_CONVERSION_FAILED") and got["c"] == ("fail", "RANGE_OUT_OF_BOUNDS")
    errors = {(r.span_id, r.code) for r in contracts.span_request_errors(spans.unionByName(spans.filter("span_id = 'a'")), pages).collect()}
    assert errors == {("a", "SPAN_ID_NOT_UNIQUE"), ("d", "SOURCE_UNKNOWN"), ("e", "PAGE_UNKNOWN"), ("f", "RANGE_INVALID")}
    report = contracts.verify_spans(spans, pages)
    assert contracts.report_holds(report, spans, pages).count() == 0
    assert contracts.report_holds(report.withColumn("status", F.lit("pass")), spans, pages).count() == 5


ITEMS = "check_id string, pos int, value string, value_type string"


def test_versions_and_dates(spark):
    items = spark.createDataFrame(
        [("a", 0, "1.0", "version"), ("a", 1, "1.0", "version"), ("b", 0, "1.0", "version"), ("c", 0, "7", "integer"), ("c", 1, "7", "version"), ("d", 0, "1", "version"), ("d", 1, None, "null"),
         ("e", 0, "1.0", "version"), ("e", 1, "2.0", "version")], ITEMS,
    )
    got = {r.check_id: (r.status, r.reason, r.actual) for r in version_match(items).collect()}
    assert got == {"a": ("pass", "VERSIONS_MATCH", "1.0"), "b": ("error", "CHECK_INVALID", None), "c": ("fail", "VERSION_VALUE_INVALID", None),
                   "d": ("fail", "VERSION_VALUE_INVALID", None), "e": ("fail", "VERSION_MISMATCH", "2.0")}
    rows = [("a", ["2024-01-01", "20240102"]), ("b", ["2024-01-02", "2024-01-01"]), ("c", ["2024-01-01", "01/02/2024"]), ("d", ["2024-01-01"]), ("e", ["2024-01-01", "2024-01-01T00:00:00Z"]), ("f", ["2024-W01-1", "2024-01-01"])]
    dates = spark.createDataFrame([(c, k, v, "date") for c, vs in rows for k, v in enumerate(vs)], ITEMS)
    got = {r.check_id: (r.status, r.reason) for r in date_order(dates).collect()}
    assert got == {"a": ("pass", "DATE_ORDER_VALID"), "b": ("fail", "DATE_ORDER_INVALID"), "c": ("fail", "DATE_VALUE_INVALID"), "d": ("error", "CHECK_INVALID"),
                   "e": ("error", "DATE_ZONES_MIXED"), "f": ("pass", "DATE_ORDER_VALID")}
    kinds = [("s", "string", '"x"'), ("n", "number", "-1.5e3"), ("i", "integer", "7"), ("b", "boolean", "true"), ("z", "null", "null"), ("x", "integer", "7.5"), ("y", "string", "7"), ("w", "odd", "1")]
    evidence = spark.createDataFrame(kinds, "evidence_id string, value_type string, json string")
    assert {r.evidence_id for r in type_violations(evidence).collect()} == {"x", "y", "w"}


def test_compatible_forms_are_equal(spark):
    rows = spark.createDataFrame([("１２３", "123"), ("ﬁn", "fin"), ("a  b", "a b"), ("a", "b"), (None, "")], "p string, g string")
    assert [r.e for r in rows.select(scoring.equal_values(F.col("p"), F.col("g")).alias("e")).collect()] == [True, True, True, False, True]
    docs = spark.createDataFrame([("d", '{"a": "Ｘ y z"}')], "doc string, json string")
    targets = spark.createDataFrame([("x Y",), ("q",), ("z",)], "target string")
    assert scoring.transformation_compliance(docs, targets).first().compliance == 0.6667
    assert scoring.transformation_compliance(docs, targets.limit(0)).first().compliance is None


def test_profiles_limits(spark):
    pairs = spark.createDataFrame([("x", '{"a": {"rows": [1]}}', '{"a": {}}'), ("y", '{"a": {}}', "{")], "id string, before string, after string")
    assert {(r.id, r.path) for r in profiles.unresolved_keys(pairs, {"/a/rows": "k"}).collect()} == {("y", "/a/rows")}
    changes = spark.createDataFrame([("d", f"/{k:03d}", "changed", "a", "b") for k in range(7)], "doc string, path string, kind string, before_value string, after_value string")
    r = profiles.limited_changes(changes, ["doc"], 5).first()
    assert (r.total, r.truncated, [c.path for c in r.changes]) == (7, True, [f"/{k:03d}" for k in range(5)])


def test_reports(spark):
    paragraphs = spark.createDataFrame(
        [("v1", 0, "第一條 甲"), ("v1", 1, "x" * 200), ("v2", 0, "第一條 甲"), ("v2", 1, "y"), ("v1", 2, "第二條 乙"), ("v2", 2, "第二條 乙")], "doc string, idx int, text string"
    )
    lines = [r.line for r in reports.clause_lines(paragraphs).orderBy("clause", "n").collect()]
    assert len(lines) == 3 and lines[0].startswith("[differs]") and lines[1].endswith("…") and "v2" in lines[2]
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd")], "pair_id long, old string, new string")
    assert [r.line for r in reports.version_lines(pairs).orderBy("at", "n").collect()] == ["- b", "+ x", "+ d"]
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "doc string, passed boolean")
    assert tuple(reports.gate(verdicts).first()) == (2, 1, False) and tuple(reports.gate(verdicts.limit(0)).first()) == (0, 0, True)
    hits = spark.createDataFrame([("s", 2, "f", 1, 3, "x"), ("s", 1, "f", 9, 5, "y")], "section_id string, rank int, file string, page int, score long, snippet string")
    assert [h["page"] for h in json.loads(reports.source_map(hits).first().json)] == [9, 1]
    files = spark.createDataFrame([("a.docx", docx([{"kind": "heading", "level": 1, "text": "Contents"}, {"kind": "paragraphs", "paragraphs": ["One 3"]}])), ("b.docx", b"x")], FILES)
    report, health = reports.structure_health(files)
    assert {(r.doc, r.id) for r in report.filter("passed = false").collect()} == {("a.docx", "toc_is_field"), ("b.docx", "valid_docx")}
    assert {r.doc: (r.n_failed, r.worst, r.passed) for r in health.collect()} == {"a.docx": (1, "medium", False), "b.docx": (1, "high", False)}


def test_wide_pdf_and_numerals(spark):
    rows = spark.createDataFrame([("a.pdf", writers.to_pdf([{"kind": "paragraphs", "paragraphs": ["中文 text (x)"]}]))], FILES)
    assert blocks.pdf_blocks(rows).first().content.paragraphs == ["中文 text (x)"]
    with pytest.raises(ValueError, match="PDF_TEXT_UNSUPPORTED"):
        writers.to_pdf([{"kind": "paragraphs", "paragraphs": ["\U0001f600"]}])
    assert [numeral_value(x) for x in ("十", "壹佰零伍", "三萬五千", "二億三", "", "兩百x五")] == [10, 105, 35000, 200_000_003, 0, 205]


def test_drafts(spark):
    from quire.operators import drafts

    raw = ['"one"', '["a", 2]', '{"paragraphs": ["p"], "table": {"rows": [["x", 1]], "header_rows": -3}}', '{"rows": [["r"]], "values": {"k": 5}}', "7", '{"table": {"values": {"k": "v"}, "fill_mode": "odd"}}']
    rows = spark.createDataFrame([(k, "s", j) for k, j in enumerate(raw)], "id int, section string, json string")
    got = {r.id: r for r in drafts.parse_drafts(rows).collect()}
    assert [got[k].paragraphs for k in range(4)] == [["one"], ["a", "2"], ["p"], []] and got[4].error == "DRAFT_TYPE_UNSUPPORTED"
    assert (got[2].rows, got[2].header_rows, got[2].fill_mode) == ([["x", "1"]], 0, "full")
    assert (got[3].rows, got[3]["values"], got[3].fill_mode) == ([["r"]], {"k": "5"}, "by_label") and got[5].fill_mode == "odd"


def test_anchors_regions_and_first_tables(spark):
    from quire.operators import drafts

    p = spark.createDataFrame([("d", 0, "Title", "T"), ("d", 1, "Body", "Date: x"), ("d", 2, "Title", " "), ("d", 3, "H", ""), ("d", 4, "H", "One"), ("d", 5, "Title", "late")], "doc string, idx int, style string, text string")
    a = spark.createDataFrame([("title", "Title", None), ("date", None, "Date:")], "field string, style string, prefix string")
    assert {(r.field, r.idx) for r in drafts.anchored_paragraphs(p, a, ["H"]).collect()} == {("title", 0), ("date", 1)}
    images = spark.createDataFrame([("a", 100, 100), ("b", 100, 100)], "image_id string, image_width int, image_height int")
    regions = [("a", 5, k, 10, 1, f"t{k}", None) for k in range(99)] + [("a", 0, 0, 10, 1, f"u{k}", 0.5) for k in range(5)] + [("b", 95, 0, 10, 10, "x", None), ("b", 0, 0, 1, 1, "y", 2.0)]
    found, errors = drafts.text_regions(spark.createDataFrame(regions, "image_id string, x int, y int, width int, height int, text string, confidence double"), images)
    rows = found.orderBy("n").collect()
    assert [r.text for r in rows[:6]] == ["u0", "u1", "u2", "u3", "u4", "t0"] and len(rows) == 100 and rows[0].truncated
    assert {tuple(r) for r in errors.collect()} == {("b", "REGION_OUT_OF_BOUNDS"), ("b", "REGION_CONFIDENCE")}
    files = spark.createDataFrame([("a.docx", docx([{"kind": "paragraphs", "paragraphs": ["x"]}, {"kind": "table", "rows": [["1", "2"]]}])), ("b.docx", docx([{"kind": "heading", "level": 1, "text": "h"}, {"kind": "paragraphs", "paragraphs": ["x", "y"]}]))], FILES)
    first = {r.path: r.rows for r in drafts.first_table(blocks.content_blocks(files), ["path"]).collect()}
    assert first == {"a.docx": [["1", "2"]], "b.docx": [["h"], ["x"], ["y"]]}
    stories = spark.createDataFrame([("s", None, "word/header1.xml"), ("s", None, "word/footnotes.xml")], "source_sha256 string, error string, part string")
    marks = spark.createDataFrame([("s", None, "image")], "source_sha256 string, error string, kind string")
    r = drafts.docx_omissions(stories, marks).first()
    assert r.omitted == ["docx_footnotes", "docx_headers", "embedded_graphics"] and "DOCX_HEADERS_NOT_PROJECTED" in r.warnings
