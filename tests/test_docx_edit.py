import json

from quire.sinks.docx_edit import edit, edit_documents
from quire.sinks.writers import to_docx
from quire.sources.ooxml import docx_body, docx_marks, docx_parts

BLOCKS = [
    {"kind": "paragraphs", "paragraphs": ["Product: old", "Product: older"]},
    {"kind": "heading", "level": 1, "text": "1. Scope"},
    {"kind": "paragraphs", "paragraphs": ["draft text"]},
    {"kind": "table", "rows": [["品 名", ""], ["Weight (g)", "1"], ["Other", "x"]]},
    {"kind": "heading", "level": 1, "text": "2. Use"},
    {"kind": "paragraphs", "paragraphs": ["keep TODO this"]},
]


def body(payload):
    return [(b[2], b[4], b[5]) for b in docx_body(payload)]


def test_sections_and_tables():
    plan = [
        {"edit": "replace_section", "heading": "scope", "paragraphs": ["new one", "new two"]},
        {"edit": "fill_table", "heading": "1. Scope", "values": {"品名": "tea", "Weight": "9"}},
        {"edit": "front_matter", "prefix": "Product:", "text": "Product: new", "occurrence": 2},
    ]
    out, done = edit(to_docx(BLOCKS), plan)
    assert done == [2, 2, 1]
    assert [t for _, t, _ in body(out) if t is not None] == ["Product: old", "Product: new", "1. Scope", "new one", "new two", "2. Use", "keep TODO this"]
    assert next(rows for _, _, rows in body(out) if rows) == [["品 名", "tea"], ["Weight (g)", "9"], ["Other", "x"]]


def test_fields_breaks_and_marks():
    plan = [
        {"edit": "insert_toc", "after": "Use"}, {"edit": "insert_toc", "after": "Use"}, {"edit": "heading_breaks", "styles": ["heading 1"]},
        {"edit": "fit_tables"}, {"edit": "highlight", "terms": ["TODO"]}, {"edit": "page_footer"}, {"edit": "remove_images", "heading": "Use"},
    ]
    out, done = edit(to_docx(BLOCKS), plan)
    assert done == [1, 0, 2, 1, 1, 1, 0]
    assert [k for k, _ in docx_marks(out)].count("toc") == 1
    assert [t for _, t in docx_parts(out)] == ["Page  of "]
    again, done = edit(out, [{"edit": "clear_highlights"}])
    assert done == [1] and body(again) == body(out)


def test_plans_as_rows(spark):
    rows = [
        ("a", to_docx(BLOCKS), json.dumps([{"edit": "fit_tables"}])), ("b", b"bad", "[]"), ("c", to_docx(BLOCKS), json.dumps([{"edit": "replace_section", "heading": "zz", "paragraphs": []}])),
        ("d", to_docx(BLOCKS), json.dumps([{"edit": "boom"}])), ("e", to_docx(BLOCKS), json.dumps([{"edit": "fit_tables", "wide": 1}])),
    ]
    got = {r.path: (r.counts, r.error) for r in edit_documents(spark.createDataFrame(rows, "path string, content binary, plan string")).collect()}
    assert got == {"a": ([1], None), "b": (None, "PACKAGE_INVALID"), "c": (None, "SECTION_NOT_FOUND"), "d": (None, "UNKNOWN_EDIT"), "e": (None, "PLAN_INVALID")}
