from quire.operators.projections import chain_violations, messages, office_violations, range_violations, stale_cursors

RANGE = "source_sha256 string, kind string, start long, end long, returned long, next_start long, known_total long, disposition string"


def codes(frame):
    return {(r.start, r.code) for r in frame.collect()}


def test_ranges(spark):
    good = [("s", "csv", 0, 500, 500, 500, 506, "partial_known"), ("s", "csv", 500, 506, 6, None, 506, "complete"),
            ("d", "docx", 1, 51, 50, 51, None, "partial_unknown"), ("d", "docx", 51, 56, 5, None, 55, "complete")]
    r = spark.createDataFrame(good, RANGE)
    assert range_violations(r).count() == 0 and chain_violations(r).count() == 0
    bad = [("s", "csv", 5, 10, 4, 11, 20, "complete"), ("s", "csv", 12, 700, 688, None, 20, "odd"), ("s", "pdf", 0, 1, 1, None, 0, "complete")]
    got = codes(range_violations(spark.createDataFrame(bad, RANGE)))
    assert got == {(5, "COUNT_MISMATCH"), (5, "CURSOR_NOT_AT_END"), (5, "DISPOSITION_MISMATCH"), (12, "RANGE_TOO_WIDE"), (12, "BEYOND_TOTAL"),
                   (12, "CURSOR_MISSING"), (12, "DISPOSITION_MISMATCH"), (0, "RANGE_INVALID")}
    assert codes(chain_violations(spark.createDataFrame(bad, RANGE))) == {(5, "CHAIN_BEGINS_LATE"), (12, "CHAIN_BROKEN"), (0, "CHAIN_BEGINS_LATE")}


def test_cursors_and_messages(spark):
    c = spark.createDataFrame([(1, "s", "p", "1"), (2, "s", "p", "2")], "cursor_id int, source_sha256 string, parser string, version string")
    s = spark.createDataFrame([("s", "p", "1")], "source_sha256 string, parser string, version string")
    assert [r.cursor_id for r in stale_cursors(c, s).collect()] == [2]
    f = spark.createDataFrame([("sum_off", {"a": "5"}), ("none", None)], "check string, params map<string,string>")
    cat = spark.createDataFrame([("sum_off", "en", "off by {a}"), ("sum_off", "zh", "差 {a}")], "key string, lang string, template string")
    assert {r.message for r in messages(f, cat, "zh").collect()} == {"差 5", "none"}
    assert {r.message for r in messages(f, cat, "fr").collect()} == {"off by 5", "none"}


def test_office_version_2(spark):
    schema = "source_sha256 string, kind string, start long, end long, returned long, next_start long, known_total long, disposition string, visible string"
    rows = [
        ("a", "xlsx", 1, 3, 2, None, 2, "complete", "visible"), ("b", "xlsx", 1, 3, 2, None, 2, "complete", None), ("c", "xlsx", 1, 3, 1, None, 2, "complete", "gone"),
        ("d", "csv", 0, 2, 2, None, 2, "complete", None), ("e", "csv", 0, 2, 2, 2, 2, "partial_known", None), ("f", "docx", 1, 9, 0, None, None, "complete", None),
        ("g", None, 1, 9, 0, None, None, "complete", None), ("h", "xlsx", 1, 3, 2, None, 2, "complete", "veryHidden"),
    ]
    got = {(r.source_sha256, r.code) for r in office_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("b", "SHEET_VISIBILITY_REQUIRED"), ("c", "SHEET_VISIBILITY_REQUIRED"), ("c", "COUNT_MISMATCH"), ("e", "CURSOR_AFTER_LAST"),
        ("f", "UNSUPPORTED_CONTRACT"), ("g", "UNSUPPORTED_CONTRACT"),
    }
