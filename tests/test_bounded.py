"""Ranges that stop at their end, as a data source and over a DataFrame of files."""

import csv
import io
import zipfile

import pytest

from quire.sinks.files import write_files
from quire.sources import bounded
from quire.sources.bounded import bounded_units, register

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def docx(n, tail="</w:body></w:document>"):
    body = "".join(f"<w:p><w:r><w:t>p{i} {i * 7919 % 1000003 ** 2}</w:t></w:r></w:p>" for i in range(1, n + 1))
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return package(word__document_dot_xml=f"<w:document {W}><w:body>{body}{table}{tail}")


def text_csv(n):
    out = io.StringIO()
    csv.writer(out).writerows([["k", "v"], *([str(i), f"line\n{i}, x"] for i in range(n))])
    return out.getvalue().encode()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("files"))
    files = [("a/one.csv", text_csv(1000)), ("a/two.csv", text_csv(3)), ("b/doc.docx", docx(500)), ("b/odd.docx", b"no package"), ("a/bad.csv", b"a\n\xff")]
    written = write_files(spark.createDataFrame(files, "path string, content binary"), where).collect()
    assert {r.path.rsplit("/", 1)[1] for r in written} == {f.rsplit("/", 1)[1] for f, _ in files}
    register(spark)
    return where


def read(spark, folder, kind, **options):
    return spark.read.format("quire").option("kind", kind).options(**{k: str(v) for k, v in options.items()}).load(folder)


def test_source_reads_ranges(spark, folder):
    got = read(spark, f"{folder}/a/*.csv", "csv", start=2, size=2).collect()
    assert {(r.path.rsplit("/", 1)[1], r.unit, r.cells and r.cells[1], r.units_parsed, r.error) for r in got} == {
        ("one.csv", 2, "line\n2, x", 4, None), ("one.csv", 3, "line\n3, x", 4, None), ("two.csv", 2, "line\n2, x", 3, None),
        ("bad.csv", None, None, None, "NOT_UTF8"),
    }
    words = read(spark, f"{folder}/b", "docx", start=499, size=5).orderBy("unit").collect()
    assert [(r.unit, r.label, (r.text or "").split(" ")[0], r.cells) for r in words if not r.error] == [
        (499, "Normal", "p499", None), (500, "Normal", "p500", None), (501, "table", "", ["a", "b"]),
    ]
    assert [r.error for r in words if r.error] == ["PACKAGE_INVALID"]


def test_filters_reach_the_source(spark, folder):
    found = read(spark, f"{folder}/a/*.csv", "csv").filter("unit > 4 and unit <= 6 and cells[0] <> '6'")
    assert [(r.unit, r.units_parsed) for r in found.collect()] == [(5, 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cells" in plan.split("Filter", 1)[1].split("\n", 1)[0] and "unit" not in plan.split("Filter", 1)[1].split("\n", 1)[0]
    one = read(spark, f"{folder}/a/*.csv", "csv").filter(f"path = '{folder}/a/two.csv' and unit = 0")
    assert [r.cells for r in one.collect()] == [["0", "line\n0, x"]]
    assert read(spark, f"{folder}/a/*.csv", "csv").filter("unit < 0").count() == 0
    # What the source takes equals what a filter above it keeps.
    plain = read(spark, f"{folder}/a/*.csv", "csv").filter("unit + 0 > 4 and unit + 0 <= 6").select("path", "unit", "cells").collect()
    pushed = read(spark, f"{folder}/a/*.csv", "csv").filter("unit > 4 and unit <= 6").select("path", "unit", "cells").collect()
    assert sorted(plain) == sorted(pushed) and len(plain) == 2


def test_what_follows_a_range_is_not_read(spark):
    """Damage behind the range's end isn't seen, as nothing there is parsed; a range over it tells."""
    broken = docx(20_000, tail="<w:p><w:broken></w:body>")
    files = spark.createDataFrame([("d.docx", broken), ("c.csv", text_csv(50) + b'"open\n')], "path string, content binary")
    one = bounded_units(files.filter("path = 'd.docx'"), "docx", 10, 2).collect()
    assert [(r.unit, r.units_parsed, r.error) for r in one] == [(10, 11, None), (11, 11, None)]
    assert [r.error for r in bounded_units(files.filter("path = 'd.docx'"), "docx", 19_999, 50).collect()] == ["XML_INVALID"]
    assert [r.unit for r in bounded_units(files.filter("path = 'c.csv'"), "csv", 48, 2).collect()] == [48, 49]
    assert [r.error for r in bounded_units(files.filter("path = 'c.csv'"), "csv", 48, 3).collect()] == ["CSV_INVALID"]


def test_ranges_follow_on_to_the_whole(spark):
    files = spark.createDataFrame([("x.csv", text_csv(23))], "path string, content binary")
    rows = [r.cells[0] for start in range(0, 30, 7) for r in bounded_units(files, "csv", start, 7).orderBy("unit").collect()]
    assert rows == [str(i) for i in range(23)]


def test_what_is_refused(spark, folder):
    files = spark.createDataFrame([("x", b"")], "path string, content binary")
    for args in (("odt",), ("csv", -1), ("docx", 0), ("csv", 0, 0)):
        with pytest.raises(ValueError):
            bounded_units(files, *args)
    assert [r.error for r in bounded_units(files, "csv").collect()] == ["CSV_EMPTY"]
    assert bounded_units(files.limit(0), "csv").count() == 0
    with pytest.raises(Exception, match="isn't below"):
        write_files(spark.createDataFrame([("../x", b"")], "path string, content binary"), folder).collect()
    assert bounded._checked("csv", None, None) == (0, bounded.NO_END)
