from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.python import canonical, casefold, cn_number, json_values_equal, nfkc, numeral_value, strict_json


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_numerals():
    assert [numeral_value(x) for x in ("壹萬貳仟", "拾", "貳佰零五", "壹億")] == [12000, 10, 205, 100000000]


def test_numeral_column(spark):
    assert one(spark, cn_number(F.col("a")), a="壹萬貳仟") == 12000


def test_numbers(spark):
    rows = spark.createDataFrame([("1,234.5",), ("5%",), ("2024-01",), ("-",), ("",), (None,), ("NT$ 30",)], "a string")
    assert [r.x for r in rows.select(T.to_number(F.col("a")).alias("x")).collect()] == [1234.5, 5.0, None, None, None, None, 30.0]


def test_plain_float(spark):
    rows = spark.createDataFrame([(" 5 ",), ("1e3",), ("NaN",), ("-2.50",)], "a string")
    assert [r.x for r in rows.select(T.plain_float(F.col("a")).alias("x")).collect()] == [5.0, None, None, -2.5]


def test_headings_and_labels(spark):
    assert one(spark, T.normalize_heading(F.col("a")), a=" 1. Pro-duct_Name ") == "1productname"
    assert one(spark, T.normalize_label(F.col("a")), a="品　名\n x") == "品名x"


def test_clause_keys(spark):
    rows = [("第 一 條 總則",), ("article  12 Terms",), ("Section 3",), ("1.2. Scope",), ("none",)]
    keys = spark.createDataFrame(rows, "a string").select(T.clause_key(F.col("a")).alias("x"))
    assert [r.x for r in keys.collect()] == ["第一條", "article12", "Section3", "1.2", None]


def test_date_styles(spark):
    assert one(spark, F.concat_ws("|", T.date_styles(F.col("a"))), a="起始 2024/01/01，結束 2024-12-31。") == "YYYY-MM-DD|YYYY/MM/DD"


def test_pointer_and_decimal(spark):
    assert one(spark, T.pointer_part(F.col("a")), a="a/b~c") == "/a~1b~0c"
    assert one(spark, T.exact_decimal(F.col("a"), 2), a="-0.00") == "0.00"
    assert one(spark, T.exact_decimal(F.col("a"), 2), a="1.5") is None


def test_time_and_letters(spark):
    assert one(spark, T.milliseconds(F.col("a")), a="01:02:03,004") == 3723004
    rows = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,)], "a int").select(T.column_letters(F.col("a")).alias("x"))
    assert [r.x for r in rows.collect()] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_rows_and_cells(spark):
    got = spark.sql("SELECT array('a', '', 'b', '', '') AS a").select(T.trim_row(F.col("a")).alias("x")).first()["x"]
    assert got == ["a", "", "b"]
    assert spark.range(1).select(T.cell_text(F.lit(3.0)).alias("x")).first()["x"] == "3"


def test_unicode(spark):
    assert one(spark, nfkc(F.col("a")), a="ﬁ５") == "fi5"
    assert one(spark, casefold(F.col("a")), a="Straße") == "strasse"


def test_json(spark):
    assert canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    try:
        strict_json('{"a":1,"a":2}')
        raise AssertionError
    except ValueError as e:
        assert str(e) == "JSON_DUPLICATE_KEY"
    rows = spark.createDataFrame([("1", '"1.0000001"'), ("null", '""'), ("true", "1"), ("[1,2]", "[1]")], "a string, b string")
    assert [r.x for r in rows.select(json_values_equal("a", "b").alias("x")).collect()] == [True, True, False, False]
