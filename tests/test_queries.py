"""Every query against its SQL on DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quire.plans import files  # noqa: F401  (registers its queries)
from quire.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_keyed_array_diff_reads_every_order(spark, duck):
    want = set()
    for order, line in duck.execute("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 3)").fetchall():
        want |= {(order, "/lines/@2/q", "changed")} if line == 2 else {(order, f"/lines/@3/{f}", "removed") for f in "qn"}
    got = [tuple(r) for r in QUERIES["keyed_array_diff"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and any(r[0] % 50 for r in got)


def test_nearest_number_reads_every_line(spark, duck):
    lines = duck.execute("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 1").fetchall()
    got = [(r.doc, r.idx, r.number_value) for r in QUERIES["nearest_number"](spark, DATA).collect()]
    assert sorted(got) == sorted((o, n, 106.0 if n == 2 else 99.0) for o, n in lines) and any(n > 3 for _, n, _ in got)


def test_flatten_items_keeps_long_conversations_whole(spark, tmp_path):
    spark.sql("SELECT 'hot' AS conv_id, id AS turn, 'one. two. three' AS text FROM range(1000)").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["flatten_items"](spark, str(tmp_path)).collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 3001))


def test_version_diff_equals_the_standard_matcher(spark, duck):
    from difflib import SequenceMatcher

    rows = duck.execute("SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) FROM documents").fetchall()
    want = {}
    for doc, old, new in rows:
        if new is None:
            continue
        a, z = ([x for x in (t or "").split("\n") if x.strip()] for t in (old, new))
        kinds = [k for k, *_ in SequenceMatcher(None, a, z, autojunk=False).get_opcodes() if k != "equal"]
        if kinds:
            want[doc] = (kinds.count("insert"), kinds.count("delete"), kinds.count("replace"))
    got = {r.pair_id: (r.added, r.removed, r.replaced) for r in QUERIES["version_diff"](spark, DATA).collect()}
    assert got == want and want


def test_html_text_holds_what_a_plain_parser_finds(spark, duck):
    import re
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title", "noscript", "template")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title", "noscript", "template")

        def handle_data(self, data):
            if self.off <= 0:
                self.out.append(data)

    got = {}
    for r in QUERIES["html_text"](spark, DATA).orderBy("path", "ordinal").collect():
        assert r.error is None
        got.setdefault(int(r.path.split(".")[0]), []).append(r.text)
    for page, html in duck.execute("SELECT page_id, html FROM pages WHERE html IS NOT NULL").fetchall():
        p = Texts()
        p.feed(html)
        words = lambda parts: re.findall(r"\w+", " ".join(parts))
        assert set(words(got.get(page, []))) <= set(words(p.out)) | set(re.findall(r"\w+", html)), page
        assert len(words(got.get(page, []))) >= 0.5 * len(words(p.out)), page
