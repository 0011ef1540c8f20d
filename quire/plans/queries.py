"""Queries over the test tables, one or more for each operator, with equivalent SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import schema
from quire.functions import text as T
from quire.operators import audits, binding, clauses, evidence, linediff, ordered, profiles, relevance, scoring, structure, templates
from quire.session import configure, shared_dir, table
from quire.streaming import ledger, reservations, sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The sections of the mapping queries: an id and what to look for.
SECTIONS = [("rights", ["rights reserved", "license", "copyright"]), ("access", ["password", "token", "key"]), ("common", ["the", "and", "of", "Thth"])]
_SECTION_VALUES = ", ".join(f"('{s}', {q!r})" for s, qs in SECTIONS for q in qs)


def _sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section_id string, queries array<string>")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), "text")


_MAPPED = f"""
WITH q(section_id, query) AS (VALUES {_SECTION_VALUES}),
scored AS (
  SELECT section_id, source AS file, doc_id AS page, count(*) AS score, min(instr(lower(text), lower(query))) AS first_hit
  FROM documents JOIN q ON instr(lower(text), lower(query)) > 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, file, page) AS rank FROM scored
)"""


@query(
    _MAPPED
    + r"""
SELECT r.section_id, CAST(r.rank AS INTEGER) AS rank, r.file, r.page, r.score,
  regexp_replace(regexp_replace(substr(d.text, CAST(greatest(0, r.first_hit - 1 - 240) AS BIGINT) + 1, 1800), '\s+', ' ', 'g'), '^ | $', '', 'g') AS snippet
FROM ranked r JOIN documents d ON d.doc_id = r.page WHERE r.rank <= 5
"""
)
def map_sources(spark, sf_dir):
    return relevance.map_sources(_pages(spark, sf_dir), _sections(spark))


@query(
    _MAPPED
    + """
SELECT section_id, string_agg('p.' || page, ', ' ORDER BY rank) AS pages FROM ranked WHERE rank <= 5 GROUP BY section_id
"""
)
def evidence_page_lists(spark, sf_dir):
    hits = relevance.map_sources(_pages(spark, sf_dir), _sections(spark))
    return relevance.evidence_pages(hits)


def _order_cells(spark, sf_dir):
    """A table for each order: a row for each line, then a total row that is off for every seventh order."""
    lines = table(spark, sf_dir, "lineitem")
    n = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    items = lines.select("l_orderkey", "l_extendedprice", (F.row_number().over(n) - 1).alias("row_ix"))
    total = lines.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("t"), F.count(F.lit(1)).cast("int").alias("row_ix"))
    off = F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    money = lambda c: F.format_string("%.2f", c)
    label = items.select("l_orderkey", "row_ix", F.lit(0).alias("col_ix"), F.lit("item").alias("value"))
    price = items.select("l_orderkey", "row_ix", F.lit(1).alias("col_ix"), money(F.col("l_extendedprice")).alias("value"))
    total_label = total.select("l_orderkey", "row_ix", F.lit(0).alias("col_ix"), F.lit("Total").alias("value"))
    total_price = total.select("l_orderkey", "row_ix", F.lit(1).alias("col_ix"), money(F.col("t") + off).alias("value"))
    cells = label.unionByName(price).unionByName(total_label).unionByName(total_price)
    return cells.select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("table_ix"), "row_ix", "col_ix", "value")


@query("""
SELECT l_orderkey AS doc, count(*) AS n_items, CAST(1 AS DOUBLE) AS diff FROM lineitem
GROUP BY l_orderkey HAVING l_orderkey % 7 = 0 AND count(*) >= 2
""")
def table_totals(spark, sf_dir):
    return audits.table_totals(_order_cells(spark, sf_dir)).select("doc", F.col("n").alias("n_items"), F.round("diff", 2).alias("diff"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS doc, CAST(CASE WHEN l_orderkey % 7 = 0 AND n >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_findings,
  CASE WHEN l_orderkey % 7 = 0 AND n >= 2 THEN 'high' ELSE 'none' END AS worst,
  NOT (l_orderkey % 7 = 0 AND n >= 2) AS passed FROM n
""")
def severity_rollup(spark, sf_dir):
    cells = _order_cells(spark, sf_dir)
    found = audits.table_totals(cells).select("doc", F.lit("high").alias("severity"))
    return audits.severity_rollup(found, cells.select("doc").distinct(), "medium")


@query(r"""
WITH p AS (
  SELECT o_orderkey AS doc, strftime(o_orderdate, '%Y/%m/%d') || ' ' ||
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'again' END || ' ' ||
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END AS text FROM orders
)
SELECT doc, CASE WHEN doc % 3 = 0 AND doc % 5 = 0 THEN 'MM/DD/YYYY, YYYY-MM-DD, YYYY/MM/DD'
                 WHEN doc % 3 = 0 THEN 'YYYY-MM-DD, YYYY/MM/DD' ELSE 'MM/DD/YYYY, YYYY/MM/DD' END AS styles
FROM p WHERE doc % 3 = 0 OR doc % 5 = 0
""")
def date_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = lambda f: F.date_format("o_orderdate", f)
    text = F.concat_ws(
        " ", day("yyyy/MM/dd"), F.when(F.col("o_orderkey") % 3 == 0, day("yyyy-MM-dd")).otherwise("again"),
        F.when(F.col("o_orderkey") % 5 == 0, day("MM/dd/yyyy")).otherwise(""),
    )
    return audits.date_formats(o.select(F.col("o_orderkey").alias("doc"), text.alias("text")))


@query("""
SELECT l_orderkey AS doc, l_linenumber AS idx, '壹佰零伍' AS words, CAST(105 AS BIGINT) AS words_value,
  CAST(CASE WHEN l_linenumber = 2 THEN 106 ELSE 99 END AS DOUBLE) AS number_value
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 1
""")
def nearest_number(spark, sf_dir):
    """Amounts in words against the nearest number, over a sentence for every line of every order."""
    return _line_amounts(table(spark, sf_dir, "lineitem"))


def _line_amounts(lines):
    lines = lines.select("l_orderkey", "l_linenumber").distinct()
    near = F.when(F.col("l_linenumber") == 1, "105").when(F.col("l_linenumber") == 2, "106").otherwise("99")
    text = F.concat(F.lit("9,999 and much further on the price is 壹佰零伍 元 ("), near, F.lit(") and 7"))
    rows = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), text.alias("text"))
    return audits.amounts_in_words(rows).drop("snippet")


@query("""
SELECT *, granted < n_chars AS truncated FROM (
  SELECT doc_id, source, n_chars, before, greatest(0, least(n_chars, 20000 - before)) AS granted FROM (
    SELECT doc_id, source, length(text) AS n_chars,
      CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM documents))
""")
def running_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
    return ordered.running_budget(d, ["source"], "doc_id", F.col("n_chars"), 20000)


_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents
), raws AS (
  SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN line < n THEN text || chr(10) ELSE text END AS raw, regexp_replace(text, chr(13) || '$', '') AS text FROM l
), placed AS (
  SELECT *, CAST(sum(strlen(raw)) OVER (PARTITION BY doc_id ORDER BY line) - strlen(raw) AS BIGINT) AS start_byte FROM raws
), sized AS (
  SELECT * FROM placed WHERE regexp_matches(text, '\S') AND doc_id NOT IN (SELECT doc_id FROM raws WHERE strlen(raw) > 8192 OR contains(text, chr(13)) OR contains(text, chr(0)))
)"""


def _files(rows: DataFrame, key: str, suffix: str, text: str) -> DataFrame:
    """(path, content): a file for each row, named by its key."""
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("path"), F.encode(text, "UTF-8").alias("content"))


def _lines(spark, sf_dir):
    """The physical lines that the reader gives of every document that it accepts, with their byte ranges and digests."""
    from quire.sources.items import text_items

    files = _files(table(spark, sf_dir, "documents").filter("text <> ''"), "doc_id", ".txt", "text")
    part = lambda k: F.get(F.from_json("source_locator", "array<string>"), F.lit(k))
    rows = text_items(files).filter("error is null")
    return rows.select(
        F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), part(3).cast("int").alias("line"), part(1).cast("long").alias("start_byte"),
        part(2).cast("long").alias("end_byte"), "text", part(4).alias("raw_sha256"),
    )


@query(_LINES + "SELECT doc_id, line, start_byte, start_byte + strlen(raw) AS end_byte, text FROM sized")
def line_items(spark, sf_dir):
    return _lines(spark, sf_dir).drop("raw_sha256")


@query(_LINES + "SELECT doc_id, line, sha256(raw) AS raw_sha256 FROM sized")
def line_digest(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", "raw_sha256")


@query("""
SELECT doc_id AS citation_id,
  CASE WHEN doc_id % 11 = 0 THEN 'STALE_SOURCE' WHEN 5 + doc_id % 9 > length(text) THEN 'INVALID_QUOTE_SPAN'
       WHEN doc_id % 7 = 0 THEN 'QUOTE_DIGEST_MISMATCH' ELSE 'RESOLVED' END AS code,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND 5 + doc_id % 9 <= length(text) THEN substr(text, 3, CAST(3 + doc_id % 9 AS BIGINT)) END AS quote
FROM documents WHERE text IS NOT NULL
""")
def resolve_quote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    sha = T.sha256(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("text")))
    items = d.select(sha.alias("source_sha256"), F.lit("text").alias("parser"), F.lit("1").alias("locator"), "text")
    end = (F.col("doc_id") % 9 + 5).cast("int")
    cites = d.select(
        F.col("doc_id").alias("citation_id"),
        F.when(F.col("doc_id") % 11 == 0, T.sha256(F.lit("gone"))).otherwise(sha).alias("source_sha256"),
        F.lit("text").alias("parser"), F.lit("1").alias("locator"), F.lit(2).alias("quote_start"), end.alias("quote_end"),
        T.sha256(F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.substr("text", F.lit(3), end - 2))).alias("quote_sha256"),
    )
    return binding.resolve_quotes(items, cites)


@query("SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaves(spark, sf_dir):
    from quire.sources.items import text_items

    rows = text_items(_files(table(spark, sf_dir, "events").filter("props is not null"), "event_id", ".json", "props")).filter("error is null")
    pointer = F.get(F.from_json("source_locator", "array<string>"), F.lit(1))
    return rows.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("event_id"), pointer.alias("pointer"), F.col("text").alias("value"))


def _part_rows(spark, sf_dir):
    """``part`` as the rows of one sheet for each brand, numbered by key."""
    p = table(spark, sf_dir, "part")
    order = W.partitionBy("p_brand").orderBy("p_partkey")
    return p.select(F.col("p_brand").alias("sheet"), (F.row_number().over(order) - 1).alias("row_index"), "p_partkey")


_PART_ROWS = "WITH r AS (SELECT p_brand AS sheet, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row_index, p_partkey FROM part)"


@query(_PART_ROWS + " SELECT * FROM r WHERE row_index >= 3 AND row_index < 8")
def csv_range(spark, sf_dir):
    return ordered.in_range(_part_rows(spark, sf_dir), "row_index", 3, 5)


@query(
    _PART_ROWS
    + """ SELECT sheet, count(*) FILTER (row_index >= 3 AND row_index < 8) AS returned, count(*) AS known_total,
  CASE WHEN least(count(*), 8) < count(*) THEN least(count(*), 8) ELSE -1 END AS next_row,
  CASE WHEN least(count(*), 8) < count(*) THEN 'partial_known' ELSE 'complete' END AS disposition FROM r GROUP BY sheet"""
)
def csv_coverage(spark, sf_dir):
    covered = ordered.coverage(_part_rows(spark, sf_dir), ["sheet"], "row_index", 3, 5)
    return covered.withColumn("next_row", F.coalesce("next_row", F.lit(-1).cast("long")))


@query(
    _PART_ROWS
    + """, n AS (SELECT sheet, count(*) AS total FROM r GROUP BY sheet),
 c AS (SELECT sheet, total, unnest(range(0, total, 4)) AS start FROM n)
 SELECT sheet, start, least(total, start + 4) AS end, CASE WHEN start + 4 < total THEN start + 4 ELSE -1 END AS next_row FROM c"""
)
def csv_cursor_chain(spark, sf_dir):
    return ordered.cursor_chain(_part_rows(spark, sf_dir), ["sheet"], "row_index", 4).select(
        "sheet", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce(F.col("next_row"), F.lit(-1)).cast("long").alias("next_row")
    )


_TURNS = """WITH t AS (
  SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island, role FROM conversations)"""


@query(
    _TURNS
    + " SELECT conv_id, CAST(island AS BIGINT) AS island, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n, min(turn) AS first FROM t GROUP BY conv_id, island"
)
def paragraph_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return ordered.joined_islands(ordered.islands(c, ["conv_id"], "turn", F.col("role") == "user"), ["conv_id"], "turn", "text")


@query(
    _TURNS
    + """ SELECT conv_id AS doc, CAST(island AS BIGINT) AS section, max(text) FILTER (role = 'user') AS heading,
  coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user'), '') AS body, count(*) FILTER (role <> 'user') AS n_lines
  FROM t WHERE island > 0 GROUP BY conv_id, island"""
)
def section_bodies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return structure.section_bodies(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), (F.col("role") == "user").alias("is_heading"), "text"))


@query("""
WITH items AS (
  SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) AS sub FROM conversations
)
SELECT conv_id, turn AS block, CAST(sub - 1 AS INTEGER) AS sub, line AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS ordinal FROM items WHERE trim(line) <> ''
""")
def flatten_items(spark, sf_dir):
    """Blocks to text items in order: a row for each sentence of a turn."""
    from quire.operators.blocks import flatten_paragraphs

    c = table(spark, sf_dir, "conversations")
    return flatten_paragraphs(c.select("conv_id", F.col("turn").alias("block"), F.split("text", r"\. ").alias("paragraphs")), ["conv_id"], None)


@query("""
WITH c AS (
  SELECT strftime(o_orderdate, '%Y') AS doc, 'Article' || (1 + o_orderkey % 9) AS clause,
    'Article ' || (1 + o_orderkey % 9) || chr(10) || o_orderpriority AS text, o_orderkey AS idx FROM orders WHERE o_orderkey % 9 <> 4 OR year(o_orderdate) % 2 = 0
), last AS (SELECT doc, clause, arg_max(text, idx) AS text FROM c GROUP BY doc, clause),
n AS (SELECT count(DISTINCT strftime(o_orderdate, '%Y')) AS n_docs FROM orders)
SELECT clause, count(DISTINCT doc) AS present, count(DISTINCT text) AS texts,
  CASE WHEN count(DISTINCT doc) < any_value(n_docs) THEN 'missing_in_some' WHEN count(DISTINCT text) > 1 THEN 'differs' ELSE 'same' END AS status
FROM last, n GROUP BY clause
""")
def clause_align(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    number = F.col("o_orderkey") % 9
    some = o.filter((number != 4) | (F.year("o_orderdate") % 2 == 0))
    heading = some.select(year.alias("doc"), (F.col("o_orderkey") * 2).alias("idx"), F.concat(F.lit("Article "), (number + 1).cast("string")).alias("text"))
    body = some.select(year.alias("doc"), (F.col("o_orderkey") * 2 + 1).alias("idx"), F.col("o_orderpriority").alias("text"))
    docs = o.select(year.alias("doc")).distinct()
    return clauses.align_clauses(clauses.clauses(heading.unionByName(body)), docs)


@query()
def version_diff(spark, sf_dir):
    """Line changes between each document and the next one of its source."""
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old"), F.lead("text").over(W.partitionBy("source").orderBy("doc_id")).alias("new"))
    return clauses.change_counts(clauses.version_changes(pairs.filter("new is not null")))


@query("""
WITH l AS (SELECT o_custkey AS pair_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'd' WHEN k % 11 = 0 THEN 'r' WHEN k % 13 = 0 THEN 'i' ELSE 's' END AS edit FROM l),
g AS (SELECT *, coalesce(sum(CASE WHEN edit IN ('s', 'i') THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM e),
c AS (SELECT pair_id, gap, count(*) FILTER (WHERE edit IN ('d', 'r')) AS less, count(*) FILTER (WHERE edit IN ('r', 'i')) AS more FROM g GROUP BY 1, 2)
SELECT pair_id, count(*) FILTER (WHERE less = 0 AND more > 0) AS added, count(*) FILTER (WHERE less > 0 AND more = 0) AS removed,
  count(*) FILTER (WHERE less > 0 AND more > 0) AS replaced FROM c WHERE less + more > 0 GROUP BY 1
""")
def version_lines(spark, sf_dir):
    """Each customer's orders as lines against a copy: some removed, some replaced, some with a line before them."""
    key = F.col("o_orderkey")
    edited = F.when(key % 7 == 0, None).when(key % 11 == 0, F.concat(F.lit("changed "), key)).when(
        key % 13 == 0, F.concat(F.lit("inserted "), key, F.lit("\n"), "line")).otherwise(F.col("line"))
    lines = table(spark, sf_dir, "orders").withColumn("line", F.concat(F.lit("order "), key, F.lit(" of "), "o_orderdate"))
    kept = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("line"), edited.alias("edited"))))
    both = lines.groupBy(F.col("o_custkey").alias("pair_id")).agg(kept.alias("l"))
    pairs = both.select("pair_id", F.array_join("l.line", "\n").alias("old"), F.array_join("l.edited", "\n").alias("new"))
    return clauses.change_counts(linediff.line_changes(pairs))


@query("""
WITH d AS (SELECT doc_id AS pair_id, text AS old, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS new FROM documents),
l AS (SELECT pair_id, side, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (
  SELECT pair_id, 'old' AS side, old AS text FROM d WHERE new IS NOT NULL UNION ALL SELECT pair_id, 'new', new FROM d WHERE new IS NOT NULL) AS u),
c AS (SELECT pair_id, line, count(*) FILTER (WHERE side = 'old') AS o, count(*) FILTER (WHERE side = 'new') AS n FROM l
  WHERE trim(regexp_replace(line, '\\s', ' ', 'g')) <> '' GROUP BY 1, 2)
SELECT pair_id, count(*) FILTER (WHERE o = 1 AND n = 1) AS once,
  CAST(CASE WHEN count(*) FILTER (WHERE o = 1 AND n = 1) > 0 THEN count(*) FILTER (WHERE o = 1 AND n = 1) ELSE sum(least(o, n)) END AS BIGINT) AS candidates
FROM c GROUP BY 1 HAVING sum(least(o, n)) > 0
""")
def version_anchors(spark, sf_dir):
    """How many lines may be matched in the first round between each document and the next one of its source, and how many surely."""
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old"), F.lead("text").over(W.partitionBy("source").orderBy("doc_id")).alias("new"))
    lines = linediff.version_lines(pairs.filter("new is not null")).withColumnRenamed("line", "digest").withColumn("seg", F.lit(0))
    found = linediff.candidates(lines).groupBy("pair_id")
    return found.agg(F.count(F.when(F.col("once"), 1)).alias("once"), F.count(F.lit(1)).alias("candidates"))


def _part_leaves(spark, sf_dir, changed: bool):
    p = table(spark, sf_dir, "part")
    size = F.when((F.col("p_partkey") % 5 == 0) & F.lit(changed), F.col("p_size") + 1).otherwise(F.col("p_size"))
    kind = F.when((F.col("p_partkey") % 7 == 0) & F.lit(changed), F.upper("p_type")).otherwise(F.col("p_type"))
    name = F.when((F.col("p_partkey") % 11 == 0) & F.lit(changed), F.concat(F.lit("  "), "p_name")).otherwise(F.col("p_name"))
    leaves = F.array(
        F.struct(F.lit("/size").alias("path"), F.when((F.col("p_partkey") % 13 == 0) & F.lit(changed), "str").otherwise("int").alias("type"), size.cast("string").alias("value")),
        F.struct(F.lit("/type").alias("path"), F.lit("str").alias("type"), kind.alias("value")),
        F.struct(F.lit("/name").alias("path"), F.lit("str").alias("type"), name.alias("value")),
    )
    out = p.select("p_partkey", F.explode(leaves).alias("leaf")).select("p_partkey", "leaf.*")
    if changed:
        return out.filter("not (p_partkey % 17 = 0 and path = '/name')")
    return out.filter("not (p_partkey % 19 = 0 and path = '/type')")


@query("""
WITH b AS (
  SELECT p_partkey, '/size' AS path, 'int' AS t, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL
  SELECT p_partkey, '/type', 'str', p_type FROM part WHERE p_partkey % 19 <> 0 UNION ALL SELECT p_partkey, '/name', 'str', p_name FROM part
), a AS (
  SELECT p_partkey, '/size' AS path, CASE WHEN p_partkey % 13 = 0 THEN 'str' ELSE 'int' END AS t,
    CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS v FROM part UNION ALL
  SELECT p_partkey, '/type', 'str', CASE WHEN p_partkey % 7 = 0 THEN upper(p_type) ELSE p_type END FROM part UNION ALL
  SELECT p_partkey, '/name', 'str', p_name FROM part WHERE p_partkey % 17 <> 0
)
SELECT * FROM (
  SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, coalesce(b.path, a.path) AS path,
    CASE WHEN b.t IS NULL THEN 'added' WHEN a.t IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'type_changed' WHEN a.v <> b.v THEN 'changed' END AS kind
  FROM b FULL JOIN a ON b.p_partkey = a.p_partkey AND b.path = a.path) WHERE kind IS NOT NULL
""")
def profile_diff(spark, sf_dir):
    before, after = (_part_leaves(spark, sf_dir, x) for x in (False, True))
    return profiles.leaf_diff(before, after, ["p_partkey"], "collapse_whitespace").select("p_partkey", "path", "kind")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS id, '/lines/@' || l_linenumber || '/q' AS path, 'changed' AS kind FROM l WHERE l_linenumber = 2
UNION ALL SELECT l_orderkey, '/lines/@' || l_linenumber || f, 'removed' FROM l, (VALUES ('/q'), ('/n')) AS x(f) WHERE l_linenumber = 3
""")
def keyed_array_diff(spark, sf_dir):
    """Arrays of lines compared by their number, of all orders."""
    return _line_array_diff(table(spark, sf_dir, "lineitem"))


def _line_array_diff(lines):
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))

    def profile(rows, q, descending: bool):
        listed = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), q.cast("int").alias("q"))), not descending)
        return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(listed.alias("lines"))).alias("json"))

    before = profile(lines, F.col("q"), False)
    after = profile(lines.filter("l_linenumber <> 3"), F.when(F.col("l_linenumber") == 2, F.col("q") + 1).otherwise(F.col("q")), True)
    shred = lambda p: profiles.shred_profiles(p, {"/lines": "n"}).filter("path is not null")
    return profiles.leaf_diff(shred(before), shred(after), ["id"]).select("id", "path", "kind")


def _customer_items(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 9 == 0, "  ").when(F.col("c_custkey") % 10 == 0, None).otherwise(F.col("c_name"))
    confidence = F.when(F.col("c_custkey") % 4 == 0, 0.5).otherwise(0.9)
    return c.select(F.col("c_custkey").alias("check_id"), F.lit(0).alias("pos"), value.alias("value"), confidence.alias("confidence"))


@query("""
SELECT c_custkey AS check_id, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN 'VALUE_MISSING' ELSE 'VALUE_PRESENT' END AS reason,
  CAST(CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing_count FROM customer
""")
def evidence_presence(spark, sf_dir):
    return evidence.presence(_customer_items(spark, sf_dir))


def _status_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("check_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("o_orderstatus").alias("value"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


_EQUAL = """
WITH i AS (SELECT o_custkey AS check_id, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
f AS (SELECT check_id, arg_min(v, pos) AS expected, count(*) AS compared_count FROM i GROUP BY 1),
m AS (SELECT i.check_id, arg_min(v, pos) AS off FROM i JOIN f USING (check_id) WHERE v <> expected GROUP BY 1)
SELECT f.check_id, CASE WHEN off IS NULL THEN 'pass' ELSE 'fail' END AS status, CASE WHEN off IS NULL THEN '{ok}' ELSE '{bad}' END AS reason,
  expected, coalesce(off, expected) AS actual, compared_count FROM f LEFT JOIN m USING (check_id)
"""


@query(_EQUAL.format(ok="VALUES_EQUAL", bad="VALUE_MISMATCH"))
def evidence_equality(spark, sf_dir):
    return evidence.equality(_status_items(spark, sf_dir).drop("date"))


@query(f"""
SELECT check_id, CASE WHEN compared_count < 2 THEN 'error' ELSE status END AS status, CASE WHEN compared_count < 2 THEN 'CHECK_INVALID' ELSE reason END AS reason,
  expected, CASE WHEN compared_count >= 2 THEN actual END AS actual, CASE WHEN compared_count >= 2 THEN compared_count END AS compared_count
FROM ({_EQUAL.format(ok="VERSIONS_MATCH", bad="VERSION_MISMATCH")}) AS e
""")
def evidence_version(spark, sf_dir):
    return evidence.version_match(_status_items(spark, sf_dir).drop("date"))


@query("""
SELECT l_orderkey * 10 + l_linenumber AS check_id, CASE WHEN l_quantity <= 5 THEN 'VALUE_BELOW_MINIMUM' WHEN l_quantity > 40 THEN 'VALUE_ABOVE_MAXIMUM' ELSE 'VALUE_WITHIN_RANGE' END AS reason,
  CASE WHEN l_quantity <= 5 OR l_quantity > 40 THEN 'fail' ELSE 'pass' END AS status FROM lineitem
""")
def evidence_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("check_id"), F.col("l_quantity").alias("number"), F.lit(5.0).alias("minimum"),
        F.lit(40.0).alias("maximum"), F.lit(False).alias("minimum_inclusive"), F.lit(True).alias("maximum_inclusive"),
    )
    return evidence.numeric_range(rows)


@query("""
WITH i AS (SELECT o_custkey AS check_id, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT check_id, CASE WHEN count(*) < 2 THEN 'CHECK_INVALID' WHEN bool_and(p IS NULL OR p <= d) THEN 'DATE_ORDER_VALID' ELSE 'DATE_ORDER_INVALID' END AS reason,
  CASE WHEN count(*) < 2 THEN 'error' WHEN bool_and(p IS NULL OR p <= d) THEN 'pass' ELSE 'fail' END AS status FROM i GROUP BY check_id
""")
def evidence_date_order(spark, sf_dir):
    items = _status_items(spark, sf_dir).select("check_id", "pos", F.col("date").alias("value"))
    return evidence.date_order(items)


@query("""
WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN 2 WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS s FROM customer)
SELECT c_nationkey AS bundle, CASE max(s) WHEN 2 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS status, count(*) AS n_checks FROM r GROUP BY 1
""")
def evidence_overall(spark, sf_dir):
    items = _customer_items(spark, sf_dir)
    results = evidence.with_confidence(evidence.presence(items), items, 0.8)
    bundles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("check_id"), F.col("c_nationkey").alias("bundle"))
    return evidence.overall(results.join(bundles, "check_id"), "bundle")


@query("SELECT o_orderkey AS check_id, o_custkey + 100000000 AS evidence_id FROM orders WHERE o_orderkey % 8 = 0")
def evidence_unknown(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    other = F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey"))
    checks = o.select(F.col("o_orderkey").alias("check_id"), F.array(other).alias("evidence_ids"))
    known = o.select(F.col("o_custkey").alias("evidence_id")).distinct()
    return evidence.unknown_evidence(checks, known)


@query("""
SELECT o_orderkey AS check_id, CASE WHEN o_orderkey % 6 = 0 THEN 'QUOTE_MISMATCH' WHEN o_orderkey % 10 = 0 THEN 'VALUE_MISMATCH' ELSE 'SOURCE_SPAN_VERIFIED' END AS reason,
  CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 THEN 'fail' WHEN o_orderkey % 4 = 0 THEN 'review' ELSE 'pass' END AS status FROM orders
""")
def span_binding(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    money = F.format_string("%.2f", "o_totalprice")
    sha = T.sha256(F.col("o_orderkey").cast("string"))
    pages = o.select(sha.alias("source_sha256"), F.lit(1).alias("page"), F.concat(F.lit("Amount due: "), money, F.lit(" net")).alias("text"), (F.col("o_orderkey") % 4 != 0).alias("complete"))
    end = F.length(money) + 12
    quote = F.when(F.col("o_orderkey") % 6 == 0, "Amount owed:").otherwise("Amount due: ")
    value = F.when(F.col("o_orderkey") % 10 == 0, "0.00").otherwise(money)
    checks = o.select(
        F.col("o_orderkey").alias("check_id"), sha.alias("source_sha256"), F.lit(1).alias("page"), F.lit(0).alias("quote_start"), F.lit(12).alias("quote_end"),
        quote.alias("quote"), F.lit(12).alias("value_start"), end.alias("value_end"), value.alias("value"),
    )
    return binding.bind_spans(pages, checks, 2)


def _gold(spark, sf_dir):
    """Gold fields from labels, and predictions from documents that are right but for every fifth."""
    lab = table(spark, sf_dir, "labels")
    gold = lab.select(F.col("doc_id").alias("doc"), F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))).alias("field", "gold"))
    gold = gold.withColumn("mandatory", F.col("field") == "quality")
    wrong = (F.col("doc") % 5 == 0) & (F.col("field") == "toxic")
    predicted = gold.select("doc", "field", F.when(wrong, "7").otherwise(F.concat(F.lit(" "), "gold", F.lit(".0"))).alias("predicted"))
    extra = lab.filter("doc_id % 6 = 0").select(F.col("doc_id").alias("doc"), F.lit("tone").alias("field"), F.when(F.col("doc_id") % 12 == 0, " ").otherwise("kind").alias("predicted"))
    return gold, predicted.unionByName(extra)


@query("""
SELECT doc_id AS doc, 'quality' AS field, TRUE AS correct, TRUE AS mandatory FROM labels
UNION ALL SELECT doc_id, 'toxic', doc_id % 5 <> 0, FALSE FROM labels
""")
def score_fields(spark, sf_dir):
    return scoring.score_fields(*_gold(spark, sf_dir))


@query("SELECT doc_id AS doc, 'tone' AS field, 'kind' AS predicted FROM labels WHERE doc_id % 6 = 0 AND doc_id % 12 <> 0")
def score_hallucination(spark, sf_dir):
    return scoring.hallucinations(*_gold(spark, sf_dir)).select("doc", "field", "predicted")


@query("""
SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS all_accuracy, 1.0::DOUBLE AS mandatory_accuracy,
  CAST(CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS hallucination_count,
  NOT (doc_id % 6 = 0 AND doc_id % 12 <> 0) AS accepted FROM labels
""")
def score_accept(spark, sf_dir):
    gold, predicted = _gold(spark, sf_dir)
    return scoring.acceptance(scoring.score_fields(gold, predicted), scoring.hallucinations(gold, predicted), ["doc"])


@query("""
SELECT d.doc_id AS doc, 'lang' AS field, d.lang AS value, d.source AS provenance, CAST(l.quality AS DOUBLE) AS confidence
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def review_rows(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = lambda df, *cols: df.select(F.col("doc_id").alias("doc"), F.lit("lang").alias("field"), *cols)
    return scoring.review_rows(
        one(d, F.col("lang").alias("value")), one(d, F.col("source").alias("provenance")), one(lab, F.col("quality").cast("double").alias("confidence"))
    )


def _verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("doc"), F.lit("lang").alias("field"), F.when(F.col("doc_id") % 3 == 0, "wrong").otherwise("correct").alias("verdict"),
        F.col("lang").alias("extracted"), F.upper("lang").alias("gold_value"),
    )


@query("SELECT doc_id AS doc, 'lang' AS field, lang AS extracted, upper(lang) AS corrected FROM documents WHERE doc_id % 3 = 0")
def corrections(spark, sf_dir):
    return scoring.commit_review(_verdicts(spark, sf_dir))[1]


@query("SELECT doc_id AS doc, 'lang' AS field, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS gold FROM documents")
def golden_records(spark, sf_dir):
    return scoring.commit_review(_verdicts(spark, sf_dir))[0]


PLACEHOLDERS = ["to be done", "rights reserved", "lorem"]


@query(r"""
SELECT doc_id AS id, length(trim(text, E' \t\n\r')) < 8 OR contains(lower(text), 'to be done') OR contains(lower(text), 'rights reserved') OR contains(lower(text), 'lorem') AS placeholder
FROM documents
""")
def placeholder_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return audits.placeholders(d.select(F.col("doc_id").alias("id"), "text"), PLACEHOLDERS)


@query("""
WITH b AS (SELECT 'n' || n_nationkey AS section, n_name AS text FROM nation WHERE n_nationkey % 5 <> 0)
SELECT 'n' || n.n_nationkey AS section,
  CAST(CASE WHEN b.text IS NULL THEN 0 ELSE CAST(contains(lower(b.text), 'a') AS INTEGER) + CAST(contains(lower(b.text), 'i') AS INTEGER) END AS INTEGER) AS n_found,
  CASE WHEN b.text IS NULL THEN 'section_missing' WHEN contains(lower(b.text), 'a') AND contains(lower(b.text), 'i') THEN 'complete' ELSE 'keywords_missing' END AS status
FROM nation n LEFT JOIN b ON b.section = 'n' || n.n_nationkey
""")
def keyword_audit(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    section = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    required = n.select(section.alias("section"), F.array(F.lit("A"), F.lit("i")).alias("keywords"))
    bodies = n.filter("n_nationkey % 5 <> 0").select(section.alias("section"), F.col("n_name").alias("text"))
    return audits.keyword_audit(bodies, required)


@query("""
WITH u AS (SELECT conv_id AS doc, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS b, CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 1 END AS c FROM conversations),
p AS (SELECT doc, sum(b) OVER (PARTITION BY doc ORDER BY turn) AS page, c FROM u),
g AS (SELECT doc, page, sum(c) AS content FROM p GROUP BY doc, page), m AS (SELECT *, max(page) OVER (PARTITION BY doc) AS last FROM g)
SELECT doc, count(*) FILTER (content = 0 AND page <> last) AS blank FROM m GROUP BY doc
""")
def blank_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    units = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), (F.col("role") == "user").alias("is_break"),
                     F.when(F.length("text") % 3 == 0, 0).otherwise(1).alias("content"))
    return structure.blank_pages(units)


@query("SELECT o_orderkey AS doc, CAST(o_custkey + 1000000 AS VARCHAR) AS ref FROM orders WHERE o_orderkey % 9 = 0")
def broken_refs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ref = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).cast("string")
    refs = o.select(F.col("o_orderkey").alias("doc"), ref.alias("ref"))
    return structure.broken_references(refs, o.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").cast("string").alias("ref")))


@query("""
WITH r AS (SELECT n_regionkey AS t, count(*) AS n FROM nation GROUP BY 1)
SELECT t AS table_id, 'TABLE_MISSING' AS issue FROM r WHERE t = 4
UNION ALL SELECT t, 'N_ROWS_MISMATCH' FROM r WHERE t = 1 UNION ALL SELECT t, 'N_COLS_MISMATCH' FROM r WHERE t IN (1, 2)
UNION ALL SELECT t, 'HEADER_ROWS_MISMATCH' FROM r WHERE t = 3
""")
def conformance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ref = n.groupBy(F.col("n_regionkey").alias("table_id")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(3)).withColumn("header_rows", F.lit(1))
    cand = ref.filter("table_id <> 4").select(
        "table_id", F.expr("n_rows + if(table_id = 1, 1, 0)").alias("n_rows"), F.expr("if(table_id in (1, 2), 4, 3)").alias("n_cols"), F.expr("if(table_id = 3, 2, 1)").alias("header_rows"),
    )
    return structure.conformance(ref, cand)


@query("""
SELECT n_regionkey AS table_id, n_name AS cell_id, CAST(min(n_nationkey // 5) AS BIGINT) AS top, min(n_nationkey % 5) AS left, CAST(max(n_nationkey // 5) AS BIGINT) AS bottom, max(n_nationkey % 5) AS right
FROM (SELECT n_regionkey, substr(n_name, 1, 1) AS n_name, n_nationkey FROM nation) GROUP BY 1, 2 HAVING count(*) > 1
""")
def merge_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    grid = n.select(F.col("n_regionkey").alias("table_id"), F.substring("n_name", 1, 1).alias("cell_id"), F.expr("n_nationkey div 5").alias("row_ix"), (F.col("n_nationkey") % 5).alias("col_ix"))
    return structure.merge_ranges(grid)


@query("""
WITH a AS (SELECT n_regionkey AS table_id, n_nationkey % 2 AS col_ix, CASE n_nationkey % 3 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'left' ELSE CASE WHEN n_regionkey > 1 THEN 'right' ELSE 'left' END END AS al FROM nation)
SELECT table_id, col_ix, CASE count(DISTINCT al) FILTER (al <> 'unspecified') WHEN 0 THEN 'unspecified' WHEN 1 THEN max(al) FILTER (al <> 'unspecified') ELSE 'mixed' END AS alignment FROM a GROUP BY 1, 2
""")
def column_alignment(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    al = F.when(F.col("n_nationkey") % 3 == 0, "unspecified").when(F.col("n_nationkey") % 3 == 1, "left").when(F.col("n_regionkey") > 1, "right").otherwise("left")
    return structure.alignment(n.select(F.col("n_regionkey").alias("table_id"), (F.col("n_nationkey") % 2).alias("col_ix"), al.alias("align")))


_EVENT_NEXT = "min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT event_id, user_id, coalesce({_EVENT_NEXT}, -1) AS next_boundary FROM events")
def next_boundary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    found = ordered.next_boundary(e, ["user_id"], "event_id", F.col("event_type") == "purchase")
    return found.select("event_id", "user_id", F.coalesce("next_boundary", F.lit(-1).cast("long")).alias("next_boundary"))


_NTH = "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') WHERE n = {n}"


@query(_NTH.format(n=1))
def first_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordered.nth_match(e, ["user_id"], "event_id", F.col("event_type") == "click", 1).select("user_id", "event_id")


@query(_NTH.format(n=3))
def nth_occurrence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordered.nth_match(e, ["user_id"], "event_id", F.col("event_type") == "click", 3).select("user_id", "event_id")


@query("""
WITH s AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, coalesce(bool_and(p IS NULL OR p <= ts), TRUE) AS ordered FROM s GROUP BY user_id
""")
def cue_order(spark, sf_dir):
    return ordered.in_order(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts")


@query("SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey")
def contiguity(spark, sf_dir):
    return ordered.contiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


#: Labels for the fuzzy join, in order.
LABELS = ["small ring", "widget", "hot gear box", "blue"]


@query("""
WITH k(ord, key) AS (VALUES (0, 'small ring'), (1, 'widget'), (2, 'hot gear box'), (3, 'blue')), n AS (SELECT ord, key, replace(key, ' ', '') AS k FROM k),
r AS (SELECT p_partkey AS row_id, regexp_replace(p_name, '\\s+', '', 'g') AS norm FROM part),
e AS (SELECT row_id, arg_min(key, ord) AS key FROM r JOIN n ON norm = k GROUP BY row_id)
SELECT row_id, key, 'exact' AS how FROM e
UNION ALL SELECT row_id, arg_min(key, ord), 'contained' FROM r JOIN n ON contains(norm, k) OR contains(k, norm) WHERE row_id NOT IN (SELECT row_id FROM e) GROUP BY row_id
""".replace("\\\\", "\\"))
def label_fuzzy_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    values = spark.createDataFrame(list(enumerate(LABELS)), "ord int, key string")
    return structure.match_labels(p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("label")), values)


@query("""
WITH i AS (SELECT p_partkey AS image_id, 300 + p_size * 37 AS width, 200 + p_partkey % 700 AS height FROM part),
g AS (SELECT *, CAST(ceil(width / 512.0) AS INTEGER) AS across, CAST(ceil(height / 512.0) AS INTEGER) AS down FROM i),
t AS (SELECT *, unnest(range(0, across * down)) AS tile FROM g)
SELECT image_id, CAST(tile AS INTEGER) AS tile, CAST((tile % across) * 512 AS INTEGER) AS x, CAST((tile // across) * 512 AS INTEGER) AS y,
  CAST(least(512, width - (tile % across) * 512) AS BIGINT) AS w, CAST(least(512, height - (tile // across) * 512) AS BIGINT) AS h FROM t
""")
def tile_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    images = p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 37 + 300).cast("long").alias("width"), (F.col("p_partkey") % 700 + 200).cast("long").alias("height"))
    return structure.tile_grid(images, 512)


@query("""
SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes, max(CAST(round(value * 100) AS BIGINT)) AS peak,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) <= 50000 AND max(CAST(round(value * 100) AS BIGINT)) <= 9000 AS within FROM events GROUP BY 1, 2
""")
def ledger_combine(spark, sf_dir):
    cost = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", cost.alias("bytes"), cost.alias("peak"))
    total = ledger.combine(e, ["user_id", "event_type"], ["bytes"], ["peak"])
    return total.withColumn("within", ledger.within(["bytes", "peak"], {"bytes": 50000, "peak": 9000}))


@query("""
WITH RECURSIVE d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, event_type FROM events),
h AS (
  SELECT user_id, event_id, revision, sha256(user_id || '|' || revision || '|' || event_type || '|') AS digest, CAST(NULL AS VARCHAR) AS previous_digest
  FROM d WHERE revision = 1
  UNION ALL
  SELECT d.user_id, d.event_id, d.revision, sha256(d.user_id || '|' || d.revision || '|' || d.event_type || '|' || h.digest), h.digest
  FROM d JOIN h ON d.user_id = h.user_id AND d.revision = h.revision + 1
)
SELECT user_id, event_id, CAST(revision AS INTEGER) AS revision, digest, previous_digest FROM h
""")
def ledger_chain(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(order).alias("revision"))
    return ledger.chained(e, ["user_id"], "revision", F.col("event_type")).drop("event_type")


@query("""
WITH asked AS (
  SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cost, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events
), decided AS (
  SELECT *, NOT bool_or(total > 20000) OVER (PARTITION BY user_id ORDER BY event_id) AS granted FROM asked
)
SELECT event_id, CAST(coalesce(sum(CASE WHEN granted THEN cost END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS running, granted FROM decided
""")
def ledger_reserve(spark, sf_dir):
    cost = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", cost.alias("cost"))
    return ledger.reserve(e, ["user_id"], "event_id", "cost", 20000).select("event_id", "running", "granted")


@query("""
WITH asked AS (
  SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cost, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events
), decided AS (
  SELECT *, NOT bool_or(total > 20000) OVER (PARTITION BY user_id ORDER BY event_id) AS granted FROM asked
)
SELECT event_id, CAST(coalesce(sum(CASE WHEN granted THEN cost END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS running,
  CASE WHEN granted THEN 'granted' ELSE 'refused' END AS status FROM decided
""")
def ledger_stream(spark, sf_dir):
    """The reservations of ``ledger_reserve`` as a stream of files in which a user's events are spread and shuffled."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), seq.alias("seq"), F.col("event_id").cast("string").alias("request_id"),
        F.round(F.col("value") * 100).cast("long").alias("cost"), F.col("ts").cast("timestamp").alias("ts"),
    )
    folder = f"{shared_dir(spark)}/quire-stream-{uuid.uuid4().hex}"
    e.withColumn("seq", F.col("seq").cast("long")).repartition(4, F.xxhash64("request_id")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("session string, seq long, request_id string, cost long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    decided = reservations.reserve_stream(stream, 20000, late="36500 days")
    sink = decided.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("request_id").cast("long").alias("event_id"), "running", "status")


_EVENT_SCHEMA = {
    "$defs": {"tag": {"type": "string", "maxLength": 7, "pattern": "^[a-z]+$"}},
    "type": "object", "required": ["k", "tags"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 5, "exclusiveMaximum": 90},
        "kind": {"enum": ["purchase", "signup", "view"]},
        "tags": {"type": "array", "items": {"$ref": "#/$defs/tag"}, "minItems": 1, "maxItems": 2},
    },
}


@query("""
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
b AS (
  SELECT event_id, '/k' AS path, CASE WHEN event_id % 17 = 0 THEN 'TYPE_MISMATCH' WHEN k < 5 THEN 'BELOW_MINIMUM' WHEN k >= 90 THEN 'ABOVE_MAXIMUM' END AS code FROM e
  UNION ALL SELECT event_id, '/kind', CASE WHEN event_type NOT IN ('purchase', 'signup', 'view') THEN 'ENUM_MISMATCH' END FROM e
  UNION ALL SELECT event_id, '/tags', CASE WHEN event_id % 11 = 0 THEN 'REQUIRED_MISSING' WHEN event_id % 7 = 0 THEN 'TOO_FEW_ITEMS' WHEN event_id % 5 = 0 THEN 'TOO_MANY_ITEMS' END FROM e
  UNION ALL SELECT event_id, '/tags/0', CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 AND length(event_type) > 7 THEN 'TOO_LONG' END FROM e
  UNION ALL SELECT event_id, '/tags/1', CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN CASE WHEN user_id % 3 = 0 THEN 'TYPE_MISMATCH' WHEN user_id % 3 = 1 THEN 'PATTERN_MISMATCH' END END FROM e
  UNION ALL SELECT event_id, '/a~1b', CASE WHEN event_id % 10 = 0 THEN 'ADDITIONAL_PROPERTY' END FROM e
)
SELECT event_id, path, code FROM b WHERE code IS NOT NULL AND event_id % 13 <> 0 UNION ALL SELECT event_id, '', 'MALFORMED' FROM e WHERE event_id % 13 = 0
""")
def schema_breaches(spark, sf_dir):
    """Breaches of a schema in texts made of every event, its props, type and user, some of them spoilt."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    number = F.get_json_object("props", "$.k")
    number = F.when(key % 17 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    second = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("user_id") % 3 == 1, F.lit('"A b"')).otherwise(F.lit('"tag"'))
    tags = F.when(key % 7 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), "event_type", F.lit('",'), second, F.when(key % 5 == 0, F.lit(',"more"')).otherwise(F.lit("")), F.lit("]"))
    )
    parts = F.concat_ws(",", F.concat(F.lit('"k":'), number), F.concat(F.lit('"kind":"'), "event_type", F.lit('"')),
                        F.when(key % 11 != 0, F.concat(F.lit('"tags":'), tags)), F.when(key % 10 == 0, F.lit('"a/b":null')))
    text = F.concat(F.lit("{"), parts, F.when(key % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    return schema.schema_breaches(e.select("event_id", text.alias("json")), "json", _EVENT_SCHEMA)


_TEMPLATE = """
WITH u AS (
  SELECT c_nationkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS idx, c_custkey % 5 AS sort, c_mktsegment, c_custkey FROM customer
), w(ord, section, want) AS (VALUES (1, 'cars', 'segmentautomobile'), (2, 'house', 'household'), (3, 'none', 'nowhere'), (4, 'first', 'customer')),
p AS (SELECT *, CASE WHEN sort = 0 THEN 'segment' || lower(c_mktsegment) ELSE 'customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS norm FROM u WHERE sort <> 1),
hit AS (SELECT doc, ord, norm = want AS exact, idx, sort, row_number() OVER (PARTITION BY doc, ord ORDER BY norm <> want, idx) AS r FROM p JOIN w ON contains(norm, want)),
best AS (SELECT * FROM hit WHERE r = 1),
ended AS (SELECT b.*, (SELECT min(idx) FROM u WHERE u.doc = b.doc AND u.sort = 0 AND u.idx > b.idx) AS para_end FROM best b),
tabled AS (SELECT e.*, (SELECT min(idx) FROM u WHERE u.doc = e.doc AND u.sort = 1 AND u.idx > e.idx AND (e.para_end IS NULL OR u.idx < e.para_end)) AS t FROM ended e)
SELECT d.doc, CAST(w.ord AS INTEGER) AS ord, w.section, b.idx IS NOT NULL AS found, CASE WHEN b.exact THEN 'exact' WHEN NOT b.exact THEN 'contains' ELSE '' END AS match,
  coalesce(b.idx, -1) AS para_start, coalesce(b.para_end, -1) AS para_end, b.t IS NOT NULL AS has_table,
  coalesce(u.c_custkey % 7, -1) AS table_rows, coalesce(u.c_custkey % 4, -1) AS table_cols
FROM (SELECT DISTINCT doc FROM u) d CROSS JOIN w LEFT JOIN tabled b ON b.doc = d.doc AND b.ord = w.ord LEFT JOIN u ON u.doc = d.doc AND u.idx = b.t
"""


@query(_TEMPLATE)
def template_profile(spark, sf_dir):
    """Sections of a body for each nation whose units are its customers: every fifth a heading, every fifth a table, the others paragraphs."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sort = key % 5
    segment = F.concat(F.lit("Segment: "), F.initcap("c_mktsegment"))
    units = c.select(
        F.col("c_nationkey").alias("doc"), F.row_number().over(W.partitionBy("c_nationkey").orderBy(key)).cast("long").alias("idx"),
        F.when(sort == 1, "table").otherwise("paragraph").alias("kind"), F.when(sort == 0, "Heading 1").when(sort > 1, "Normal").alias("style"),
        F.when(sort == 0, segment).when(sort > 1, F.concat(F.lit("Customer "), F.lpad(key.cast("string"), 9, "0"))).alias("text"),
        (key % 7).alias("n_rows"), (key % 4).alias("n_cols"),
    )
    wanted = spark.createDataFrame(
        [(1, "cars", "SEGMENT Automobile", "table"), (2, "house", "household", ""), (3, "none", "nowhere", ""), (4, "first", "customer", "")],
        "ord int, section string, heading string, mode string",
    )
    found = templates.template_profile(units, wanted, ["Heading 1"])
    return found.drop("heading", "mode", "heading_style").fillna(-1, ["para_start", "para_end", "table_rows", "table_cols"])


@query("SELECT event_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS issued_us, epoch_us(ts) - epoch_us(ts) % 3600000000 + 3600000000 AS expires_us FROM events")
def catalog_bucket(spark, sf_dir):
    return ledger.catalog_bucket(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 3600).drop("ts")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return ledger.once(e, ["user_id", "event_type"], "event_id")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * 100 AS s, l_linenumber * 100 + CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END AS e FROM lineitem),
p AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY s) AS prev FROM c)
SELECT l_orderkey, bool_and(coalesce(prev, 0) = s) AS sealed, CAST(max(e) AS BIGINT) AS size FROM p GROUP BY 1
""")
def seal_upload(spark, sf_dir):
    n = F.col("l_linenumber")
    off = F.when((F.col("l_orderkey") % 4 == 0) & (n == 1), 1).otherwise(0)
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", ((n - 1) * 100).cast("long").alias("start"), (n * 100 + off).cast("long").alias("end"))
    return ledger.seal(chunks, ["l_orderkey"])


@query("SELECT doc_id, sha256(source || '-' || doc_id || chr(0) || sha256(text)) AS artifact_id FROM documents")
def artifact_ids(spark, sf_dir):
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.artifact_id(name, T.sha256(F.col("text"))).alias("artifact_id"))


@query("""
WITH store AS (SELECT source AS name, arg_min(sha256(text), doc_id) AS sha FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, CASE WHEN sha IS NULL THEN 'created' WHEN sha = sha256(text) THEN 'no_op' ELSE 'conflict' END AS status FROM documents LEFT JOIN store ON name = source
""")
def sink_status(spark, sf_dir):
    from quire.sinks.artifacts import record_status

    d = table(spark, sf_dir, "documents").withColumn("sha256", T.sha256(F.col("text")))
    store = d.filter("doc_id % 2 = 0").groupBy(F.col("source").alias("output_name")).agg(F.min_by("sha256", "doc_id").alias("sha256"))
    return record_status(d.select("doc_id", F.col("source").alias("output_name"), "sha256"), store).select("doc_id", "status")


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2
""")
def session_events(spark, sf_dir):
    """An extension: sessions of events."""
    return sessions.sessionize(table(spark, sf_dir, "events"), 1800)


@query("""
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_windows(spark, sf_dir):
    """An extension: tumbling windows."""
    e = table(spark, sf_dir, "events")
    w = sessions.windowed_counts(e, "1 hour", "1 hour", "0 seconds")
    return w.select("event_type", F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "n")


@query("SELECT o_orderkey AS doc, o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 AS passed, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END::BIGINT AS n_checked FROM orders")
def structure_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = F.explode(F.array(
        F.struct(F.lit("a").alias("id"), (F.col("o_orderkey") % 3 != 0).alias("passed")), F.struct(F.lit("b").alias("id"), F.lit(True).alias("passed"))
    )).alias("x")
    inv = o.select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 0, "skipped").otherwise("checked").alias("status"), rows)
    return structure.passed(inv.select("doc", "status", "x.passed"))


@query()
def html_text(spark, sf_dir):
    """Text items of the pages, by the lenient reader."""
    from quire.sources.items import text_items

    p = table(spark, sf_dir, "pages")
    files = p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return text_items(files, "lenient").select("path", "error", "ordinal", "source_locator", "text")


@query("""
WITH s AS (SELECT *, least(length(text), 5000) AS size FROM documents),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
g AS (SELECT *, CAST(greatest(0, least(size, 30000 - before)) AS BIGINT) AS granted FROM b)
SELECT source AS file, CAST(doc_id AS INTEGER) AS page, substr(text, 1, granted) AS text, granted AS char_count, granted < length(text) AS truncated,
  length(trim(text, E' \\t\\n\\r')) < 20 AS ocr_required FROM g
""")
def clipped_pages(spark, sf_dir):
    from quire.sources.pages import clipped_pages as clip
    from quire.sources.pages import normalize_pages

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("Source_File"), F.col("doc_id").alias("Page_Number"), F.col("text").alias("Extracted_Text"))
    return clip(normalize_pages(d), per_page=5000, total=30000)


@query("""
SELECT 'n' || n_nationkey AS source_sha256, 'csv' AS kind, CAST(0 AS BIGINT) AS start, 'COUNT_MISMATCH' AS code FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'n' || n_nationkey, 'csv', 0, 'CURSOR_NOT_AT_END' FROM nation WHERE n_nationkey % 7 = 0
""")
def range_violations(spark, sf_dir):
    from quire.operators.projections import range_violations as violations

    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    rows = n.select(
        F.concat(F.lit("n"), key.cast("string")).alias("source_sha256"), F.lit("csv").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(10).cast("long").alias("end"),
        F.when(key % 5 == 0, 9).otherwise(10).cast("long").alias("returned"), F.when(key % 7 == 0, 11).otherwise(10).cast("long").alias("next_start"),
        F.lit(20).cast("long").alias("known_total"), F.lit("partial_known").alias("disposition"),
    )
    return violations(rows)


@query("""
WITH c(section, req) AS (VALUES ('name', 'a'), ('comment', 'zzqq')),
b AS (SELECT r_regionkey AS doc, 'name' AS section, 'region ' || r_name AS body FROM region)
SELECT d.doc, c.section, CASE WHEN body IS NULL THEN 'section_missing' ELSE 'required_keywords_missing' END AS "check", CASE WHEN body IS NULL THEN '' ELSE req END AS missing
FROM (SELECT DISTINCT doc FROM b) d CROSS JOIN c LEFT JOIN b ON b.doc = d.doc AND b.section = c.section
WHERE body IS NULL OR NOT contains(lower(body), req)
""")
def checklist_audit(spark, sf_dir):
    from quire.operators.checklist import audit

    r = table(spark, sf_dir, "region")
    bodies = r.select(F.col("r_regionkey").alias("doc"), F.lit("name").alias("section"), F.concat(F.lit("region "), "r_name").alias("body"))
    wanted = spark.createDataFrame(
        [("name", "N", ["region"], ["a"]), ("comment", "C", None, ["zzqq"])], "section string, title string, keywords array<string>, required_keywords array<string>"
    )
    return audit(bodies, wanted, ["to be done"]).select("doc", "section", "check", "missing")


@query("""
WITH c AS (SELECT n_name AS id, n_regionkey FROM nation)
SELECT 'R' || n_regionkey AS id, 'DUPLICATE_ID' AS issue FROM c GROUP BY n_regionkey HAVING count(*) > 1
UNION ALL SELECT 'R' || n_regionkey, 'UNKNOWN_MODE' FROM c WHERE substr(id, 1, 1) = 'I'
""")
def config_issues(spark, sf_dir):
    from quire.operators.checklist import config_issues as issues

    n = table(spark, sf_dir, "nation")
    mode = F.when(F.substring("n_name", 1, 1) == "I", "odd").otherwise("replace")
    return issues(n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("id"), F.col("n_name").alias("heading"), mode.alias("mode")), ["replace", "append"])


@query("""
SELECT doc_id AS doc, CAST((CAST(contains(lower(lang || ' ' || source), 'en') AS INTEGER) + CAST(contains(lower(lang || ' ' || source), 'src1') AS INTEGER)) / 2.0 AS DOUBLE) AS compliance FROM documents
""")
def transformation_compliance(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    targets = spark.createDataFrame([("EN",), ("src1",)], "target string")
    return scoring.transformation_compliance(d.select(F.col("doc_id").alias("doc"), F.concat_ws(" ", "lang", "source").alias("json")), targets)


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MEDIA_TYPE_NOT_ALLOWED' WHEN strlen(text) > 5000 THEN 'ARTIFACT_TOO_LARGE' WHEN doc_id % 3 = 0 THEN 'ARTIFACT_NOT_FOUND'
  WHEN doc_id % 7 = 0 THEN 'ARTIFACT_DIGEST_MISMATCH' ELSE 'RESOLVED' END AS code FROM documents
""")
def resolve_artifacts(spark, sf_dir):
    from quire.sinks.artifacts import resolve

    d = table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "UTF-8"))
    uri = F.concat(F.lit("artifact://"), F.col("doc_id").cast("string"))
    sha = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("content", 256))
    wanted = d.select("doc_id", uri.alias("uri"), sha.alias("sha256"), F.octet_length("content").alias("size_bytes"), F.when(F.col("doc_id") % 5 == 0, "image/png").otherwise("text/plain").alias("media_type"))
    store = d.filter("doc_id % 3 <> 0").select(uri.alias("uri"), "content")
    return resolve(wanted, store, 5000, ["text/plain"]).select("doc_id", "code")


@query("""
SELECT conv_id AS doc, turn AS block, count(*) OVER (PARTITION BY conv_id, turn) * 0 AS n_rows, CAST(strlen(text) AS BIGINT) AS n_bytes,
  CAST(0 AS BIGINT) AS total_rows, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS total_bytes FROM conversations
""")
def block_metrics(spark, sf_dir):
    from quire.operators import blocks

    c = table(spark, sf_dir, "conversations")
    content = F.struct(
        F.lit("paragraphs").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"),
        F.array("text").alias("paragraphs"), F.lit(None).cast("array<struct<label:string,value:string>>").alias("pairs"),
        F.lit(None).cast("int").alias("header_rows"), F.lit(None).cast("array<array<string>>").alias("rows"),
    )
    out = blocks.block_metrics(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("block"), content.alias("content")), ["doc"])
    return out.withColumn("n_rows", F.col("n_rows").cast("long"))
