"""Which source units matter to which section: distinct query hits, ranked, with a snippet."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import collapse

#: Characters kept before the first hit of a snippet.
LEAD = 240


#: Sections that one configuration may have; they are taken to the driver and become part of the plan.
MAX_SECTIONS = 500


def map_sources(pages: DataFrame, sections: DataFrame, top: int = 5, snippet_chars: int = 1800) -> DataFrame:
    """Rank pages (file, page, text) for each section (section_id, queries).

    A page scores one for each configured query that it holds, case aside; the best ``top`` by
    score, then file, then page, come with their snippet. Every row of ``pages`` is scored by itself, also
    where (file, page) repeats. Pages are scanned once, and a partition sends its best rows alone.
    """
    config = [(r[0], [q for q in r[1] or () if q is not None]) for r in sections.select("section_id", "queries").limit(MAX_SECTIONS + 1).collect()]
    if len(config) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections")
    listed = F.array(
        *(F.struct(F.lit(s).alias("section_id"), F.array(*(F.lower(F.lit(q)) for q in qs)).cast("array<string>").alias("queries")) for s, qs in config)
    )
    if not config:
        return pages.limit(0).selectExpr("'' section_id", "0 rank", "file", "page", "0L score", "'' snippet")
    rows = pages.withColumn("__low", F.lower("text")).withColumn("s", F.explode(listed))
    places = F.filter(F.transform("s.queries", lambda q: F.instr(F.col("__low"), q)), lambda at: at > 0)
    scored = rows.withColumn("__at", places).filter(F.size("__at") > 0)
    start = F.greatest(F.lit(0), F.array_min("__at") - 1 - LEAD)
    snippet = collapse(F.substr("text", start + 1, F.lit(snippet_chars)))
    hits = scored.select(F.col("s.section_id").alias("section_id"), "file", "page", F.size("__at").cast("long").alias("score"), snippet.alias("snippet"))
    order = W.partitionBy("section_id").orderBy(F.desc("score"), "file", "page", "snippet")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "section_id", "rank", "file", "page", "score", "snippet"
    )


def evidence_pages(hits: DataFrame, limit: int = 5) -> DataFrame:
    """The distinct pages of each section in rank order, as 'p.1, p.3'."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "page")))
    pages = F.slice(F.array_distinct(F.transform(listed, lambda x: x["page"])), 1, limit)
    text = F.concat_ws(", ", F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string"))))
    return hits.groupBy("section_id").agg(text.alias("pages"))
