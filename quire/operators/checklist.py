"""A checklist of sections against a document's sections: missing, placeholder, keywords, sub-requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def audit(bodies: DataFrame, checklist: DataFrame, placeholders: list[str]) -> DataFrame:
    """Findings (doc, section, check, severity, missing) of every document of ``bodies``.

    ``bodies`` is (doc, section, body). ``checklist`` is (section, title, keywords, required_keywords),
    a configuration: it is crossed with the documents by broadcast, so a section that a document
    doesn't have is a finding too.
    """
    documents = bodies.select("doc").distinct()
    wanted = documents.crossJoin(F.broadcast(checklist))
    joined = wanted.join(bodies, ["doc", "section"], "left")
    body = F.coalesce("body", F.lit(""))
    lacking = F.array_except(F.coalesce("required_keywords", F.array().cast("array<string>")), T.hits(body, F.coalesce("required_keywords", F.array().cast("array<string>"))))
    some = F.coalesce("keywords", F.array().cast("array<string>"))
    empty = T.is_placeholder(body, F.array(*(F.lit(p) for p in placeholders)))
    finding = lambda cond, check, severity, missing="": F.when(
        cond, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), (missing if not isinstance(missing, str) else F.lit(missing)).alias("missing"))
    )
    there = F.col("body").isNotNull()
    found = F.array_compact(
        F.array(
            finding(~there, "section_missing", "high"),
            finding(there & empty, "section_placeholder", "high"),
            finding(there & ~empty & (F.size(some) > 0) & ~T.has_any(body, some), "keywords_absent", "medium"),
            finding(there & ~empty & (F.size(lacking) > 0), "required_keywords_missing", "high", F.concat_ws(", ", lacking)),
        )
    )
    return joined.select("doc", "section", F.explode(found).alias("f")).select("doc", "section", "f.*")


def config_issues(sections: DataFrame, modes: list[str]) -> DataFrame:
    """Issues of a mapping configuration (id, heading, mode): empty and repeated ids, unknown modes, no heading."""
    empty = sections.filter(F.coalesce(F.trim("id"), F.lit("")) == "").select(F.lit("").alias("id"), F.lit("EMPTY_ID").alias("issue"))
    twice = sections.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id <> ''").select("id", F.lit("DUPLICATE_ID").alias("issue"))
    mode = sections.filter(~F.coalesce("mode", F.lit("")).isin(modes)).select("id", F.lit("UNKNOWN_MODE").alias("issue"))
    head = sections.filter(F.coalesce(F.trim("heading"), F.lit("")) == "").select("id", F.lit("NO_HEADING").alias("issue"))
    return empty.unionByName(twice).unionByName(mode).unionByName(head)
