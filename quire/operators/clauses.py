"""Clauses of documents, aligned over versions, and line-by-line version differences."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import clause_key, strip
from quire.operators.ordered import islands


def clauses(paragraphs: DataFrame) -> DataFrame:
    """(doc, clause, text, position) from paragraphs (doc, idx, text).

    A heading begins a clause, what stands before the first is dropped, and of headings that
    repeat a key the last text counts at the first position.
    """
    lines = paragraphs.select("doc", "idx", strip(F.col("text")).alias("text")).filter("text <> ''")
    keyed = islands(lines.withColumn("key", clause_key(F.col("text"))), ["doc"], "idx", F.col("key").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    parts = keyed.filter("island > 0").groupBy("doc", "island").agg(
        F.first("key", ignorenulls=True).alias("clause"),
        strip(F.concat_ws("\n", F.transform(listed, lambda x: x["text"]))).alias("text"),
        F.min("idx").alias("idx"),
    )
    return parts.groupBy("doc", "clause").agg(F.max_by("text", "idx").alias("text"), F.min("idx").alias("position"))


def align_clauses(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Each clause over all ``documents`` (doc): same, differs or missing_in_some.

    An N-way full outer join on the clause is one aggregation: how many documents have it, and
    how many different texts they have.
    """
    n = documents.agg(F.count_distinct("doc").alias("n_docs"))
    per = found.groupBy("clause").agg(F.count_distinct("doc").alias("present"), F.count_distinct("text").alias("texts"))
    status = F.when(F.col("present") < F.col("n_docs"), "missing_in_some").when(F.col("texts") > 1, "differs").otherwise("same")
    return per.crossJoin(n).select("clause", "present", "texts", status.alias("status"))


def version_changes(pairs: DataFrame) -> DataFrame:
    """Line differences of (pair_id, old, new) texts: (pair_id, kind, old_from, old_to, new_from, new_to).

    The matching is the longest-block matching of the standard library's sequence matcher, so a
    pair is handled by itself in an Arrow batch; blank lines are left out beforehand.
    """
    import pyarrow as pa

    names = {"insert": "added", "delete": "removed", "replace": "replaced"}
    schema = "pair_id long, kind string, old_from int, old_to int, new_from int, new_to int"

    def diff(batches):
        from difflib import SequenceMatcher

        for b in batches:
            out = []
            for pid, old, new in zip(b["pair_id"].to_pylist(), b["old"].to_pylist(), b["new"].to_pylist()):
                a, z = ([x for x in (t or "").split("\n") if x.strip()] for t in (old, new))
                for kind, i1, i2, j1, j2 in SequenceMatcher(None, a, z, autojunk=False).get_opcodes():
                    if kind != "equal":
                        out.append((pid, names[kind], i1, i2, j1, j2))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    return pairs.select("pair_id", "old", "new").mapInArrow(diff, schema)


def change_counts(changes: DataFrame) -> DataFrame:
    """How many changes of each kind a pair has."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind)
    return changes.groupBy("pair_id").agg(count("added"), count("removed"), count("replaced"))


def first_seen(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Clause keys in the order of their first appearance: by document order, then position."""
    ranked = found.join(documents.select("doc", "doc_order"), "doc").groupBy("clause").agg(
        F.min(F.struct("doc_order", "position")).alias("seen")
    )
    return ranked.select("clause", F.row_number().over(W.orderBy("seen")).alias("rank"))
