"""Operator 5: exact deduplication by a tree-merge of sorted digest runs.

Every partition digests its texts and makes one sorted run: a row for each distinct digest
with its best row and its count. The runs then meet in binomial rounds: in round r the partitions
whose numbers differ in bit r alone exchange what they hold, each taking the digests whose own
bit r is its own. Each level merges its runs in sorted order, streaming, and keeps of equal digests
the best identifier, verified by a second digest and the length of the text. After the last round
each partition holds a slice of all digests, so no task's share grows with the corpus, and a group
of copies enters a round with one row for each partition that held it.

The cost is log2(partitions) shuffles of at most one row, about 90 bytes, for each distinct digest
of each partition.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, partitions_of, text_batches, utf8

#: The bytes that the comparison ignores: [\x20\x09-\x0D].
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A group of copies is hot from this share of all rows on, so there are at most as many hot groups as its inverse.
HOT_SHARE = 1 / 1000

_RUN = "sha binary, check long, size long, n_chars long, doc_id long, row_id long, n long, node int, home int"
_KEY = ("sha", "check", "size")


def binomial_rounds(parts: int) -> int:
    """The rounds of the binomial exchange: the least r with 2 ** r >= parts."""
    return max(0, parts - 1).bit_length()


def digest_table(docs: DataFrame, nodes: int) -> DataFrame:
    """One row for each document (row_id, doc_id, text) with the digests of its normalised text; written."""
    text_batches(docs.sparkSession)

    def digest(batches):
        for b in batches:
            sha, check, size, home = [], [], [], []
            for t in utf8(b["text"]):
                t = t.translate(None, SPACES)
                d = hashlib.sha256(t).digest()
                sha.append(d)
                check.append(int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True))
                size.append(len(t))
                home.append(int.from_bytes(d[:8], "big") * nodes >> 64)
            n = len(sha)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sha, pa.binary()), pa.array(check, pa.int64()), pa.array(size, pa.int64()),
                    b["n_chars"].cast(pa.int64()), b["doc_id"].cast(pa.int64()), b["row_id"],
                    pa.array(np.ones(n, dtype=np.int64)), b["node"].cast(pa.int32()), pa.array(home, pa.int32()),
                ],
                [c.split()[0] for c in _RUN.split(", ")],
            )

    rows = docs.select(
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        "doc_id",
        "text",
        "row_id",
        (F.spark_partition_id() % nodes).cast("int").alias("node"),
    )
    return materialize(rows.mapInArrow(digest, _RUN), "digests")


def _merged(runs: DataFrame) -> DataFrame:
    """Merge the runs of each partition: of equal digests the best row and the sum of counts."""

    def fold(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            sha = np.frombuffer(b"".join(t["sha"].to_pylist()), dtype=np.uint64).reshape(-1, 4)
            key = np.column_stack([sha, *(t[c].to_numpy().view(np.uint64) for c in ("check", "size"))])
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            n = np.add.reduceat(t["n"].to_numpy(), first)
            out = t.take(first)
            out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(n))
            held = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    best_first = [*(F.col(c) for c in _KEY), F.desc("n_chars"), F.asc_nulls_last("doc_id"), F.col("row_id")]
    return runs.sortWithinPartitions(*best_first).mapInArrow(fold, _RUN)


def _target(r: int) -> Column:
    """The node whose bit r is the digest's and whose other bits are the holder's."""
    return F.col("node").bitwiseXOR(F.col("node").bitwiseXOR(F.col("home")).bitwiseAND(F.lit(1 << r)))


def tree_merge(digests: DataFrame, rounds: int) -> DataFrame:
    """All distinct digests with their best row and count, spread over 2 ** rounds partitions."""
    runs = _merged(digests)
    for r in range(rounds):
        runs = runs.withColumn("node", _target(r)).repartitionById(1 << rounds, F.col("node"))
        runs = _merged(runs)
    return runs if rounds else _merged(runs.coalesce(1))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))


def _verdicts(rows: DataFrame, parts: int) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha, row_id) of each of the rows (row_id, doc_id, text)."""
    rounds = binomial_rounds(parts)
    digests = digest_table(rows, 1 << rounds)
    groups = materialize(tree_merge(digests, rounds).filter("n > 1"), "groups").select(
        *_KEY, F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("n").alias("group_size")
    )
    # The copies of a hot group meet its one row by broadcast, not in one task.
    hot = F.col("group_size") > F.lit(max(1, int(digests.count() * HOT_SHARE)))
    few = F.broadcast(groups.filter(hot))
    found = digests.join(few, list(_KEY)).unionByName(
        digests.join(few, list(_KEY), "left_anti").join(groups.filter(~hot), list(_KEY), "left"), allowMissingColumns=True
    )
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "sha",
        "row_id",
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which rows repeat the text of another, white space aside; a row for each row of ``docs``.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]; null
    counts as empty. Of equal texts the row with the most code points stays, then the smallest
    doc_id (null last), then the first in the input, so of repeated rows exactly one stays.
    Returns doc_id, keep_id, group_size, kept, text_sha256. An empty table gives no rows; columns
    besides doc_id and text are ignored.
    """
    found = _verdicts(_numbered(docs), partitions_of(docs))
    return found.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha", "row_id")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows are numbered once and written so, as another run of the same plan might number them
    otherwise. Columns may have any names.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("row_id", F.monotonically_increasing_id())
    numbered = materialize(plain, "numbered")
    texts = numbered.select(F.col(names[docs.columns.index("doc_id")]).alias("doc_id"), F.col(names[docs.columns.index("text")]).alias("text"), "row_id")
    dropped = _verdicts(texts, partitions_of(numbered)).filter(~F.col("kept")).select("row_id")
    kept = numbered.join(dropped, "row_id", "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
