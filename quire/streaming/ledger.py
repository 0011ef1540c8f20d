"""Ledgers of resource counters: combined, bounded, and chained by digest.

A ledger is an append-only table of attempts. Reservations of a key are decided in order by
running aggregates, so the batch form and the streaming form give the same rows.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def combine(attempts: DataFrame, key: list[str], summed: list[str], peaks: list[str]) -> DataFrame:
    """Element-wise totals of counters: sums, but the maximum of peak counters."""
    return attempts.groupBy(*key).agg(*(F.sum(c).alias(c) for c in summed), *(F.max(c).alias(c) for c in peaks))


def within(counters: list[str], limits: dict[str, int]) -> Column:
    """Whether every counter is at most its limit."""
    ok = F.lit(True)
    for c in counters:
        ok = ok & (F.col(c) <= limits[c])
    return ok


def reserve(attempts: DataFrame, key: list[str], order: str, cost: str, limit: int) -> DataFrame:
    """Decide attempts in order: ``granted`` while the running total, itself included, is within the limit.

    Once an attempt is refused the key is blocked: later ones are refused even if they'd fit, whatever
    their cost. ``running`` is what was granted, as in the streaming form.
    """
    upto = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    asked = attempts.withColumn("__total", F.sum(cost).over(upto))
    decided = asked.withColumn("granted", ~F.bool_or(F.col("__total") > limit).over(upto))
    running = F.coalesce(F.sum(F.when(F.col("granted"), F.col(cost))).over(upto), F.lit(0))
    return decided.withColumn("running", running).drop("__total")


def _linked(key: list[str], revision: str, payload: Column, previous: Column) -> Column:
    """The digest of an entry and of the digest before it."""
    own = (*(F.col(k).cast("string") for k in key), F.col(revision).cast("string"), payload.cast("string"), F.coalesce(previous, F.lit("")))
    return F.sha2(F.concat_ws("|", *own), 256)


def chained(entries: DataFrame, key: list[str], revision: str, payload: Column) -> DataFrame:
    """Each entry with its own digest and that of the entry before it, which its own covers.

    So no entry can be changed without changing all that follow. The first has no previous digest. A
    chain is sequential: a key's entries are folded in one task, and a key is one session's ledger.
    """
    fields = [*entries.schema.fields, *T.StructType.fromDDL("digest string, previous_digest string").fields]
    heads = F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.col(revision).cast("string"), payload.cast("string"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(revision)
        digests, before = [], ""
        for head in table["__head"].to_pylist():
            before = hashlib.sha256(f"{head}|{before}".encode()).hexdigest()
            digests.append(before)
        table = table.drop_columns(["__head"])
        return table.append_column("digest", pa.array(digests, pa.string())).append_column(
            "previous_digest", pa.array([None, *digests[:-1]], pa.string())
        )

    return entries.withColumn("__head", heads).groupBy(*key).applyInArrow(fold, T.StructType(fields))


def broken_chain(entries: DataFrame, key: list[str], revision: str, payload: Column) -> DataFrame:
    """Entries whose revision doesn't follow, whose previous_digest isn't that of the entry before, or whose digest isn't theirs."""
    order = W.partitionBy(*key).orderBy(revision)
    rows = entries.withColumn("__digest", F.lag("digest").over(order)).withColumn("__rev", F.lag(revision).over(order))
    bad = (
        ~F.col("previous_digest").eqNullSafe(F.col("__digest"))
        | (F.col(revision) != F.coalesce(F.col("__rev") + 1, F.col(revision)))
        | (F.col("digest") != _linked(key, revision, payload, F.col("previous_digest")))
    )
    return rows.filter(bad).drop("__digest", "__rev")


def once(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first of chunks that repeat a key: uploads are idempotent."""
    first = W.partitionBy(*key).orderBy(order)
    return chunks.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def catalog_bucket(stamps: DataFrame, column: str, ttl_seconds: int) -> DataFrame:
    """The tumbling bucket that a snapshot is issued in: the time less its remainder by the ttl."""
    epoch = F.unix_micros(F.col(column).cast("timestamp"))
    issued = epoch - F.pmod(epoch, F.lit(ttl_seconds * 1_000_000))
    return stamps.withColumn("issued_us", issued).withColumn("expires_us", issued + ttl_seconds * 1_000_000)


def seal(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Whether the chunks (start, end) of each upload run from 0 without gap or overlap, and their size."""
    past = F.lag("end").over(W.partitionBy(*key).orderBy("start"))
    rows = chunks.withColumn("__follows", F.coalesce(past, F.lit(0)) == F.col("start"))
    return rows.groupBy(*key).agg(F.bool_and("__follows").alias("sealed"), F.max("end").alias("size"))
