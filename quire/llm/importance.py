"""Operator 13: resampling documents towards a target distribution, in Spark SQL alone.

Word n-grams are hashed into buckets by crc32; a bucket's gain is the log-ratio of its smoothed share
in the target and in the corpus. The gains, one row a bucket, are broadcast to the exploded features and
summed by document. Gumbel noise from a digest of the doc_id makes the highest scores a draw without
replacement. Ranks come from one distributed sort: a row's place in its partition and the rows of all before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, partitions_of

#: Buckets are a broadcast table of one row each, so their number is bounded.
MAX_BUCKETS = 1_000_000


@dataclass(frozen=True)
class DrawParams:
    buckets: int = 10_000
    #: Features are runs of 1 to so many words.
    runs: int = 2
    #: Documents of fewer words aren't drawn.
    least_words: int = 20
    percent: int = 25
    seed: int = 7
    scale: int = 1000


def words(text: Column) -> Column:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bucket_lists(rows: DataFrame, p: DrawParams) -> DataFrame:
    """``rows`` (with ``words``) with ``buckets`` in place of the words: those of all runs, repeats included."""

    def bucket(gram: Column) -> Column:
        return (F.crc32(gram.cast("binary")) % p.buckets).cast("int")

    runs = [F.transform("words", bucket)]
    for k in range(2, p.runs + 1):
        # The k-th word on beside each run of k - 1; short ends come out null.
        grams = F.col("words")
        for i in range(1, k):
            later = F.slice(F.col("words"), i + 1, F.greatest(F.size("words"), F.lit(1)))
            grams = F.zip_with(grams, later, lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.transform(F.filter(grams, lambda g: g.isNotNull()), bucket))
    return rows.withColumn("n_words", F.size("words").cast("long")).withColumn("buckets", F.concat(*runs)).drop("words")


def bucket_counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(spark, corpus: DataFrame, target: DataFrame, p: DrawParams) -> DataFrame:
    """(bucket, gain) of every bucket, from written counts of both sides."""
    total = {}
    for name, counts in (("s", corpus), ("t", target)):
        total[name] = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    every = spark.range(p.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    up = (F.coalesce("t", F.lit(0)).cast("double") + 1.0) * F.lit(total["s"] + p.buckets)
    down = (F.coalesce("s", F.lit(0)).cast("double") + 1.0) * F.lit(total["t"] + p.buckets)
    return both.select("bucket", F.floor(F.lit(float(p.scale)) * F.ln(up / down)).cast("long").alias("gain"))


def floored(total: str, n: str) -> Column:
    """Column total / n with floors down, in whole numbers; 0 for n = 0."""
    return F.when(F.col(n) > 0, F.expr(f"({total} - pmod({total}, {n})) div {n}")).otherwise(F.lit(0)).cast("long")


def noise(doc_id: Column, p: DrawParams) -> Column:
    """Gumbel noise from the digest of seed and doc_id; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(p.scale)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in the given total order: a distributed sort and partition offsets."""
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = materialize(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    # One row a partition.
    sizes = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    placed = kept.withColumn("part", part).join(F.broadcast(table), "part")
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "at")


def importance_sample(docs: DataFrame, target: DataFrame, p: DrawParams = DrawParams()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn.

    Null and empty texts have no features, weight 0, and aren't drawn where ``least_words`` is above 0. Rows that repeat a doc_id are
    rows of their own; equal scores go by doc_id, null ones last, then in the order of reading. An empty target has no
    counts, an empty corpus no rows. A text's words and buckets are held by one task. Further columns of either table aren't read.
    """
    if not 0 < p.buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    spark, parts = docs.sparkSession, partitions_of(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    features = materialize(bucket_lists(rows, p), "features")
    counts = materialize(bucket_counts(features), "corpus-buckets")
    wanted = materialize(bucket_counts(bucket_lists(target.select(words(F.col("text")).alias("words")), p)), "target-buckets")
    gains = gain_table(spark, counts, wanted, p)

    exploded = features.select("row", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket"))
    summed = exploded.join(F.broadcast(gains), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total")
    )
    weight = floored("total", "n_features")
    scored = summed.select(
        "row", "doc_id", "n_features", weight.alias("weight"),
        (weight + noise(F.col("doc_id"), p)).alias("score"), (F.col("n_words") >= p.least_words).alias("fit"),
    )
    scored = materialize(scored, "scores")
    drawn = scored.filter("fit").count() * p.percent // 100
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place"))
    return ranked(scored, order, parts).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, p: DrawParams = DrawParams()) -> DataFrame:
    """The drawn doc_ids in order of rank; a join with ``docs`` gives their texts."""
    return importance_sample(docs, target, p).filter("rank is not null").select("doc_id", "rank")
