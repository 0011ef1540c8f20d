"""Operator 9: exact top-k search by inner product with MaxScore over shards.

A component of a vector is a term, and a shard of the vectors holds that term's postings. The
least and the largest value of a term in a shard bound what it adds to a query's score. In a
shard, terms are split by these bounds: the non-essential ones are those of the narrowest bounds
that together can't lift a vector, otherwise at its least, over the query's threshold. Essential
postings are traversed for all vectors of the shard; of the others, only vectors that are still
competitive (score so far plus what the rest can add reaches the threshold) are probed. The
rest is bounded by the terms' bounds and by the product of both sides' remaining norms,
whichever is less. As vectors are dense every posting list holds every vector, so an essential
list is traversed as a column of a matrix, and while most vectors are competitive further terms are too.

The vectors stay where they are: a task streams its partition in shards past one block of
queries, which is broadcast and bounded in bytes, and carries each query's best k and its threshold
from shard to shard. Its best are merged with those of other tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

#: Bytes of the terms of one broadcast block of queries, and its rows, at most about.
QUERY_BYTES, QUERY_ROWS = 16 << 20, 1 << 15
#: Vectors in a shard and queries scored at once; the first shard of a task is smaller, for a first threshold.
SHARD_ROWS, QUERIES_AT_ONCE, FIRST_ROWS = 2048, 512, 128
#: Terms that are probed at once, and the share of competitive vectors up to which they are probed one by one.
PROBE_TERMS, SPARSE = 16, 1 / 32
#: Tasks whose hits are merged at once.
MERGE = 256


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component; only whole, finite vectors with an id."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter("vec_id is not null")
    return usable.filter(F.coalesce(whole, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("terms")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Terms as rows; missing ones are 0, and those beyond ``width``, which meet none, are left out."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(column)), lengths)
    fits = place < width
    out[owner[fits], place[fits]] = flat[fits]
    return out


def exact_kind(rows: np.ndarray, largest: int) -> type:
    """Products of doubles are exact, and fast, while every sum stays below 2**53."""
    top = max(largest, int(np.abs(rows).max(initial=0)))
    return np.float64 if top * top * max(1, rows.shape[1]) < 1 << 53 else np.int64


class Best:
    """The best ``k`` hits of each of ``m`` queries so far, ties to the smaller id."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.query, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))
        self.threshold = np.full(m, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        held = np.isin(self.query, query)
        q, s, v = (np.concatenate([a[held], b.astype(np.int64)]) for a, b in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.threshold[q[last]] = s[last]
        self.query, self.score, self.ids = (
            np.concatenate([a[~held], b[keep]]) for a, b in ((self.query, q), (self.score, s), (self.ids, v))
        )


def split_terms(queries: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, int]:
    """The terms, widest bounds first, and how many of them are essential to some query."""
    a, b = queries * low, queries * high
    span, least = np.abs(b - a), np.minimum(a, b).sum(axis=1)
    order = np.argsort(-span.sum(axis=0, dtype=np.float64), kind="stable")
    # What the terms from place t on can add at most, in order.
    rest = np.cumsum(span[:, order][:, ::-1], axis=1)[:, ::-1]
    essential = (least[:, None] + rest >= threshold[:, None]).sum(axis=1)
    return order, int(essential.max(initial=0))


def search_shard(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, at: np.ndarray, best: Best) -> int:
    """Add a shard's hits of some queries, numbered ``at``, to ``best``; how many vectors were still competitive at the end."""
    low, high = rows.min(axis=0), rows.max(axis=0)
    threshold = best.threshold[at]
    order, t = split_terms(queries, low, high, threshold)
    rows, queries, low, high = rows[:, order], queries[:, order], low[order], high[order]
    most = np.maximum(queries * low, queries * high).astype(np.float64)
    rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))], axis=1)
    width = rows.shape[1]

    def norms(x: np.ndarray) -> np.ndarray:
        return np.sqrt((x[:, t:].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)

    score = rows[:, :t] @ queries[:, :t].T
    while True:
        bound = np.minimum(rest[:, t][None, :], norms(rows)[:, None] * norms(queries)[None, :]) if t < width else 0
        v, q = np.nonzero(score + bound >= threshold[None, :])
        if t == width or len(v) <= SPARSE * score.size:
            break
        upto = min(width, t + PROBE_TERMS)
        score += rows[:, t:upto] @ queries[:, t:upto].T
        t = upto
    found = score[v, q]
    while t < width and len(v):
        upto = min(width, t + PROBE_TERMS)
        found = found + (rows[v, t:upto] * queries[q, t:upto]).sum(axis=1)
        t = upto
        live = found + np.minimum(rest[q, t], norms(rows)[v] * norms(queries)[q]) >= threshold[q]
        v, q, found = v[live], q[live], found[live]
    best.add(at[q], found, ids[v])
    return len(v)


_HITS = "query long, query_id long, own long, vec_id long, score long"


def _block_hits(vectors: DataFrame, asked: pa.Table, base: int, k: int) -> DataFrame:
    """The best ``k`` vectors of each partition for each query of a block."""
    width = max(1, int(asked["terms"].combine_chunks().value_lengths().to_numpy().max(initial=0)))
    wanted = _matrix(asked["terms"].combine_chunks(), width)
    own = (wanted * wanted).sum(axis=1)
    shared = vectors.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), wanted, own))

    def search(batches):
        query_ids, wanted, own = shared.value
        best, largest, limit = Best(len(wanted), k), int(np.abs(wanted).max(initial=0)), FIRST_ROWS
        as_doubles = wanted.astype(np.float64)
        for b in batches:
            low = 0
            while low < b.num_rows:
                some = b.slice(low, limit)
                low, limit = low + limit, SHARD_ROWS
                ids, rows = some["vec_id"].to_numpy(), _matrix(some["terms"], width)
                kind = exact_kind(rows, largest)
                rows, queries = rows.astype(kind), as_doubles if kind is np.float64 else wanted
                for a in range(0, len(queries), QUERIES_AT_ONCE):
                    z = min(len(queries), a + QUERIES_AT_ONCE)
                    search_shard(ids, rows, queries[a:z], np.arange(a, z), best)
        q = best.query
        for a in range(0, len(q), 1 << 16):
            some = q[a : a + (1 << 16)]
            cols = (some + base, query_ids[some], own[some], best.ids[a : a + (1 << 16)], best.score[a : a + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in _HITS.split(", ")])

    return vectors.mapInArrow(search, _HITS)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of each query with every vector but its own row.

    Both sides are (vec_id, terms) as ``quantise`` gives them, and a query's own row is one that
    equals it. Returns query_id, rank from 1, vec_id and score, ties to the smaller vec_id; a query
    with fewer candidates has all of them, and with none no row. Missing components of shorter
    vectors count as 0. Rows that repeat a vec_id are all candidates, and queries each with ranks
    of its own. No vectors give no rows.
    """
    spark = vectors.sparkSession
    # One more than k is kept, as the query's own row may be among them.
    vectors = vectors.select("vec_id", "terms")
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size("terms"))).first()
    blocks = max(1, -(-n * 8 * (size or 1) // QUERY_BYTES), -(-n // QUERY_ROWS))
    number = F.pmod(F.xxhash64("vec_id", "terms"), F.lit(blocks))
    hits = None
    for block in range(blocks):
        asked = queries.select("vec_id", "terms").filter(number == block).toArrow()
        if not asked.num_rows:
            continue
        found = _block_hits(vectors, asked, block << 32, k + 1)
        if blocks > 1:
            found = materialize(found, "hits")
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keys = ["query", "query_id", "own"]
    hits = hits.select(*keys, F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")).alias("hit"))
    best = F.slice(F.sort_array(F.collect_list("hit")), 1, int(k) + 1)
    # Where a query has hits of many tasks, groups of them are merged first: no list exceeds
    # about MERGE * (k + 1).
    groups = -(-vectors.rdd.getNumPartitions() // MERGE)
    while groups > 1:
        part = F.pmod(F.xxhash64(F.lit(groups), F.col("hit.v")), F.lit(groups))
        hits = hits.groupBy(*keys, part.alias("part")).agg(best.alias("hits"))
        hits = hits.select(*keys, F.explode("hits").alias("hit"))
        groups = groups // MERGE
    own = F.struct((-F.col("own")).alias("s"), F.col("query_id").alias("v"))
    merged = hits.groupBy(*keys).agg(best.alias("best"))
    merged = merged.withColumn("self", F.array_position("best", own)).withColumn(
        "best", F.slice(F.filter("best", lambda x, i: i + 1 != F.col("self")), 1, int(k))
    )
    return merged.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


def top_k_of_sample(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """Search all vectors for each whose vec_id is divisible by ``every``; columns besides vec_id and embedding are ignored."""
    usable = quantise(vectors, scale)
    return top_k(usable, usable.filter(F.col("vec_id") % every == 0), k)
