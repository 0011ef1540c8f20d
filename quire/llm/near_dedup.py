"""Operator 8: near-duplicates by one-permutation MinHash with optimal densification.

1. One pass over the texts gives each document the size and a digest of its set of word
   shingles, and the bucket of each band. The signature hashes every shingle once, cuts the
   range of hashes into bins and keeps the smallest of each bin; an empty bin borrows from the
   first bin with a shingle along its own fixed random order of all bins.
2. Documents with equal sets form a class, and the class's smallest doc_id represents it.
3. In every bucket the smallest representative is the centre of a star: k members give k - 1
   candidate edges, which are verified on full sets, a centre with a bounded block of its members
   at a time. Their components are most of the result: a group of near copies falls together.
4. What a star leaves open is a bucket whose members are still in several components. The members outside
   the largest of them meet each other and those in it, in blocks of bounded size, each pair of blocks in one group
   of rows, and are intersected exactly; buckets of the same members count once. So every pair of documents that
   share a bucket is verified, or already connected, and no link is lost to the choice of a centre.
5. The components of all links are the classes of near-duplicates.

Copies of sets that are moved: one for each distinct edge of a star, and about k * ceil(m / block_docs) + m * ceil(k / block_docs)
for a bucket of k members that is left open by m; members that only chains of buckets connect never meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LONG_WORD, materialize, mix64, partitions_of, text_batches, utf8
from quire.llm.components import components
from quire.llm.words import Words, chunks, tokens_of


@dataclass(frozen=True)
class NearParams:
    """``words`` in a shingle; link from ``percent`` of the union; ``bands`` of ``rows`` bins.

    A pair of similarity s shares no band with probability (1 - s**rows) ** bands: at the
    defaults 2e-7 for s = 0.85 and 2e-6 for 0.8 with ``FIVE_WORDS``. ``block_docs`` and ``block_shingles``
    bound what one side of a group of rows holds.
    """

    words: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 7
    block_docs: int = 128
    block_shingles: int = 500_000


#: For stages without a contract of their own: five words, similarity 0.8.
FIVE_WORDS = NearParams(words=5, percent=80, bands=44, rows=6)


#: Bytes of texts whose words are hashed at once.
_TEXT_BYTES = 1 << 20


def _keys(words: Words) -> np.ndarray:
    keys = words.keys()
    # Long words of a made-up kind can share a polynomial.
    for i in np.flatnonzero(words.sizes > LONG_WORD).tolist():
        at = int(words.starts[i])
        keys[i] = xxhash.xxh3_64_intdigest(words.flat[at : at + int(words.sizes[i])].tobytes())
    return keys


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; empty without words.

    A-Z are lower-cased and words are [^\\x20\\x09-\\x0D]+; a text with fewer words than a
    shingle has its whole sequence as its one shingle.
    """
    out = []
    for low, high in chunks(texts, _TEXT_BYTES):
        tokens, sizes = tokens_of(texts[low:high])
        h = _keys(tokens)
        every = _rolled(h, words)
        ends = np.cumsum(sizes) - 1  # where each text's end stands, which is no word
        for end, n in zip(ends.tolist(), (sizes - 1).tolist()):
            # Windows of this text's words alone, none over its end.
            own = every[end - n : end - words + 1] if n >= words else _rolled(h[end - n : end], n)
            own = np.sort(own)
            out.append(own[np.diff(own, prepend=~own[:1]) != 0])
    return out


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words; none without words."""
    n = max(0, len(h) - k + 1) if k else 0
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return total


@lru_cache(maxsize=4)
def _tables(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which each bin probes all bins, and the factors of a band's hash."""
    bins = bands * rows
    at = np.arange(bins * bins, dtype=np.uint64)
    probe = (mix64(at + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32).reshape(bins, bins)
    factors = mix64(np.arange(1, bins + 1, dtype=np.uint64)) | np.uint64(1)
    return probe.argsort(axis=1, kind="stable"), factors.reshape(bands, rows)


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each band for a sorted set of hashes."""
    return all_band_hashes([shingles], bands, rows)[0]


def all_band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of the buckets of each band for each sorted set of hashes, none of them empty."""
    order, factors = _tables(bands, rows)
    bins = bands * rows
    shingles = np.concatenate([np.empty(0, np.uint64), *sets])
    of = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    of += np.repeat(np.arange(len(sets)) * bins, np.array([len(s) for s in sets], dtype=np.int64))
    first = np.flatnonzero(np.diff(of, prepend=-1))
    values, filled = np.zeros((len(sets), bins), dtype=np.uint64), np.zeros((len(sets), bins), dtype=bool)
    values.ravel()[of[first]] = shingles[first]
    filled.ravel()[of[first]] = True
    doc, empty = np.nonzero(~filled)
    for turn in range(bins):
        if not len(doc):
            break
        lender = order[empty, turn]
        lends = filled[doc, lender]
        values[doc[lends], empty[lends]] = values[doc[lends], lender[lends]]
        doc, empty = doc[~lends], empty[~lends]
    return mix64((values.reshape(-1, bands, rows) * factors).sum(axis=2, dtype=np.uint64) + factors[:, 0])


_SIGNED = "doc_id long, n_shingles long, sig binary, bands array<long>"


def signatures(docs: DataFrame, p: NearParams) -> DataFrame:
    """Size, digest and buckets of each document's set; written. An empty set has a digest of its own."""
    text_batches(docs.sparkSession)

    def sign(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes, sigs = [], []
            sets = shingle_sets(utf8(b["text"]), p.words)
            for s in sets:
                row += 1
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes() if len(s) else b"empty %d %d" % (part, row)))
            bands = all_band_hashes([s for s in sets if len(s)], p.bands, p.rows).view(np.int64).ravel()
            ends = np.cumsum([0, *(p.bands if n else 0 for n in sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands, pa.int64())),
                ],
                ["doc_id", "n_shingles", "sig", "bands"],
            )

    return materialize(docs.select("doc_id", "text").mapInArrow(sign, _SIGNED), "signatures")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, rep, n_shingles, centre) of all buckets with two members and more; the centre is the smallest."""
    members = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n"))
    return members.join(stars.filter("n > 1").select("bucket", "centre").hint("merge"), "bucket")


def _block_of(n: str, shingles: str, p: NearParams):
    """How many blocks hold so many members with so many shingles."""
    return F.greatest(F.ceil(F.col(n) / p.block_docs), F.ceil(F.col(shingles) / p.block_shingles), F.lit(1)).cast("int")


def star_groups(members: DataFrame, p: NearParams) -> DataFrame:
    """(group, i, j, rep, label): each star's members in blocks, its centre in every block; each is its own label."""
    edges = members.filter("rep <> centre").select("centre", "rep", "n_shingles").distinct()
    sizes = edges.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.select("centre", _block_of("n", "shingles", p).alias("blocks"))
    own = edges.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("i"), "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    centres = sizes.select("centre", every).withColumn("rep", F.col("centre"))
    rows = own.unionByName(centres)
    return rows.select(F.col("centre").alias("group"), "i", F.col("i").alias("j"), "rep", F.col("rep").alias("label"))


def open_groups(members: DataFrame, links: DataFrame, p: NearParams) -> DataFrame:
    """(group, i, j, rep, label): the members of buckets that the links (v, label) don't connect, in pairs of blocks.

    In a bucket the members of its largest component needn't meet each other: what must meet are the others, among themselves
    and with them. Blocks of the others are numbered from 0; ``j`` is a block of the largest component, or -1 less another's.
    """
    held = members.select("bucket", "rep", "n_shingles").join(links.withColumnRenamed("v", "rep"), "rep", "left")
    held = held.withColumn("label", F.coalesce("label", "rep"))
    parts = held.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("a"),
        F.sum(F.xxhash64(F.lit(7), "rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("b"),
        F.min("rep").alias("least"),
    )
    found = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("labels"),
        F.max(F.struct("n", "shingles", "label")).alias("most"),
        *(F.sum(c).alias(c) for c in ("n", "shingles", "a", "b")),
        F.min("least").alias("least"),
    )
    # Buckets of the same members, told by their number, least one and two sums of hashes, are one group.
    once = found.filter("labels > 1").groupBy("n", "a", "b", "least").agg(
        F.min("bucket").alias("bucket"), F.first("shingles").alias("shingles"), F.first("most").alias("most")
    )
    sizes = once.select("bucket", F.col("most.label").alias("main"), "most.n", "most.shingles", (F.col("n") - F.col("most.n")).alias("few"), (F.col("shingles") - F.col("most.shingles")).alias("few_shingles"))
    sizes = sizes.select("bucket", "main", _block_of("n", "shingles", p).alias("wide"), _block_of("few", "few_shingles", p).alias("narrow"))
    rows = held.select("bucket", "rep", "label").join(sizes.hint("merge"), "bucket")
    inner = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("rep"), F.when(inner, F.col("wide")).otherwise(F.col("narrow"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(upto(F.col("wide")), lambda j: F.struct(own.alias("i"), j.alias("j")))
    with_others = F.transform(upto(F.col("narrow")), lambda k: F.struct(F.least(own, k).alias("i"), (F.lit(-1) - F.greatest(own, k)).alias("j")))
    meets = F.when(inner, F.transform(upto(F.col("narrow")), lambda i: F.struct(i.alias("i"), own.alias("j")))).otherwise(F.concat(with_main, with_others))
    return rows.select(F.col("bucket").alias("group"), "rep", "label", F.explode(meets).alias("m")).select("group", "m.i", "m.j", "rep", "label")


#: Bits of the table that keeps most texts without candidates out of the second pass: so many for each member, within bounds.
_BITS_EACH, _LEAST_BITS, _MOST_BITS = 16, 1 << 16, 1 << 27


def _slot(doc_id: str, slots: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(slots))


def _slot_table(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each member's doc_id: 16 MB and 2**21 rows at most. Beyond that bound more texts pass, all of them needlessly."""
    slots = min(_MOST_BITS, max(_LEAST_BITS, 1 << (_BITS_EACH * ids.count()).bit_length()))
    words = ids.select(_slot("rep", slots).alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")
    )
    rows = words.toPandas()
    table = np.zeros(slots // 64, dtype=np.uint64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _member_sets(docs: DataFrame, reps: DataFrame, p: NearParams) -> DataFrame:
    """(rep, shingles): the full sets of the representatives (rep, sig), from a second pass over the texts; written.

    The table of bits lets through every member and, by chance, few others; the join is exact.
    Sets are shuffled, texts are not.
    """
    spark = docs.sparkSession
    bits = _slot_table(reps)
    table = spark.sparkContext.broadcast(bits)

    def build(batches):
        bits = table.value
        for b in batches:
            slot = b["slot"].to_numpy()
            hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            b = b.filter(pa.array(hit))
            if b.num_rows:
                sets = [s.tobytes() for s in shingle_sets(utf8(b["text"]), p.words)]
                sigs = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["rep", "sig", "shingles"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sets = rows.withColumn("slot", _slot("doc_id", 64 * len(bits))).mapInArrow(build, "rep long, sig binary, shingles binary")
    # Rows that repeat a representative have one set.
    own = sets.join(reps.hint("merge"), ["rep", "sig"]).groupBy("rep").agg(F.first("shingles").alias("shingles"))
    return materialize(own, "sets")


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some documents: each with the smallest it reaches.

    Documents with one id are connected already; no edge is given for what connects them.
    """
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    k = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(k), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    inter = np.zeros((k, k), dtype=np.float64)
    if len(column):
        values, column = np.unique(column, return_inverse=True)
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        step = 4096
        for low in range(0, len(values), step):
            a, z = np.searchsorted(column, [low, low + step])
            m = np.zeros((k, min(step, len(values) - low)), dtype=np.float32)
            m[owner[a:z], column[a:z] - low] = 1
            inter += m @ m.T
    link = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    own = np.array(ids)
    link |= own[:, None] == own[None, :]
    label = np.arange(k)
    while True:
        least = np.where(link, label[None, :], k).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return sorted({(ids[i], ids[j]) for i, j in enumerate(label.tolist()) if ids[i] != ids[j]})
        label = least


def verified_links(groups: DataFrame, sets: DataFrame, p: NearParams, parts: int) -> DataFrame:
    """(a, b): links between labels, confirmed on full sets, a spanning forest of each (group, i, j); written."""
    keyed = groups.join(sets.hint("merge"), "rep").drop("rep")

    def verify(batches):
        key, ids, held, found = None, [], [], []

        def close():
            if len(ids) > 1:
                found.extend(linked(ids, held, p.percent))

        def flush():
            pairs, found[:] = found[:], []
            a, b = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = (batch[c].to_pylist() for c in ("group", "i", "j", "label", "shingles"))
            for group, i, j, doc, s in zip(*cols):
                if (group, i, j) != key:
                    close()
                    key, ids, held = (group, i, j), [], []
                ids.append(doc)
                held.append(np.frombuffer(s, dtype=np.uint64))
            if len(found) > 10_000:
                yield flush()
        close()
        if found:
            yield flush()

    dealt = keyed.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return materialize(dealt.mapInArrow(verify, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable and ``kept`` marks it. Null or blank text has
    an empty set and is linked with nothing; a null doc_id keeps a null component_id and stays.
    Equal rows share a component. Columns besides doc_id and text are ignored.
    """
    parts = partitions_of(docs)
    signed = signatures(docs, p)
    classes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "classes",
    )
    members = materialize(bucket_members(classes), "members")
    reps = classes.select("rep", "sig").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = _member_sets(docs, reps, p)
    edges = verified_links(star_groups(members, p), sets, p, parts)
    left = open_groups(members, components(edges), p)
    links = components(edges.unionAll(verified_links(left, sets, p, parts)))
    found = classes.select("sig", "rep").join(links.withColumnRenamed("v", "rep"), "rep", "left")
    found = found.select("sig", F.coalesce("label", "rep").alias("component_id"))
    return signed.drop("bands").join(found, "sig", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, p: NearParams = FIVE_WORDS) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the smallest doc_id.

    The doc_id names a document: rows that repeat under one doc_id share its verdict, and rows
    without one stay.
    """
    verdict = near_duplicates(docs, p)
    dropped = verdict.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
