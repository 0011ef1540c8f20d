"""Line differences of versions as relations: anchors by aggregation, the longest increasing run of them, gaps again.

1. Lines of both versions are rows (pair_id, side, pos, digest). In a segment, first a whole pair, a line that occurs once
   on each side is an anchor. Where a segment has none, the k-th occurrence of a line meets the k-th on the other side.
2. Of a segment's anchors the longest run that increases on both sides is kept, by patience sorting: the one step that goes
   over a segment's anchors in order.
3. The gaps between anchors are the next round's segments, each strictly smaller, until none has a line in common. Rounds
   are written tables; all segments of all pairs take part in the same round.

Matches are common subsequences, and longest ones where no line repeats within a version. A task that
sorts matches holds those of one pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sinks.tables import written

_ANCHORS = "pair_id long, seg int, old int, new int"


def version_lines(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, pos, line) of (pair_id, old, new): lines that aren't blank, counted from 0. A null text has none."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(F.col(s), F.lit("")).alias("text")) for s in ("old", "new")))
    rows = pairs.select(F.col("pair_id").cast("long"), F.explode(sides).alias("s"))
    kept = F.filter(F.split("s.text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s", " ")) != "")
    # By columns of their own, so that no line's row carries the text.
    listed = rows.select("pair_id", F.col("s.side").alias("side"), kept.alias("lines"))
    return listed.select("pair_id", "side", F.posexplode("lines").alias("pos", "line"))


def longest_run(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Indexes of a longest subsequence in which ``new`` increases, taken in the order of ``old``."""
    order = np.argsort(old, kind="stable")
    tails: list[int] = []
    piles: list[int] = []
    before = np.full(len(order), -1, dtype=np.int64)
    values = new[order].tolist()
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before[i] = piles[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            piles.append(i)
        else:
            tails[at], piles[at] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return order[out[::-1]]


def candidates(lines: DataFrame) -> DataFrame:
    """(pair_id, seg, old, new, once) of lines (pair_id, seg, side, pos, digest) that may be matched in their segment.

    Where lines occur once on both sides only those; else occurrences by number.
    """
    same = W.partitionBy("pair_id", "seg", "side", "digest")
    numbered = lines.withColumn("nth", F.row_number().over(same.orderBy("pos"))).withColumn("n", F.count(F.lit(1)).over(same))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("pos"))).alias(side)
    met = numbered.groupBy("pair_id", "seg", "digest", "nth").agg(at("old"), at("new"), (F.max("n") == 1).alias("once"))
    met = met.filter("old is not null and new is not null")
    sure = met.withColumn("sure", F.bool_or("once").over(W.partitionBy("pair_id", "seg")))
    return sure.filter("once or not sure").select("pair_id", "seg", "old", "new", "once")


def kept_anchors(found: DataFrame) -> DataFrame:
    """The longest increasing run of each pair's candidates, which is that of each of its segments, as those follow one another on both sides.

    Pairs stream past a task in order; it holds one pair's candidates at a time, not a group for each of many small ones.
    """
    names = [c.split()[0] for c in _ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            ids = table["pair_id"].to_numpy()
            turns = np.flatnonzero(np.diff(ids)) + 1
            last = int(turns[-1]) if len(turns) else 0
            rest = table.slice(last)
            if last:
                yield from chosen(table.slice(0, last), np.concatenate(([0], turns[:-1], [last])))
        if rest is not None and rest.num_rows:
            yield from chosen(rest, np.array([0, rest.num_rows]))

    def chosen(table: pa.Table, bounds: np.ndarray) -> list[pa.RecordBatch]:
        old, new = table["old"].to_numpy(), table["new"].to_numpy()
        at = [lo + longest_run(old[lo:hi], new[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
        return table.take(pa.array(np.concatenate(at))).combine_chunks().to_batches()

    return found.select(*names).repartition("pair_id").sortWithinPartitions("pair_id", "old").mapInArrow(run, _ANCHORS)


def matched_lines(lines: DataFrame) -> DataFrame:
    """(pair_id, old, new): positions of lines (pair_id, side, pos, line) that stay, increasing on both sides."""
    digest = F.unhex(F.md5(F.col("line").cast("binary")))
    opened = written(lines.select("pair_id", F.lit(0).alias("seg"), "side", "pos", digest.alias("digest")), "lines")
    found = None
    while True:
        anchors = written(kept_anchors(candidates(opened)), "anchors")
        found = anchors if found is None else found.unionAll(anchors)
        if anchors.isEmpty():
            return found.select("pair_id", "old", "new")
        # A gap is named by the anchor before it; lines of segments without an anchor are done.
        marks = [anchors.select("pair_id", "seg", F.lit(s).alias("side"), F.col(s).alias("pos"), (F.col("old") + 1).alias("mark")) for s in ("old", "new")]
        live = opened.join(anchors.select("pair_id", "seg").distinct(), ["pair_id", "seg"], "left_semi")
        flagged = live.join(marks[0].unionAll(marks[1]), ["pair_id", "seg", "side", "pos"], "left")
        upto = W.partitionBy("pair_id", "seg", "side").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        named = flagged.withColumn("gap", F.coalesce(F.max("mark").over(upto), F.col("seg"))).filter("mark is null")
        opened = written(named.select("pair_id", F.col("gap").alias("seg"), "side", "pos", "digest"), "lines")


def line_changes(pairs: DataFrame) -> DataFrame:
    """(pair_id, kind, old_from, old_to, new_from, new_to): what was added, removed and replaced between (pair_id, old, new).

    Ranges count lines that aren't blank from 0, ends exclusive. Equal versions, two empty or null ones too, have no row; pair_id
    is unique, and null ones are left out, as no two lines of them can be told to belong together.
    """
    lines = written(version_lines(pairs.filter("pair_id is not null")), "version-lines")
    n = lambda side: F.count(F.when(F.col("side") == side, 1)).cast("int").alias(side)
    ends = lines.groupBy("pair_id").agg(n("old"), n("new"))
    kept = matched_lines(lines).unionByName(ends)
    past = W.partitionBy("pair_id").orderBy("old", "new")
    gaps = kept.select(
        "pair_id", (F.coalesce(F.lag("old").over(past), F.lit(-1)) + 1).alias("old_from"), F.col("old").alias("old_to"),
        (F.coalesce(F.lag("new").over(past), F.lit(-1)) + 1).alias("new_from"), F.col("new").alias("new_to"),
    )
    less, more = F.col("old_from") < F.col("old_to"), F.col("new_from") < F.col("new_to")
    kind = F.when(less & more, "replaced").when(less, "removed").when(more, "added")
    return gaps.withColumn("kind", kind).filter("kind is not null").select("pair_id", "kind", "old_from", "old_to", "new_from", "new_to")
