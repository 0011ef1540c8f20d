"""Line differences as relations against brute force."""

import time
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from quire.operators.linediff import line_changes, longest_run, matched_lines, version_lines

SCHEMA = "pair_id long, old string, new string"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def split(text):
    return [x for x in (text or "").split("\n") if x.strip()]


def random_pairs(n=120):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        vocab = [f"line {x}" for x in range(int(rng.integers(1, 40)))]
        old = [str(x) for x in rng.choice(vocab, int(rng.integers(0, 30)))]
        new = list(old)
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(new) + 1))
            new[at : at + int(rng.integers(0, 3))] = [str(x) for x in rng.choice(vocab, int(rng.integers(0, 3)))]
        if i % 5 == 0:
            rng.shuffle(new)
        if i % 3 == 0:  # no line repeats within a version
            old, new = list(dict.fromkeys(old)), list(dict.fromkeys(new))
        rows.append((i, "\n".join(old), "\n\n  \n".join(new)))
    return rows


def test_changes_rebuild_the_new_version(spark):
    rows = random_pairs()
    pairs = spark.createDataFrame(rows, SCHEMA)
    changes = {}
    for r in line_changes(pairs).collect():
        changes.setdefault(r.pair_id, []).append(r)
    kept = {}
    for r in matched_lines(version_lines(pairs)).collect():
        kept.setdefault(r.pair_id, []).append((r.old, r.new))
    matched = possible = 0
    for pid, old, new in rows:
        a, b, out, at = split(old), split(new), [], 0
        for c in sorted(changes.get(pid, []), key=lambda c: (c.old_from, c.new_from)):
            out += a[at : c.old_from] + b[c.new_from : c.new_to]
            at = c.old_to
            assert (c.kind == "added") == (c.old_from == c.old_to) and (c.kind == "removed") == (c.new_from == c.new_to)
        assert out + a[at:] == b, pid
        matches = sorted(kept.get(pid, []))
        assert all(a[i] == b[j] for i, j in matches)
        assert all(x < y and u < v for (x, u), (y, v) in zip(matches, matches[1:]))
        longest = lcs(a, b)
        assert len(matches) <= longest and bool(matches) == bool(longest)
        if pid % 3 == 0:
            assert len(matches) == longest
        matched, possible = matched + len(matches), possible + longest
    assert matched >= 0.8 * possible


def test_changes_equal_the_standard_matcher_where_lines_differ(spark):
    rows = []
    for i in range(40):
        old = [f"{i}:{j}" for j in range(50)]
        new = [x if j % 9 else f"edited {x}" for j, x in enumerate(old) if j % 7]
        new.insert(i, "inserted")
        rows.append((i, "\n".join(old), "\n".join(new)))
    names = {"insert": "added", "delete": "removed", "replace": "replaced"}
    want = {
        (pid, names[kind], *at)
        for pid, old, new in rows
        for kind, *at in SequenceMatcher(None, old.split("\n"), new.split("\n"), autojunk=False).get_opcodes()
        if kind != "equal"
    }
    assert {tuple(r) for r in line_changes(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_odd_versions(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "a\n \n", None), (4, "same\nsame\nsame", "same\nsame"), (5, "x", "x"), (None, "a", "b"), (6, "a\r\nb", "a\r\nc"), (7, " \nb", "b")]
    got = {tuple(r) for r in line_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "added", 0, 0, 0, 1), (3, "removed", 0, 1, 0, 0), (4, "removed", 2, 3, 2, 2), (6, "replaced", 1, 2, 1, 2)}
    assert line_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_pair(spark):
    """200,000 lines with edits, a moved block and lines that repeat."""
    old = F.expr("array_join(transform(sequence(0, 199999), i -> if(i % 10 = 0, 'end', concat('line ', i))), '\n')")
    new = F.expr("array_join(transform(filter(sequence(0, 199999), i -> i % 1000 <> 1), i -> if(i % 1000 = 2, 'new', if(i % 10 = 0, 'end', concat('line ', i)))), '\n')")
    began = time.time()
    got = line_changes(spark.range(1).select(F.lit(1).cast("long").alias("pair_id"), old.alias("old"), new.alias("new"))).collect()
    assert {(r.kind, r.old_to - r.old_from, r.new_to - r.new_from) for r in got} == {("replaced", 2, 1)} and len(got) == 200
    assert time.time() - began < 120


def test_longest_run():
    rng = np.random.default_rng(1)
    for _ in range(200):
        new = rng.permutation(int(rng.integers(0, 9)))
        old = rng.permutation(len(new))
        at = longest_run(old, new)
        assert (np.diff(old[at]) > 0).all() and (np.diff(new[at]) > 0).all()
        order = np.argsort(old)
        assert len(at) == lcs(list(new[order]), list(range(len(new))))
