"""The stateful stream of reservations against the batch form."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming.reservations import reserve_batch, reserve_stream

SCHEMA = "session string, seq long, request_id string, cost long, ts timestamp"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, name, **options):
    """Feed the batches one after another and return what each of them gave."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{i:03}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = reserve_stream(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    try:
        query.processAllAvailable()
        batches_run = query.lastProgress["batchId"]
    finally:
        query.stop()
    return spark.table(name).collect(), batches_run


def plain(rows):
    return sorted((r.session, r.seq, r.request_id, r.cost, r.running, r.status) for r in rows)


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, n, f"{s}{n}", rng.randint(0, 9), at(n)) for s in "abc" for n in range(1, 25)]
    want = plain(reserve_batch(spark.createDataFrame(rows, SCHEMA), 60).collect())
    rng.shuffle(rows)
    again = [rows[3], rows[7]]  # answered before, as they come in the last batch
    got, n = run(spark, tmp_path, [rows[:30], rows[30:60], rows[60:], again], "shuffled", limit=60)
    assert plain(r for r in got if r.status != "replayed") == want and {r[5] for r in want} == {"granted", "refused"}
    answers = {r[2]: r[4] for r in want}
    assert [(r.request_id, r.running) for r in sorted(got) if r.status == "replayed"] == sorted((r[2], answers[r[2]]) for r in again)
    assert n <= 8  # no batches for their own sake


def test_gaps_late_rows_and_idle_sessions(spark, tmp_path):
    batches = [
        [("s", 1, "a", 1, at(0)), ("s", 3, "c", 1, at(1)), ("s", 3, "x", 1, at(1)), ("s", 3, "c", 1, at(1)), ("s", None, "n", 1, at(1)), ("s", 9, None, 1, at(1)), ("s", 9, "m", -1, at(1))],
        [("t", 1, "a", 1, at(2000))],  # the watermark passes the gap's patience
        [("s", 2, "b", 1, at(2001)), ("s", 4, "d", 1, at(2002))],
        [("t", 2, "b", 1, at(20_000))],  # and then the idle time
        [("s", 1, "a", 1, at(20_001))],
        [("t", 3, "c", 1, at(20_002))],
    ]
    got, _ = run(spark, tmp_path, batches, "gaps", limit=10, wait=60, idle=3600, late="10 seconds")
    s = sorted((r.seq or 0, r.request_id or "", r.status, r.running) for r in got if r.session == "s")
    assert s == sorted([
        (1, "a", "granted", 1), (3, "x", "conflict", 1), (3, "c", "pending", 1), (0, "n", "invalid", 1), (9, "", "invalid", 1), (9, "m", "invalid", 1),
        (3, "c", "granted", 2), (2, "b", "late", 2), (4, "d", "granted", 3),
        (1, "a", "granted", 1),  # a new session by that name
    ])
    assert [(r.seq, r.status) for r in got if r.session == "t"] == [(1, "granted"), (2, "granted"), (3, "granted")]


def test_batch_answers_replays(spark):
    rows = [("s", 1, "a", 5, at(0)), ("s", 1, "a", 5, at(9)), ("s", 2, "b", 6, at(1)), ("s", 3, "c", 1, at(2))]
    got = plain(reserve_batch(spark.createDataFrame(rows, SCHEMA), 10).collect())
    assert got == [("s", 1, "a", 5, 5, "granted"), ("s", 1, "a", 5, 5, "replayed"), ("s", 2, "b", 6, 5, "refused"), ("s", 3, "c", 1, 5, "refused")]
    assert reserve_batch(spark.createDataFrame([], SCHEMA), 10).count() == 0


@pytest.mark.parametrize("limit", [0, 7])
def test_a_restart_goes_on(spark, tmp_path, limit):
    """State survives the query: a second run over the same checkpoint knows what was granted."""
    out = str(tmp_path / "out")
    got = []
    for i, rows in enumerate([[("s", 1, "a", 4, at(0))], [("s", 2, "b", 4, at(1)), ("s", 1, "a", 4, at(2))]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = reserve_stream(stream, limit).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        query.stop()
        got.append(plain(spark.read.parquet(out).filter(F.col("seq") == i + 1).collect()))
    first = "granted" if limit else "refused"
    assert got[0] == [("s", 1, "a", 4, 4 if limit else 0, first)]
    assert got[1] == [("s", 2, "b", 4, 4 if limit else 0, "refused")]
    assert plain(spark.read.parquet(out).filter("status = 'replayed'").collect()) == [("s", 1, "a", 4, 4 if limit else 0, "replayed")]


class Store:
    """State in memory that counts its calls."""

    def __init__(self):
        self.calls, self.now = 0, {}

    def get_state(self, name, *schemas):
        store = self

        class State:
            def __getattr__(self, call):
                def run(*args):
                    store.calls += 1
                    held = store.now.setdefault(name, {} if len(schemas) > 1 else [])
                    if call == "exists":
                        return bool(held)
                    if call == "get":
                        return (held[0] if held else None) if name == "head" else iter(list(held))
                    if call == "getValue":
                        return held.get(args[0])
                    if call == "updateValue":
                        held[args[0]] = args[1]
                    elif call == "removeKey":
                        held.pop(args[0], None)
                    elif call == "iterator":
                        return iter(list(held.items()))
                    elif call == "clear":
                        held.clear()
                    else:
                        held[:] = held + args[0] if call == "appendList" else [args[0]] if call == "update" else args[0]

                return run

        return State()

    getValueState = getListState = getMapState = get_state

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_calls_to_the_state_store_follow_batches_not_rows():
    from pyspark.sql import Row

    from quire.streaming.reservations import Reserver

    rng, store = random.Random(7), Store()
    reserver = Reserver(10_000, 1, 600_000, 86_400_000)
    reserver.init(store)
    rows = [Row(session="s", seq=n, request_id=f"r{n}", cost=1, ts=at(n)) for n in range(1, 801)]
    rng.shuffle(rows)
    got = [x for k in range(0, 800, 200) for x in reserver.handleInputRows(("s",), iter(rows[k : k + 200]), Clock())]
    assert sorted((x.seq, x.running, x.status) for x in got) == [(n, n, "granted") for n in range(1, 801)]
    assert store.calls <= 40
    # Small batches of a long session: its log is moved once, and then each row is looked up.
    for again in (rows[3:5], rows[90:91]):
        got = list(reserver.handleInputRows(("s",), iter(again), Clock()))
        assert sorted((x.seq, x.running, x.status) for x in got) == sorted((r.seq, r.seq, "replayed") for r in again)
    assert store.calls <= 900
    before = store.calls
    list(reserver.handleInputRows(("s",), iter([Row(session="s", seq=801, request_id="r801", cost=1, ts=at(801))]), Clock()))
    assert store.calls - before <= 8
