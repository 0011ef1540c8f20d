"""Reservations of a session's budget as a stream, decided in the order of their numbers.

State is kept in parts that are read and written by themselves: a head of a few numbers, the requests that wait for
one before them, and each request's answer. A call to the state store costs more than a row, so what waits is read and
written in one call each, and new answers go to a log in one call, which a batch reads whole. A log that is long for a
batch is moved to a map first, an answer once, where requests are looked up. So a row costs the same however long its
session is. Event-time timers
release what waits for a number that never comes, and drop a session that was idle; no batch runs without data or a
later watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.streaming import ledger

DECIDED = "session string, seq long, request_id string, cost long, running long, status string"
#: A log is read by a batch where it has at most so many answers for each row.
LOGGED_A_ROW = 16
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = Row(*(c.split()[0] for c in DECIDED.split(", ")))


class Reserver(StatefulProcessor):
    """Decides the requests of one session. See ``reserve_stream``."""

    def __init__(self, limit: int, first: int, wait_ms: int, idle_ms: int):
        self.limit, self.first, self.wait_ms, self.idle_ms = limit, first, wait_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next_seq long, granted long, blocked boolean, last_ms long, timer_ms long, logged long, kept long")
        self.waiting = handle.getListState("waiting", "seq long, request_id string, cost long")
        self.log = handle.getListState("log", "request_id string, seq long, cost long, running long, status string")
        self.answers = handle.getMapState("answers", "request_id string", "seq long, cost long, running long, status string")

    def _held(self) -> list:
        return list(self.head.get() or (self.first, 0, False, 0, 0, 0, 0))

    def _waiting(self) -> dict[int, tuple[str, int]]:
        """All that waits, read at once."""
        return {seq: (request, cost) for seq, request, cost in self.waiting.get()}

    def _logged(self, held: list, rows: int) -> dict[str, int]:
        """What was granted up to each answer of the log, which is moved where it is long for so many rows."""
        if not held[5]:
            return {}
        if held[5] <= LOGGED_A_ROW * rows:
            return {x[0]: x[3] for x in self.log.get()}
        for request, *answer in self.log.get():
            self.answers.updateValue((request,), tuple(answer))
        self.log.clear()
        held[5], held[6] = 0, held[6] + held[5]
        return {}

    def _append(self, held: list, new: list[tuple]) -> None:
        if new:
            self.log.appendList(new)
            held[5] += len(new)

    def _decide(self, session: str, held: list, new: list[tuple], seq: int, request: str, cost: int) -> Row:
        held[0] = seq + 1
        if held[2] or held[1] + cost > self.limit:
            status, held[2] = "refused", True
        else:
            status, held[1] = "granted", held[1] + cost
        new.append((request, seq, cost, held[1], status))
        return _OUT(session, seq, request, cost, held[1], status)

    def _wake(self, held: list, waits: bool) -> None:
        """One timer a session: for a gap while something waits, else for idleness."""
        if held[4]:
            self.handle.deleteTimer(held[4])
        held[4] = held[3] + (self.wait_ms if waits else self.idle_ms)
        self.handle.registerTimer(held[4])
        self.head.update(tuple(held))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session, held = key[0], self._held()
        # What is due by the watermark comes before rows that arrive with it.
        if held[4] and held[4] <= timerValues.getCurrentWatermarkInMs():
            self.handle.deleteTimer(held[4])
            yield from self._expire(session, held)
        # A session that has neither a timer nor answers is new.
        stored = self._waiting() if held[4] or held[5] or held[6] else {}
        waiting, rows, new = dict(stored), list(rows), []
        running = self._logged(held, len(rows))
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq or 0)):
            if r.ts is not None:
                held[3] = max(held[3], int(r.ts.replace(tzinfo=r.ts.tzinfo or timezone.utc).timestamp() * 1000))
            if r.seq is None or r.request_id is None or r.cost is None or r.cost < 0:
                yield _OUT(session, r.seq, r.request_id, r.cost, held[1], "invalid")
                continue
            known = running.get(r.request_id)
            if known is None and held[6]:
                answer = self.answers.getValue((r.request_id,))
                known = answer and answer[2]
            if known is not None:
                yield _OUT(session, r.seq, r.request_id, r.cost, known, "replayed")
            elif r.seq < held[0]:
                yield _OUT(session, r.seq, r.request_id, r.cost, held[1], "late")
            elif r.seq in waiting:
                status = "pending" if waiting[r.seq][0] == r.request_id else "conflict"
                yield _OUT(session, r.seq, r.request_id, r.cost, held[1], status)
            else:
                waiting[r.seq] = (r.request_id, r.cost)
                while held[0] in waiting:
                    request, cost = waiting.pop(held[0])
                    found = self._decide(session, held, new, held[0], request, cost)
                    running[request] = found.running
                    yield found
        if not waiting and stored:
            self.waiting.clear()
        elif waiting != stored:
            self.waiting.put([(seq, *what) for seq, what in waiting.items()])
        self._append(held, new)
        self._wake(held, bool(waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        waits = bool(self._waiting())
        yield from self._expire(key[0], held)
        if waits:
            self._wake(held, False)

    def _expire(self, session: str, held: list) -> Iterator[Row]:
        """Decide what waits, over the gaps; a session in which nothing waits is forgotten."""
        held[4] = 0  # this timer is gone
        waiting, new = self._waiting(), []
        for seq in sorted(waiting):
            yield self._decide(session, held, new, seq, *waiting[seq])
        self._append(held, new)
        self.waiting.clear()
        if not waiting:
            self.head.clear()
            self.log.clear()
            self.answers.clear()
            held[:] = [self.first, 0, False, 0, 0, 0, 0]

    def close(self) -> None:
        pass


def reserve_stream(stream: DataFrame, limit: int, first: int = 1, wait: int = 600, idle: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Decide the requests (session, seq, request_id, cost, ts) of a stream against each session's limit.

    Requests are decided by ``seq``, whatever order and batch they come in: ``granted`` while what was granted and the cost are
    within the limit; from the first ``refused`` one on all are. A request that came before is ``replayed`` with the first answer's
    ``running``; one that still waits is ``pending``; another with its number ``conflict``; one whose number was passed over ``late``;
    one without number, name or a cost of 0 or more ``invalid``. Numbers that lack are waited for ``wait`` seconds of event time, and a session is forgotten after ``idle``
    seconds. Rows more than ``late`` behind are dropped by the watermark. Needs the RocksDB state store, which is set here.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.select("session", F.col("seq").cast("long"), "request_id", F.col("cost").cast("long"), "ts").withWatermark("ts", late)
    decide = Reserver(limit, first, wait * 1000, idle * 1000)
    return rows.groupBy("session").transformWithState(decide, DECIDED, "append", "eventTime")


def reserve_batch(attempts: DataFrame, limit: int) -> DataFrame:
    """The same decisions over a table whose requests each have one number; repeated rows of a request are ``replayed``."""
    own = W.partitionBy("session", "request_id").orderBy("seq", "ts")
    rows = attempts.withColumn("nth", F.row_number().over(own))
    decided = ledger.reserve(rows.filter("nth = 1"), ["session"], "seq", "cost", limit)
    first = decided.select(
        "session", F.col("seq").cast("long"), "request_id", F.col("cost").cast("long"), "running",
        F.when(F.col("granted"), "granted").otherwise("refused").alias("status"),
    )
    again = rows.filter("nth > 1").select("session", F.col("seq").cast("long"), "request_id", F.col("cost").cast("long"))
    return first.unionByName(again.join(first.select("session", "request_id", "running"), ["session", "request_id"]).withColumn("status", F.lit("replayed")))
