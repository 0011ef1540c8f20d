"""Upload sessions, ledgers and negotiation: the rule over a batch, a stream, and its parts."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import archive, ledger, sessions

LIMITS = dict.fromkeys(archive.COUNTERS, 100)


def cost(**own):
    return json.dumps({**dict.fromkeys(archive.COUNTERS, 0), **own})


def event(seq, action, request=None, session="s", owner="o", at=0, profile="p", binding="b", expected=None, expires=None, cost=None):
    return (session, seq, at, action, owner, request, profile, binding, expected, expires, cost)


def answers(spark, events):
    df = spark.createDataFrame(events, archive.EVENT)
    return {(r.session, r.seq): r for r in archive.answer_events(df, LIMITS).collect()}


def codes(spark, events):
    return [a.code for _, a in sorted(answers(spark, events).items())]


OPEN = event(0, "open", expires=1000)


def test_leases(spark):
    events = [
        OPEN, event(1, "open", expires=1000), event(2, "open", expires=999), event(3, "open", owner="x", expires=1000), event(4, "renew", expires=900),
        event(5, "renew", expires=2000), event(6, "ledger", at=1500), event(7, "ledger", at=2000), event(8, "close", expires=1), event(9, "close"), event(10, "ledger"),
        event(11, "open", session="t", at=5, expires=5), event(12, "ledger", session="t"),
    ]
    assert codes(spark, events) == [
        "OK", "OK", "PROFILE_BINDING_CHANGED", "SOURCE_NOT_FOUND", "INVALID_RANGE", "OK", "OK", "SOURCE_LEASE_EXPIRED", "MALFORMED_REQUEST", "OK", "SOURCE_NOT_FOUND",
        "SOURCE_LEASE_EXPIRED", "SOURCE_NOT_FOUND",
    ]


def test_reservations_are_settled_one_at_a_time(spark):
    few = cost(source_bytes=60, depth=90)
    events = [
        OPEN, event(1, "ledger"), event(2, "reserve", "r1", cost=few), event(3, "reserve", "r2", cost=few), event(4, "settle", "r1", binding="other", cost=few),
        event(5, "settle", "r1", cost=cost(source_bytes=50, depth=90)), event(6, "settle", "r1", cost=few), event(7, "reserve", "r1", cost=few),
        event(8, "reserve", "r2", cost=few), event(9, "reserve", "r3", cost=cost(source_bytes=50, depth=100)), event(10, "ledger", profile="q"),
        event(11, "reserve", "r4", profile="q", cost=cost()), event(12, "settle", "r3", cost=cost(source_bytes=50)), event(13, "reserve", "r5", cost=cost()),
        event(14, "reserve", "r6", cost="{}"),
    ]
    got = answers(spark, events)
    assert [a.code for _, a in sorted(got.items())] == [
        "OK", "OK", "OK", "OPERATION_RECONCILIATION_REQUIRED", "OPERATION_NOT_ACTIVE", "OK", "OPERATION_NOT_ACTIVE", "OPERATION_NOT_ACTIVE",
        "BUDGET_EXHAUSTED", "OK", "OK", "OPERATION_RECONCILIATION_REQUIRED", "OK", "BUDGET_EXHAUSTED", "MALFORMED_REQUEST",
    ]
    # Every change is a revision with a digest of its own; a peak counter doesn't add up.
    assert [got["s", k].revision for k in (1, 2, 5, 9, 12)] == [0, 1, 2, 3, 4]
    assert len({got["s", k].ledger_digest for k in (1, 2, 5, 9, 12)}) == 5


def test_unknown_costs_are_reconciled(spark):
    known = cost(source_bytes=1, volumes=1, elapsed_ms=1)
    events = [
        OPEN, event(1, "ledger"), event(2, "reserve", "r", cost=cost()), event(3, "measure", "r", cost=known), event(4, "settle", "r"), event(5, "reserve", "x", cost=cost()),
        event(6, "reconcile", "r"), event(7, "measure", "r", cost=cost()), event(8, "measure", "r", cost=known), event(9, "measure", "r", cost=cost(source_bytes=2, volumes=1, elapsed_ms=1)),
        event(10, "reconcile", "r"), event(11, "reconcile", "r"), event(12, "reserve", "x", cost=cost()),
    ]
    assert codes(spark, events) == [
        "OK", "OK", "OK", "OPERATION_NOT_ACTIVE", "OK", "OPERATION_RECONCILIATION_REQUIRED", "OPERATION_RECONCILIATION_REQUIRED", "MALFORMED_REQUEST", "OK",
        "PROFILE_BINDING_CHANGED", "OK", "OK", "OK",
    ]


def test_expected_digest(spark):
    first = answers(spark, [OPEN, event(1, "ledger")])["s", 1].ledger_digest
    assert codes(spark, [OPEN, event(1, "ledger"), event(2, "reserve", "r", expected="no", cost=cost()), event(3, "reserve", "r", expected=first, cost=cost())])[2:] == [
        "PROFILE_BINDING_CHANGED", "OK",
    ]


def test_stream_gives_the_batch_s_answers(spark, tmp_path):
    rng = random.Random(5)
    events = []
    for s in range(4):
        events += [event(0, "open", session=f"s{s}", expires=1000), event(1, "ledger", session=f"s{s}")]
        for k in range(2, 30):
            action = rng.choice(["reserve", "settle", "measure", "reconcile", "ledger", "renew"])
            own = cost(source_bytes=rng.randint(0, 30), volumes=1, elapsed_ms=1) if rng.random() < 0.8 else None
            events.append(event(k, action, f"r{rng.randint(0, 6)}", session=f"s{s}", cost=own, expires=1000 + k if action == "renew" else None))
    want = {k: tuple(v) for k, v in answers(spark, events).items()}
    for part in range(3):  # each file is a micro-batch
        some = [e for e in events if part * 10 <= e[1] < part * 10 + 10]
        spark.createDataFrame(some, archive.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(archive.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        archive.answer_stream(stream, LIMITS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    got = {(r.session, r.seq): tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and {v[4] for v in want.values()} >= {"OK", "OPERATION_NOT_ACTIVE", "OPERATION_RECONCILIATION_REQUIRED"}


def test_reservations_as_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", k, f"r{k}", rng.randint(-5, 40)) for k in range(60)]
    spark.createDataFrame(rows, "session string, n int, request_id string, cost long").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = {r.request_id: (r.granted, r.running) for r in ledger.reserve(batch, ["session"], "n", "cost", 100).collect()}
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = sessions.reservations(stream, 100).writeStream.format("memory").queryName("decided_again").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.request_id: (r.status == "granted", r.running) for r in spark.table("decided_again").collect()}
    assert got == want and len({g for g, _ in want.values()}) == 2


def test_lookups(spark):
    leases = spark.createDataFrame([("a", "o", 10, True), ("b", "o", 10, False)], "source_ref string, owner string, expires_ms long, active boolean")
    refs = spark.createDataFrame([("a", "o", 9), ("a", "o", 10), ("a", "x", 1), ("b", "o", 1), ("c", "o", 1)], "source_ref string, owner string, now_ms long")
    got = sorted((r.source_ref, r.owner, r.now_ms, r.code) for r in archive.lookup_lease(leases, refs).collect())
    assert [g[3] for g in got] == ["OK", "SOURCE_LEASE_EXPIRED", "SOURCE_NOT_FOUND", "SOURCE_NOT_FOUND", "SOURCE_NOT_FOUND"]
    issued = spark.createDataFrame([("s", "c1")], "session string, cursor string")
    asked = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("t", "c1")], "session string, cursor string")
    assert sorted(r.code for r in archive.cursor_was_issued(asked, issued).collect()) == ["OK", "PROFILE_BINDING_CHANGED", "PROFILE_BINDING_CHANGED"]
    saved = spark.createDataFrame([("s", "n", "x")], "session string, negotiation_id string, binding string")
    wanted = spark.createDataFrame([("s", "n", "x"), ("s", "n", "y"), ("s", "m", None)], "session string, negotiation_id string, binding string")
    assert sorted(r.code for r in archive.saved_binding(wanted, saved).collect()) == ["OK", "PROFILE_BINDING_CHANGED", "PROFILE_BINDING_CHANGED"]


def test_chunks(spark):
    chunks = spark.createDataFrame([("a", 0, b"PK"), ("a", 2, b"\x03\x04rest"), ("b", 0, b"x"), ("b", 2, b"y")], "session string, start long, data binary")
    sha = hashlib.sha256(b"PK\x03\x04rest").hexdigest()
    volumes = spark.createDataFrame([("a", sha, 8), ("b", sha, 2), ("c", sha, 8)], "session string, sha256 string, size_bytes long")
    got = {r.session: (r.content and bytes(r.content), r.code) for r in archive.assemble(chunks, volumes).collect()}
    assert got == {"a": (b"PK\x03\x04rest", "OK"), "b": (None, "SOURCE_CHANGED"), "c": (None, "SOURCE_CHANGED")}
    assert {r.session: bytes(r.signature) for r in archive.signatures(chunks).collect()} == {"a": b"PK\x03\x04", "b": b"xy"}


def test_negotiation(spark):
    catalog = spark.createDataFrame(
        [("p", "read", "1", "d", "e", "qualified", 100), ("p", "list", "1", "d", "e", "planned", 100)],
        "profile_id string, operation string, contract string, definition_digest string, profile_digest string, support_status string, catalog_expires_ms long",
    )
    base = {"request_id": "r", "profile_id": "p", "profile_contract": "1", "expected_digest": "d", "execution_digest": "e", "catalog_digest": "c", "operation": "read", "lease_expires_ms": 50, "now_ms": 1}
    cases = [({}, "ACCEPTED"), ({"catalog_digest": "x"}, "CAPABILITY_CATALOG_CHANGED"), ({"profile_id": "q"}, "PROFILE_UNKNOWN"), ({"profile_contract": "2"}, "PROFILE_CONTRACT_UNSUPPORTED"),
             ({"execution_digest": "x"}, "PROFILE_BINDING_CHANGED"), ({"operation": "list"}, "UNAVAILABLE"), ({"now_ms": 50}, "NEGOTIATION_EXPIRED")]
    rows = spark.createDataFrame([{**base, **own, "request_id": str(k)} for k, (own, _) in enumerate(cases)])
    got = {r.request_id: (r.code, r.expires_ms) for r in archive.negotiate(rows, catalog, "c").collect()}
    assert got == {str(k): (code, 50 if code == "ACCEPTED" else None) for k, (_, code) in enumerate(cases)}
    chains = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "z"]), ("c", [])], "request_id string, steps array<string>")
    known = spark.createDataFrame([("x",), ("y",)], "digest string")
    assert {r.request_id: r.code for r in archive.chain_decoders(chains, known).collect()} == {"a": "OK", "b": "PROFILE_BINDING_CHANGED", "c": "PROFILE_BINDING_CHANGED"}


def test_receipts_are_given_once(spark):
    a = spark.createDataFrame([("s", "r", "OK", "settled"), ("s", "r", "OK", "settled"), ("s", "q", "OK", "reserved")], "session string, request_id string, code string, state string")
    results = spark.createDataFrame([("s", "r", "x"), ("s", "r", "x"), ("s", "q", "y")], "session string, request_id string, result string")
    assert [tuple(r) for r in archive.receipts(a, results).collect()] == [("s", "r", "x")]


@pytest.mark.parametrize("change", ["payload", "link", "drop", "swap"])
def test_a_changed_chain_is_found(spark, change):
    e = spark.createDataFrame([("k", n, f"v{n}") for n in range(1, 7)], "key string, revision int, state string")
    rows = [r.asDict() for r in ledger.chained(e, ["key"], "revision", F.col("state")).orderBy("revision").collect()]
    if change == "payload":
        rows[2]["state"] = "other"
    elif change == "link":  # an entry rewritten with a digest that fits it, as an edit of one row and one link would
        head = f"k|3|other|{rows[1]['digest']}"
        rows[2].update(state="other", digest=hashlib.sha256(head.encode()).hexdigest())
        rows[3]["previous_digest"] = rows[2]["digest"]
    elif change == "drop":
        del rows[2]
    else:
        rows[2]["state"], rows[3]["state"] = rows[3]["state"], rows[2]["state"]
    assert ledger.broken_chain(spark.createDataFrame(rows, "key string, revision int, state string, digest string, previous_digest string"), ["key"], "revision", F.col("state")).count() > 0
