"""State machines and their timers: by hand, and streams against tables, whatever the cut into batches."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import machines, vad
from vellum.streaming import machines as streams

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
BASE = int(START.timestamp() * 1000)


def played(machine, events, until=1 << 62):
    state, out = machine.start(), []
    for at, *row in events:
        out += machine.take(state, at, tuple(row))
    return out + machine.advance(state, until)


def test_warning_then_end_without_an_event():
    out = played(machines.RecordingLimit(), [(0, "hold_down", "session-1"), (100, "capture_started", None)])
    assert [(r[0], r[1], r[3]) for r in out] == [(0, "hold_down", "starting"), (100, "capture_started", "recording_held"), (570_000, "warning", "recording_held"), (600_000, "duration_limit", "finalizing")]
    assert out[2][5] == ["warn_duration_limit"] and "finalize_transcript" in out[3][5]
    stopped = played(machines.RecordingLimit(), [(0, "hold_down", "s"), (100, "capture_started", None), (580_000, "stop", None), (590_000, "finalized", None)])
    assert [r[1] for r in stopped] == ["hold_down", "capture_started", "warning", "stop", "finalized"]
    late = played(machines.RecordingLimit(), [(0, "toggle", "s"), (700_000, "capture_started", None)])
    assert [(r[0], r[1]) for r in late][2:] == [(700_000, "duration_limit")]
    again = played(machines.RecordingLimit(10, 3), [(0, "toggle", "s"), (1, "capture_started", None), (8000, "cancel", None), (8001, "reset", None), (9000, "toggle", "t"), (9001, "capture_started", None)])
    assert [r[0] for r in again if r[1] in ("warning", "duration_limit")] == [7000, 16_000, 19_000]  # the next one warns anew


def test_releases_wait_for_a_grace():
    play = lambda *events: played(machines.Shortcuts(), events)
    assert play((0, "hold", True), (30, "hold", True)) == [(0, "hold_down")]
    assert play((0, "toggle", True), (10, "toggle", True), (20, "toggle", False), (25, "hold", False), (600, "toggle", True)) == [(0, "toggle"), (600, "toggle")]
    assert play((0, "hold", True), (1000, "hold", False), (1050, "lock", True)) == [(0, "hold_down"), (1050, "lock")]
    assert play((0, "hold", True), (500, "hold", False)) == [(0, "hold_down"), (700, "hold_up")]
    assert play((0, "hold", True), (500, "hold", False), (700, "lock", True)) == [(0, "hold_down"), (700, "lock")]
    assert play((0, "hold", True), (500, "hold", False), (701, "lock", True)) == [(0, "hold_down"), (700, "hold_up"), (701, "lock")]
    assert play((0, "other", True), (1, "hold", None)) == []


def test_pairings():
    answers = lambda *events: [r[3] for r in played(machines.Pairings(), events)]
    opened = [(k, "open", f"p{k}", "s", None) for k in range(4)]
    assert answers(*opened, (4, "open", "p4", "s", None)) == ["opened"] * 4 + ["too_many_pending"]
    assert answers(*opened, (299, "open", "q", "s", None), (300, "open", "r", "s", None)) == ["opened"] * 4 + ["too_many_pending", "opened"]
    denied = [e for k in range(10) for e in ((k, "open", f"p{k}", "s", None), (k, "deny", f"p{k}", None, None))]
    assert answers(*denied, (10, "open", "q", "s", None), (60, "open", "r", "s", None)) == ["opened", "done"] * 10 + ["rate_limited", "opened"]
    # An open that finds too many pending counts for the rate.
    full = [*opened, *((4, "open", f"x{k}", "s", None) for k in range(6))]
    assert answers(*full, *((5, "deny", f"p{k}", None, None) for k in range(4)), (6, "open", "y", "s", None))[-1] == "rate_limited"
    once = [(0, "open", "p", "s", None), (1, "poll", "p", "s", None), (2, "poll", "p", "wrong", None), (3, "approve", "p", None, "token-1"), (4, "poll", "p", "wrong", None), (5, "poll", "p", "s", None), (6, "poll", "p", "s", None), (7, "approve", "p", None, "t")]
    assert [r[3:] for r in played(machines.Pairings(), once)] == [("opened", None), ("pending", None), ("unknown", None), ("done", None), ("unknown", None), ("approved", "token-1"), ("unknown", None), ("refused", None)]
    assert answers((0, "open", "p", "s", None), (1, "other", "p", "s", None), (300, "poll", "p", "s", None)) == ["opened", "unknown_action", "unknown"]


def test_phases():
    calls = [("begin_finalization", "s", 1), ("start", "s", None), ("start", "t", None), ("finalization_completed", "s", 1), ("begin_finalization", "s", 2), ("begin_finalization", "s", 1), ("begin_finalization", "s", 1), ("finalization_completed", "s", 1), ("delivery_completed", "s", 1), ("start", "s", None), ("finalization_completed", "s", 1), ("fail", "s", 2), ("other", "s", 2)]
    out = played(machines.Phases(), [(k, *c) for k, c in enumerate(calls)])
    assert [(r[3], r[4], r[5]) for r in out] == [
        (1, None, "no_active_session"), (1, "capturing", None), (None, "capturing", "busy"), (1, "capturing", "wrong_phase"), (2, "capturing", "stale_completion"), (1, "finalizing", None), (1, "finalizing", "wrong_phase"), (1, "delivering", None), (1, None, None),
        (2, "capturing", None), (1, "capturing", "stale_completion"), (2, None, None), (2, None, "unknown_call"),
    ]


def test_one_pass_at_a_time():
    rows = [("poll", 8000), ("poll", 16_000), ("poll", 40_000), ("done", None), ("poll", 31_000), ("poll", 33_000), ("poll", None)]
    assert played(machines.PartialPasses(), [(k, *r) for k, r in enumerate(rows)]) == [(1, 0, 16_000), (5, 16_000, 33_000)]


def test_tables_with_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 5, "hold", True, 1), ("a", None, "hold", True, 2), ("a", 1, None, None, 3), (None, 1, "lock", True, 4), ("b", 1, "hold", True, 5), ("b", 2, "hold", False, 6)], "who string, at long, action string, pressed boolean, state int")
    got = machines.run(rows, machines.Shortcuts(), "who")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 1, "lock"), (None, 5, "hold_down"), ("b", 1, "hold_down"), ("b", 202, "hold_up")], key=repr)
    assert machines.run(rows, machines.Shortcuts(), "who", until=100).count() == 3
    assert machines.run(rows.where("false"), machines.Shortcuts(), "who").count() == 0
    jobs = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 15), (1, 2, 1, 9), (2, 3, 1, 12)], "device_id int, job_id int, stage int, at long")
    busy = spark.createDataFrame([(1, 10, 20), (1, 18, 200_000), (2, 13, 14), (1, 7, 7)], "device_id int, start long, end long")
    assert sorted(map(tuple, machines.preempted(jobs, busy).collect())) == [(1, 1, 2, "local_pending"), (1, 2, None, "ended"), (2, 3, None, "ended")]


def _streamed(spark, machine, rows, schema, key, timed, cuts):
    """The rows in files, cut at the given places; the stream is stopped and started again from its checkpoint after each."""
    source, state, sink = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    run = streams.run_timed if timed else streams.run_ordered
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{source}/part{k}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        out = run(events, machine, key, **({"at": "ts", "delay": "5 seconds"} if timed else {}))
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(sink)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_with_timers_is_the_table(spark, seed):
    """Late rows within the delay, restarts, and a last row of another device that moves the watermark on."""
    rng = random.Random(seed)
    moves = ["hold_down", "capture_started", "toggle", "stop", "finalized", "delivered", "hold_up", "lock", "cancel", "reset"]
    rows = sorted((rng.randint(0, 120_000), rng.choice("ab"), rng.choice(moves), rng.choice(["s", "s", ""])) for _ in range(80))
    rows += [(199_000, "a", "cancel", ""), (200_000, "a", "reset", ""), (200_001, "a", "hold_down", "s"), (200_002, "a", "capture_started", "s"), (400_000, "z", "reset", "")]
    for k in range(0, 60, 2):  # a little out of order
        if rows[k + 1][0] - rows[k][0] < 4000:
            rows[k], rows[k + 1] = rows[k + 1], rows[k]
    table = [(START + datetime.timedelta(milliseconds=t), *r) for t, *r in rows]
    schema = "ts timestamp, device string, event string, session string"
    machine = machines.RecordingLimit(20, 5)
    got = _streamed(spark, machine, table, schema, "device", True, [20, 47, 83])
    frame = spark.createDataFrame(table, schema).select("device", F.unix_millis("ts").alias("at"), "event", "session")
    expected = [tuple(r) for r in machines.run(frame, machine, "device", until=BASE + 394_000).collect() if r["at"] < BASE + 394_000]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert {r[2] for r in expected} >= {"warning", "duration_limit"}


def test_deferred_release_in_a_stream(spark):
    second = lambda s, *r: (START + datetime.timedelta(milliseconds=s), *r)
    table = [second(0, "a", "hold", True), second(1000, "a", "hold", False), second(1050, "a", "lock", True), second(0, "b", "hold", True), second(500, "b", "hold", False), second(60_000, "z", "cancel", True)]
    got = _streamed(spark, machines.Shortcuts(), table, "ts timestamp, device string, action string, pressed boolean", "device", True, [2, 5])
    assert sorted((r["device"], r["at"] - BASE, r["event"]) for r in got.collect()) == [("a", 0, "hold_down"), ("a", 1050, "lock"), ("b", 0, "hold_down"), ("b", 700, "hold_up")]


def test_online_speech_is_the_table(spark):
    rng = random.Random(4)
    rows = [(s, k, rng.random() < 0.5 if k % 40 < 25 else k % 80 < 40) for s in "ab" for k in range(200)]
    rows.sort(key=lambda r: r[1])
    schema = "session_id string, at long, loud boolean"
    got = _streamed(spark, machines.Speech(), rows, schema, "session_id", False, [3, 100, 101, 333])
    frames = spark.createDataFrame(rows, schema).withColumnRenamed("at", "frame_ix")
    expected = {(r["session_id"], r["frame_ix"], r["speech"]) for r in vad.speaking(frames).collect()}
    assert {tuple(r) for r in got.collect()} == expected and len(expected) == 400


def test_pairings_in_a_stream(spark):
    """Entries and the log of opens go on from batch to batch and through restarts; here times are milliseconds."""
    rng = random.Random(9)
    rows, at = [], 0
    for k in range(60):
        at += rng.randint(1, 40_000)
        rows.append((START + datetime.timedelta(milliseconds=at), rng.choice("xy"), rng.choice(["open", "open", "poll", "approve", "deny"]), f"p{rng.randint(max(0, k - 6), k)}", "s", f"token-{k}"))
    rows.append((START + datetime.timedelta(milliseconds=at + 100_000), "z", "poll", "p", "s", None))
    schema = "ts timestamp, server string, action string, pairing_id string, secret string, token string"
    machine = machines.Pairings(pending=2, lifetime=300_000, rate=2, span=120_000)
    got = _streamed(spark, machine, rows, schema, "server", True, [17, 18, 40])
    frame = spark.createDataFrame(rows[:-1], schema).withColumn("at", F.unix_millis("ts"))
    expected = sorted(map(tuple, machines.run(frame, machine, "server").collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert {r[4] for r in expected} >= {"opened", "rate_limited", "unknown", "refused", "done"}


def test_a_long_history_spans_tasks(spark):
    """One device has nearly all events; null keys, events and sessions; against a plain walk."""
    from vellum.operators import control, recording

    rng = random.Random(11)
    names = ["hold_down", "toggle", "hold_up", "lock", "capture_started", "finalized", "delivered", "stop", "cancel", "reset", "failed", "nonsense", None]
    rows = [(rng.choice(["hot"] * 30 + ["a", "b", None]), k, rng.choice(names), rng.choice(["s", "s", "", None])) for k in range(4000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "device string, n long, event string, session string, before_ string").repartition(3)
    moves, state, expected = recording.table(), {}, []
    shown = lambda s: "starting" if s.startswith("starting") else s
    for d, n, e, s in rows:
        now = state.get(d, "idle")
        found = moves.get((now, e))
        if found is None or now == "idle" and e in ("hold_down", "toggle") and not s:
            expected.append((n, shown(now), shown(now), False, [], "invalid_transition"))
            continue
        state[d] = found[0]
        expected.append((n, shown(now), shown(found[0]), found[2] is None, list(found[1]), found[2]))
    got = recording.recorded(frame, "device", ["n"]).select("n", "before", "after", "accepted", "effects", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    targets = [(r[0], r[1], rng.choice([*control.TRANSITIONS, "unknown", None])) for r in rows]
    held: dict = {}
    for k, _, t in targets:
        h = held.setdefault(k, ["local_pending", 0, 0])
        ok = t in control.TRANSITIONS[h[0]]
        h[:] = [t if ok else h[0], h[1] + ok, h[2] + (not ok)]
    got = control.fold_states(spark.createDataFrame(targets, "k string, n long, target string"), "k", ["n"], "target").collect()
    assert {r["k"]: [r["state"], r["moved"], r["conflicts"]] for r in got} == held
    assert recording.recorded(frame.where("false"), "device", ["n"]).count() == 0
