"""The recording state machine as a table, and a fold of event histories with it.

``starting`` is four states: what comes once capture has begun (lock, stop) is part of the state, so that
the machine is one finite table and a fold carries one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import automata

STARTING = ("starting", "starting_locked", "starting_stop", "starting_locked_stop")
RECORDING = ("recording_held", "recording_locked")
WORKING = ("finalizing", "delivering")
STATES = ("idle", *STARTING, *RECORDING, *WORKING, "cancelled", "error")
BEGIN, FINISH = ("start_capture", "announce_state"), ("stop_capture", "finalize_transcript", "announce_state")
DISCARD = ("stop_capture", "discard_session", "announce_state", "release_resources")

#: (event, states, target, effects): the accepted moves.
MOVES = [
    ("hold_down", ["idle"], "starting", BEGIN), ("toggle", ["idle"], "starting_locked", BEGIN),
    *((e, [s], "starting_stop" if s in ("starting", "starting_stop") else "starting_locked_stop", ()) for e in ("toggle", "stop") for s in STARTING),
    ("hold_up", ["starting", "starting_stop"], "starting_stop", ()), ("lock", ["starting", "starting_locked"], "starting_locked", ()), ("lock", ["starting_stop", "starting_locked_stop"], "starting_locked_stop", ()),
    *((e, RECORDING, "finalizing", FINISH) for e in ("toggle", "stop", "duration_limit")), ("hold_up", ["recording_held"], "finalizing", FINISH), ("lock", ["recording_held"], "recording_locked", ("announce_state",)),
    ("capture_started", ["starting"], "recording_held", ("announce_state",)), ("capture_started", ["starting_locked"], "recording_locked", ("announce_state",)),
    ("capture_started", ["starting_stop", "starting_locked_stop"], "finalizing", FINISH),
    ("finalized", ["finalizing"], "delivering", ("deliver_text",)), ("delivered", ["delivering"], "idle", ("announce_state", "release_resources")),
    ("cancel", [s for s in STATES if s not in ("idle", "cancelled")], "cancelled", DISCARD), ("failed", [s for s in STATES if s != "idle"], "error", DISCARD), ("reset", ["cancelled", "error"], "idle", ("announce_state",)),
]
#: (event, states, reason): what is ignored; any other event that is no move is an error.
IGNORED = [
    ("hold_down", [*STARTING, *RECORDING], "auto_repeat"), ("hold_down", WORKING, "busy_finalizing"), ("hold_up", ["recording_locked"], "locked"), ("lock", ["recording_locked"], "already_locked"), ("cancel", ["idle", "cancelled"], "nothing_to_cancel"),
    ("failed", ["idle"], "idle"), ("reset", ["idle"], "already_idle"), ("toggle", STATES, "not_recording"), ("hold_up", STATES, "not_held"), ("lock", STATES, "not_recording"), ("stop", STATES, "already_stopping"),
    ("capture_started", STATES, "not_starting"), ("finalized", STATES, "not_finalizing"), ("delivered", STATES, "not_delivering"), ("duration_limit", STATES, "not_recording"),
]


def table() -> dict[tuple[str, str], tuple[str, tuple[str, ...], str | None]]:
    """(state, event) to (next state, effects, why it is ignored)."""
    out = {}
    for event, states, reason in reversed(IGNORED):
        out |= {(s, event): (s, (), reason) for s in states}
    return out | {(s, event): (target, effects, None) for event, states, target, effects in MOVES for s in states}


def recorded(events: DataFrame, key: str, order: list[str], event: str = "event", session: str = "session") -> DataFrame:
    """``events`` with before, after, accepted, effects, reason: each device's history in its order.

    An event that no state allows has the reason ``invalid_transition`` and changes nothing, like
    a null or unknown event and a start (``hold_down``, ``toggle`` when idle) whose ``session`` is null or
    empty. Rows of a null key are one history. Ties in ``order`` are broken by event and whether there is a session.
    """
    moves = table()
    nameless = ("hold_down!", "toggle!")  # without a session
    rules = moves | {(s, f"{e}!"): x for (s, e), x in moves.items() if e in ("hold_down", "toggle") and s != "idle"}
    bare = F.col(event).isin("hold_down", "toggle") & (F.coalesce(F.col(session), F.lit("")) == "")
    symbol = F.when(bare, F.concat(F.col(event), F.lit("!"))).otherwise(F.col(event))
    steps = {k: after for k, (after, _, _) in rules.items()} | {("idle", x): "idle" for x in nameless}
    rows = automata.states_before(events, key, order, symbol, steps, "idle")
    spark = events.sparkSession
    outcomes = spark.createDataFrame([(s, e, after, reason is None, list(effects), reason) for (s, e), (after, effects, reason) in rules.items()], "__s string, __e string, after string, accepted boolean, effects array<string>, reason string")
    out = rows.join(F.broadcast(outcomes), (F.col("before") == F.col("__s")) & (F.col("__symbol") == F.col("__e")), "left")
    shown = lambda c: F.when(c.startswith("starting"), "starting").otherwise(c)
    after = F.coalesce("after", "before")
    known = F.col("__e").isNotNull()
    return out.select(
        *events.columns, shown(F.col("before")).alias("before"), shown(after).alias("after"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("effects", F.array().cast("array<string>")).alias("effects"),
        F.when(known, F.col("reason")).otherwise("invalid_transition").alias("reason"),
    )
