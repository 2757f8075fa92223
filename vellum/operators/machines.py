"""State machines over the events of a key, some with timers: one definition for tables and for streams.

A machine says what it starts with, what an event does, when it wants to be woken, and what it does then.
``run`` folds a table's histories with it: a history streams through its task in sorted batches and only the
state is held, for a machine's next answer depends on the one before. ``vellum.streaming.machines`` runs the
same machines on streams. Timers are due in event time: all that is due before an event comes before it, and
an event at a timer's very time comes first.

Defined cases: rows without a time are left out; rows of a null key are one history; ties in time are taken
in the order of the machine's columns. Times are whole numbers, in milliseconds unless a machine says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import intervals, recording

Rows = list[tuple]


class Machine:
    """``columns`` are what a row must have besides key and time, ``schema`` what comes out besides the key. A state is made of lists, numbers, strings and nulls."""

    columns: tuple[str, ...] = ()
    schema: str = ""

    def start(self) -> list:
        raise NotImplementedError

    def step(self, state: list, at: int, row: tuple) -> Rows:
        """Changes the state; what comes out."""
        raise NotImplementedError

    def due(self, state: list) -> int | None:
        """When the machine wants to be woken, if no event comes before."""
        return None

    def fire(self, state: list, at: int) -> Rows:
        return []

    def advance(self, state: list, until: int, strictly: bool = False) -> Rows:
        """All that is due up to a time, or before it."""
        out: Rows = []
        while (at := self.due(state)) is not None and (at < until or at == until and not strictly):
            out += self.fire(state, at)
        return out

    def take(self, state: list, at: int, row: tuple) -> Rows:
        return self.advance(state, at, strictly=True) + self.step(state, at, row)


class RecordingLimit(Machine):
    """The recording states with a limit on a recording's length: one warning some seconds before it, then the end.

    Both count from the start that was accepted, and only while recording. Times are milliseconds.
    """

    columns = ("event", "session")
    schema = "at long, event string, before string, after string, accepted boolean, effects array<string>, reason string"

    def __init__(self, limit_seconds: int = 600, warn_seconds: int = 30):
        self.limit, self.warn = limit_seconds * 1000, max(0, limit_seconds - warn_seconds) * 1000
        self.moves = recording.table()

    def start(self) -> list:
        return ["idle", None, False, 0]  # state, started, warned, last time

    def step(self, state: list, at: int, row: tuple) -> Rows:
        name, _, _, last = state
        event, session = row
        state[3] = max(last, at)
        found = self.moves.get((name, event))
        if found is None or (name == "idle" and event in ("hold_down", "toggle") and not session):
            return [(at, event, _shown(name), _shown(name), False, [], "invalid_transition")]
        after, effects, reason = found
        if name == "idle" and after != "idle":
            state[1], state[2] = at, False
        state[0] = after
        return [(at, event, _shown(name), _shown(after), reason is None, list(effects), reason)]

    def due(self, state: list) -> int | None:
        name, started, warned, last = state
        if name not in recording.RECORDING or started is None:
            return None
        return max(last, started + (self.limit if warned or self.warn >= self.limit else self.warn))

    def fire(self, state: list, at: int) -> Rows:
        if at >= state[1] + self.limit:
            return self.step(state, at, ("duration_limit", None))
        state[2], state[3] = True, at
        return [(at, "warning", _shown(state[0]), _shown(state[0]), True, ["warn_duration_limit"], None)]


def _shown(name: str) -> str:
    return "starting" if name.startswith("starting") else name


class Shortcuts(Machine):
    """Key events (action hold, toggle, lock, cancel; pressed) as recording events: repeats are suppressed for each action, and a released hold counts after a grace unless a lock or another hold comes first."""

    columns = ("action", "pressed")
    schema = "at long, event string"
    EVENTS = {"hold": "hold_down", "toggle": "toggle", "lock": "lock", "cancel": "cancel"}

    def __init__(self, grace: int = 200):
        self.grace = grace

    def start(self) -> list:
        return [[], None]  # held actions, when the release counts

    def step(self, state: list, at: int, row: tuple) -> Rows:
        action, pressed = row
        held, _ = state
        if action not in self.EVENTS or pressed is None or bool(pressed) == (action in held):
            return []
        if not pressed:
            held.remove(action)
            if action == "hold":
                state[1] = at + self.grace
            return []
        held.append(action)
        if action in ("hold", "lock"):
            state[1] = None
        return [(at, self.EVENTS[action])]

    def due(self, state: list) -> int | None:
        return state[1]

    def fire(self, state: list, at: int) -> Rows:
        state[1] = None
        return [(at, "hold_up")]


class Pairings(Machine):
    """Requests to pair: (action open, approve, deny, poll; pairing_id; secret; token). Times are seconds.

    An open is let in by a log of the opens of the last minute, which holds those that the rate let in, also
    if too many were pending then. An entry lives ``lifetime``; opens and polls clear what has expired, approval
    does not look. A poll with the right secret takes an answered entry away, so the token is given once.
    """

    columns = ("action", "pairing_id", "secret", "token")
    schema = "at long, action string, pairing_id string, result string, token string"

    def __init__(self, pending: int = 4, lifetime: int = 300, rate: int = 10, span: int = 60):
        self.pending, self.lifetime, self.rate, self.span = pending, lifetime, rate, span

    def start(self) -> list:
        return [[], []]  # times of opens, entries: [id, created, stage, secret, token]

    def step(self, state: list, at: int, row: tuple) -> Rows:
        action, name, secret, token = row
        result, given = self._result(state, at, action, name, secret, token)
        return [(at, action, name, result, given)]

    def _result(self, state: list, at: int, action: str, name: str, secret: str, token: str) -> tuple[str, str | None]:
        entries = state[1]
        own = next((e for e in entries if e[0] == name), None)
        if action in ("approve", "deny"):
            if own is None or own[2] != "pending":
                return "refused", None
            own[2:] = ["approved", own[3], token] if action == "approve" else ["denied", own[3], None]
            return "done", None
        if action == "open":
            state[0] = [t for t in state[0] if at - t < self.span]
            if len(state[0]) >= self.rate:
                return "rate_limited", None
            state[0].append(at)
        elif action != "poll":
            return "unknown_action", None
        state[1] = entries = [e for e in entries if at - e[1] < self.lifetime]
        if action == "open":
            if sum(e[2] == "pending" for e in entries) >= self.pending:
                return "too_many_pending", None
            state[1] = [*(e for e in entries if e[0] != name), [name, at, "pending", secret, None]]
            return "opened", None
        own = next((e for e in entries if e[0] == name), None)
        if own is None or own[3] != secret:
            return "unknown", None
        if own[2] != "pending":
            entries.remove(own)
        return own[2], own[4]


class Phases(Machine):
    """Calls of one live session at a time (call, session, epoch): start, begin_finalization, finalization_completed, delivery_completed, cancel, fail.

    A call is taken only from the session and epoch that are active, and only in the phase that waits for it;
    else the reason says why not. A start gives the next epoch.
    """

    columns = ("call", "session", "epoch")
    schema = "at long, call string, session string, epoch long, phase string, reason string"
    WAITS = {"begin_finalization": ("capturing", "finalizing"), "finalization_completed": ("finalizing", "delivering"), "delivery_completed": ("delivering", None), "cancel": (None, None), "fail": (None, None)}

    def start(self) -> list:
        return [0, None, None, None]  # last epoch; session, epoch and phase that are active

    def step(self, state: list, at: int, row: tuple) -> Rows:
        call, session, epoch = row
        reason = None
        if call == "start":
            reason = "busy" if state[3] else None
            if not reason:
                state[:] = [state[0] + 1, session, state[0] + 1, "capturing"]
                epoch = state[0]
        elif call not in self.WAITS:
            reason = "unknown_call"
        elif state[3] is None:
            reason = "no_active_session"
        elif [session, epoch] != state[1:3]:
            reason = "stale_completion"
        else:
            wanted, after = self.WAITS[call]
            if wanted not in (None, state[3]):
                reason = "wrong_phase"
            else:
                state[1:] = [session, epoch, after] if after else [None, None, None]
        return [(at, call, session, epoch, state[3], reason)]


class PartialPasses(Machine):
    """When to recognise what was said so far: at most one pass at a time, and at least ``step`` new samples since the last began.

    Rows are (kind, captured): ``poll`` with the samples captured, ``done`` when the pass has ended. Times are the order of rows.
    """

    columns = ("kind", "captured")
    schema = "at long, first long, stop long"

    def __init__(self, step: int = 16_000):
        self.least = step

    def start(self) -> list:
        return [False, 0]  # a pass is running, where the last one ended

    def step(self, state: list, at: int, row: tuple) -> Rows:
        kind, captured = row
        if kind == "done":
            state[0] = False
        elif kind == "poll" and captured is not None and not state[0] and captured - state[1] >= self.least:
            before, state[:] = state[1], [True, captured]
            return [(at, before, captured)]
        return []


class Speech(Machine):
    """Voice activity online: frames (loud) in the order of their numbers; on after some loud ones in a row, off after some quiet ones."""

    columns = ("loud",)
    schema = "at long, speech boolean"

    def __init__(self, open_frames: int = 2, close_frames: int = 8):
        self.open, self.close = open_frames, close_frames

    def start(self) -> list:
        return [False, None, 0]  # speech, the last frame's loudness, frames in a row

    def step(self, state: list, at: int, row: tuple) -> Rows:
        loud = bool(row[0])
        state[2] = state[2] + 1 if state[1] == loud else 1
        state[1] = loud
        if state[2] >= (self.open if loud else self.close):
            state[0] = loud
        return [(at, state[0])]


def plain(x: Any) -> Any:
    """A value of pandas as the machine wants it: None for what is missing."""
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def events_of(frame: pd.DataFrame, at: str, columns: tuple[str, ...]) -> Iterator[tuple[int, tuple]]:
    for t, *row in zip(frame[at], *(frame[c].astype(object) for c in columns), strict=True):
        yield int(t), tuple(map(plain, row))


def field_names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]


def run(events: DataFrame, machine: Machine, key: str, at: str = "at", until: int | None = None) -> DataFrame:
    """What the machine puts out over each key's history; timers up to ``until`` fire at its end, all of them if it is None."""
    names = [key, *field_names(machine.schema)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who: Any = fold
        state: list = []

        def ended() -> list[tuple]:
            return [] if who is fold else [(who, *x) for x in machine.advance(state, until if until is not None else 1 << 62)]

        for batch in batches:
            out: list[tuple] = []
            for k, (t, row) in zip(map(plain, batch[key].astype(object)), events_of(batch, at, machine.columns), strict=True):
                if k != who:
                    out += ended()
                    who, state = k, machine.start()
                out += [(k, *x) for x in machine.take(state, t, row)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias(at), *machine.columns)
    return rows.repartition(key).sortWithinPartitions(key, at, *machine.columns).mapInPandas(fold, f"`{key}` {kind}, {machine.schema}")


def preempted(checks: DataFrame, foreground: DataFrame, key: str = "device_id", width: int = 60_000) -> DataFrame:
    """Jobs (device_id, job_id) with the first stage at which the device's foreground (start, end) was busy, or null.

    ``checks`` has a row for each time that a job asks whether to go on (device_id, job_id, stage, at). Times
    meet intervals by cells of ``width``; a job that had to stop goes back to where it waits.
    """
    busy = intervals.merge(foreground.where("end > start").select(key, "start", "end"), [key])
    cells = busy.select(key, F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("__cell"))
    met = checks.withColumn("__cell", F.floor(F.col("at") / width)).join(cells, [key, "__cell"]).where("at >= __s AND at < __e")
    first = met.groupBy(key, "job_id").agg(F.min("stage").alias("stopped_at"))
    jobs = checks.select(key, "job_id").distinct().join(first, [key, "job_id"], "left")
    return jobs.select(key, "job_id", "stopped_at", F.when(F.col("stopped_at").isNull(), "ended").otherwise("local_pending").alias("state"))
