"""The machines of ``vellum.operators.machines`` on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.operators.machines import Machine, events_of, field_names

STATE = "state string, waiting string"


def run_timed(events: DataFrame, machine: Machine, key: str, at: str = "at", delay: str = "10 seconds") -> DataFrame:
    """What the machine puts out over a stream whose ``at`` is a timestamp; machine times are milliseconds since 1970.

    Events wait in the state until the watermark has passed them, so a batch's cut and late rows within the
    delay change nothing: what comes out is what ``run`` gives for the same rows. Timers are the state's
    timeouts in event time: they fire without a further event of the key, as soon as the watermark passes
    them. Rows later than the delay are dropped by the watermark.
    """
    names = [key, *field_names(machine.schema)]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = map(json.loads, state.get) if state.exists else (machine.start(), [])
        if not state.hasTimedOut:
            for frame in frames:
                waiting += [[t, *row] for t, row in events_of(frame, "__at", machine.columns)]
            # None sorts first, as in tables.
            waiting.sort(key=lambda e: [e[0], *((x is not None, x) if x is not None else (False,) for x in e[1:])])
        mark, out, n = state.getCurrentWatermarkMs(), [], 0
        while n < len(waiting) and waiting[n][0] < mark:
            out += machine.take(held, waiting[n][0], tuple(waiting[n][1:]))
            n += 1
        del waiting[:n]
        out += machine.advance(held, mark, strictly=True)
        state.update((json.dumps(held), json.dumps(waiting)))
        ahead = [t for t in (machine.due(held), waiting[0][0] if waiting else None) if t is not None]
        if ahead:
            state.setTimeoutTimestamp(max(min(ahead), mark) + 1)
        yield pd.DataFrame([(group[0], *x) for x in out], columns=names)

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, delay).select(key, at, F.unix_millis(at).alias("__at"), *machine.columns)
    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, {machine.schema}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_ordered(events: DataFrame, machine: Machine, key: str, at: str = "at") -> DataFrame:
    """The same for streams whose rows of a key come in order from batch to batch, as frames of audio do: nothing waits, there are no timers."""
    names = [key, *field_names(machine.schema)]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else machine.start()
        frame = pd.concat(list(frames)).sort_values([at, *machine.columns])
        out = [x for t, row in events_of(frame, at, machine.columns) for x in machine.step(held, t, row)]
        state.update((json.dumps(held), "[]"))
        yield pd.DataFrame([(group[0], *x) for x in out], columns=names)

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, at, *machine.columns).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, {machine.schema}", STATE, "append", GroupStateTimeout.NoTimeout)
