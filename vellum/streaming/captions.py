"""Streaming forms of the stateful operators, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values, in samples of 16 kHz: how old a segment must be to be final (1 s), the longest open tail (20 s).
MARGIN, LONGEST_TAIL = 16_000, 320_000
UPDATES = "session_id string, segment_id string, revision long, start long, end long, text string"
_STATE = "committed long, next_index long, segment_id string, revision long, text string"


def reconcile(passes: DataFrame, margin: int = MARGIN, longest: int = LONGEST_TAIL) -> DataFrame:
    """Caption updates from recognition passes (session_id, seq, audio_end, segments: array of text, start, end).

    All segments but the last that ended before the margin become final, or all but the last when the
    open tail is too long; what remains is one provisional row whose revision counts up when its text
    changes. Passes of a session are taken in order of seq within a batch.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        committed, index, held, revision, text = state.get if state.exists else (0, 0, None, 0, None)
        out: list[tuple] = []
        for p in pd.concat(list(frames)).sort_values("seq").itertuples():
            segments = list(p.segments) if p.segments is not None else []
            force = p.audio_end - committed > longest
            while len(segments) > 1 and (force or segments[0]["end"] <= max(0, p.audio_end - margin)):
                s = segments.pop(0)
                if held is None:
                    held, revision, index = f"segment-{index}", 0, index + 1
                out.append((key[0], held, revision + 1, s["start"], s["end"], s["text"].strip()))
                committed, held, text = max(committed, s["end"]), None, None
            tail = " ".join(x for x in (s["text"].strip() for s in segments) if x)
            if not tail or (held is not None and tail == text):
                continue
            if held is None:
                held, revision, index = f"segment-{index}", 0, index + 1
            revision, text = revision + 1, tail
            out.append((key[0], held, revision, segments[0]["start"], segments[-1]["end"], tail))
        state.update((int(committed), int(index), held, int(revision), text))
        yield pd.DataFrame(out, columns=["session_id", "segment_id", "revision", "start", "end", "text"])

    return passes.groupBy("session_id").applyInPandasWithState(fold, UPDATES, _STATE, "append", GroupStateTimeout.NoTimeout)


def current_captions(updates: DataFrame) -> DataFrame:
    """The latest revision of each segment."""
    return updates.groupBy("session_id", "segment_id").agg(F.max_by(F.struct("start", "end", "text"), "revision").alias("s"), F.max("revision").alias("revision")).select("session_id", "segment_id", "revision", "s.*")


def first_receipts(requests: DataFrame, key: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Idempotent ingest: of requests with a key, those after the first within the delay are dropped."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def daily_counts(requests: DataFrame, by: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Requests per key and UTC day; a day is final once the watermark has passed it."""
    return requests.withWatermark(at, delay).groupBy(*by, F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("day"), "n")


def throttle(failures: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """(address, at, failures, blocked) per failure (address, at in seconds): counted from the first of a span on."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, n = state.get if state.exists else (None, 0)
        out = []
        for at in pd.concat(list(frames))["at"].sort_values():
            if since is None or at - since >= seconds:
                since, n = int(at), 0
            n += 1
            out.append((key[0], int(at), n, n >= most))
        state.update((since, n))
        yield pd.DataFrame(out, columns=["address", "at", "failures", "blocked"])

    return failures.groupBy("address").applyInPandasWithState(fold, "address string, at long, failures long, blocked boolean", "since long, n long", "append", GroupStateTimeout.NoTimeout)


def latest_epoch(completions: DataFrame) -> DataFrame:
    """Completions (session_id, epoch, seq, ...) without those of an epoch older than one seen before."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (-1,)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.epoch >= seen:
                seen = int(r.epoch)
                out.append((key[0], r.epoch, r.seq))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["session_id", "epoch", "seq"])

    return completions.groupBy("session_id").applyInPandasWithState(fold, "session_id string, epoch long, seq long", "seen long", "append", GroupStateTimeout.NoTimeout)
