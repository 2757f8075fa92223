"""Another sample rate for audio that comes in chunks: the low-pass filter's history and the phase go on from chunk to chunk.

Chunks are rows (session_id, seq, samples: array of whole numbers). An input sample gives an output as often
as the running count of targets passes a whole number: after sample i there are floor((i + 1) * target / source)
outputs. A chunk is filtered as a block with the 62 samples before it, so how audio is cut changes nothing.

Defined cases: null or empty chunks give empty ones; before the first sample there is silence; null samples
are silence; equal rates give what came in. Sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.operators.splice import low_pass_weights

SCHEMA = "session_id {kind}, seq long, first long, samples array<int>"


def convert(samples: np.ndarray, tail: np.ndarray, seen: int, source: int, target: int, weights: np.ndarray) -> np.ndarray:
    """The outputs of a chunk after ``seen`` samples, the last of which are ``tail``."""
    if source == target or not len(samples):
        return samples
    filtered = np.correlate(np.concatenate([tail, samples]).astype(np.float64), weights, "valid")
    count = np.arange(seen, seen + len(samples) + 1, dtype=np.int64) * target // source
    out = np.repeat(filtered, np.diff(count))
    return np.clip(np.copysign(np.floor(np.abs(out) + 0.5), out), -32_768, 32_767).astype(np.int64)


def _samples(x: object) -> np.ndarray:
    return np.zeros(0, dtype=np.int64) if x is None else np.array([0 if v is None or v != v else v for v in x], dtype=np.int64)


class _Carried:
    """What goes from chunk to chunk."""

    def __init__(self, source: int, target: int, seen: int = 0, tail: list[int] | None = None):
        self.rates, self.weights = (source, target), np.array(low_pass_weights(source, target))
        self.seen, self.tail = seen, np.zeros(len(self.weights) - 1, dtype=np.int64) if tail is None else np.array(tail, dtype=np.int64)

    def take(self, chunk: object) -> tuple[int, list[int]]:
        """(number of the first output, the outputs)."""
        samples = _samples(chunk)
        source, target = self.rates
        first = self.seen * target // source
        out = convert(samples, self.tail, self.seen, source, target, self.weights)
        self.seen += len(samples)
        self.tail = np.concatenate([self.tail, samples])[-len(self.tail) :]
        return first, out.tolist()


def resampled(chunks: DataFrame, source: int, target: int) -> DataFrame:
    """(session_id, seq, first, samples): each chunk at the other rate; ``first`` counts the outputs before it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who: object = fold
        held = None
        for batch in batches:
            out = []
            for s, seq, samples in zip(batch["session_id"].astype(object).where(batch["session_id"].notna(), None), batch["seq"], batch["samples"], strict=True):
                if s != who:
                    who, held = s, _Carried(source, target)
                out.append((s, seq, *held.take(samples)))
            yield pd.DataFrame(out, columns=["session_id", "seq", "first", "samples"])

    kind = chunks.schema["session_id"].dataType.simpleString()
    rows = chunks.where("seq IS NOT NULL").select("session_id", F.col("seq").cast("long").alias("seq"), "samples")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(fold, SCHEMA.format(kind=kind))


def resampled_stream(chunks: DataFrame, source: int, target: int) -> DataFrame:
    """The same of a stream whose chunks of a session come in order: the state is the tail and the count."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _Carried(source, target, *state.get) if state.exists else _Carried(source, target)
        frame = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], seq, *held.take(samples)) for seq, samples in zip(frame["seq"], frame["samples"], strict=True)]
        state.update((held.seen, held.tail.tolist()))
        yield pd.DataFrame(out, columns=["session_id", "seq", "first", "samples"])

    kind = chunks.schema["session_id"].dataType.simpleString()
    rows = chunks.where("seq IS NOT NULL").select("session_id", F.col("seq").cast("long").alias("seq"), "samples")
    return rows.groupBy("session_id").applyInPandasWithState(fold, SCHEMA.format(kind=kind), "seen long, tail array<long>", "append", GroupStateTimeout.NoTimeout)


def since(samples: Column, first: int) -> Column:
    """The samples from number ``first`` on (from 0); none beyond the end."""
    return F.slice(samples, F.lit(max(0, first) + 1), F.greatest(F.size(samples) - max(0, first), F.lit(0)))
