"""Voice activity from audio samples: frame levels, noise floor, hysteresis, speech runs.

Samples are rows (session_id, pos, value) or arrays per session; a frame is 20 ms at 16 kHz.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import intervals

#: Samples of a frame, levels in dB, frames to open and to close, the ratio of a silent session.
FRAME, SILENT_DB, OVER_FLOOR_DB, LEAST_DB, OPEN, CLOSE, SILENT_RATIO = 320, -120.0, 9.0, -55.0, 2, 8, 0.08


def levels(samples: DataFrame, frame: int = FRAME) -> DataFrame:
    """(session_id, frame_ix, size, level): decibels of each frame's mean energy."""
    x = F.col("value") / F.lit(32_768.0)
    rows = samples.groupBy("session_id", F.floor(F.col("pos") / frame).alias("frame_ix")).agg(F.avg(x * x).alias("mean"), F.count("*").alias("size"))
    return rows.select("session_id", "frame_ix", "size", F.when(F.col("mean") <= 1e-12, F.lit(SILENT_DB)).otherwise(10.0 * F.log10("mean")).cast("float").alias("level"))


def floors(frames: DataFrame) -> DataFrame:
    """(session_id, floor): the level at rank max(1, n div 5)."""
    w = Window.partitionBy("session_id")
    ranked = frames.select("session_id", "level", F.row_number().over(w.orderBy("level")).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("r") == F.greatest(F.lit(1), F.floor(F.col("n") / 5))).select("session_id", F.col("level").alias("floor"))


def speaking(frames: DataFrame, open_frames: int = OPEN, close_frames: int = CLOSE) -> DataFrame:
    """Frames (session_id, frame_ix, loud) with ``speech``: on from the frame that makes a run of loud ones long enough, off from one that does so for quiet ones."""
    w = Window.partitionBy("session_id").orderBy("frame_ix")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("__n", F.row_number().over(w))
    since = lambda loud: F.col("__n") - F.coalesce(F.max(F.when(F.col("loud") != F.lit(loud), F.col("__n"))).over(so_far), F.lit(0))
    turn = F.when(since(True) >= open_frames, True).when(since(False) >= close_frames, False)
    rows = rows.withColumn("__turn", turn)
    return rows.withColumn("speech", F.coalesce(F.last("__turn", ignorenulls=True).over(so_far), F.lit(False))).drop("__n", "__turn")


def activity(frames: DataFrame, over: float = OVER_FLOOR_DB, least: float = LEAST_DB) -> DataFrame:
    """(session_id, frame_ix, size, speech) per frame."""
    threshold = F.greatest(F.col("floor") + F.lit(over).cast("float"), F.lit(least).cast("float"))
    rows = frames.join(floors(frames), "session_id").withColumn("loud", F.col("level") >= threshold)
    return speaking(rows).select("session_id", "frame_ix", "size", "speech")


def speech_intervals(active: DataFrame, frame: int = FRAME) -> DataFrame:
    """(session_id, start, end) of the runs of speech frames."""
    start = F.col("frame_ix") * frame
    return intervals.merge(active.where("speech").select("session_id", start.alias("start"), (start + F.col("size")).alias("end")), ["session_id"])


def speech_ratios(active: DataFrame) -> DataFrame:
    """(session_id, ratio, silent)."""
    spoken, total = F.sum(F.when(F.col("speech"), F.col("size")).otherwise(0)), F.sum("size")
    ratio = F.coalesce(spoken / F.nullif(total, F.lit(0)), F.lit(0.0)).cast("float")
    return active.groupBy("session_id").agg(ratio.alias("ratio")).withColumn("silent", F.col("ratio") < F.lit(SILENT_RATIO).cast("float"))


def low_pass(samples: DataFrame, weights: list[float]) -> DataFrame:
    """``filtered``: the weighted sum of each sample and those before it; before the first there is silence."""
    w = Window.partitionBy("session_id").orderBy("pos")
    total = sum((F.coalesce(F.lag("value", k).over(w), F.lit(0)) * F.lit(c) for k, c in enumerate(weights) if k), F.col("value") * F.lit(weights[0]))
    return samples.withColumn("filtered", total)
