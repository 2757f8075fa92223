"""Retained clips put one after another: times, words, text and samples on the new timeline.

Clips are rows (session_id, clip_ix, start, end) in the source's samples; their places on the new timeline
are running sums of their lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

KEY = ["session_id"]


def placed(clips: DataFrame) -> DataFrame:
    """``clips`` with ``shift``: what to add to a time of the source."""
    w = Window.partitionBy(*KEY).orderBy("clip_ix").rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("shift", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)) - F.col("start"))


def mapped(times: DataFrame, clips: DataFrame, width: int = 16_000) -> DataFrame:
    """``times`` (session_id, at, ...) with ``to``: where each lies on the new timeline; null outside all clips.

    Times meet clips by cells of ``width`` samples; no join compares ranges alone.
    """
    cell = lambda x: F.floor(x / width)
    dealt = placed(clips).where("end > start").select(*KEY, F.col("start").alias("__s"), F.col("end").alias("__e"), "shift", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("__cell"))
    inside = (times["session_id"] == dealt["session_id"]) & (cell(F.col("at")) == F.col("__cell")) & (F.col("at") >= F.col("__s")) & (F.col("at") < F.col("__e"))
    return times.join(dealt, inside, "left").select(*(times[c] for c in times.columns), (F.col("at") + F.col("shift")).alias("to"))


def renumbered(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Words with clip_ix (session_id, clip_ix, word_id, text, start, end), counted from 0 and moved to the new timeline."""
    joined = words.join(placed(clips).select(*KEY, "clip_ix", "shift"), [*KEY, "clip_ix"])
    ix = F.row_number().over(Window.partitionBy(*KEY).orderBy("clip_ix", "word_id")) - 1
    return joined.select(*KEY, ix.cast("long").alias("word_id"), "text", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))


def spliced_text(clips: DataFrame) -> DataFrame:
    """(session_id, text): one clip a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("clip_ix", "text"))), lambda x: x["text"])
    return clips.groupBy(*KEY).agg(F.array_join(lines, "\n").alias("text"))


def spoken_text(words: DataFrame) -> DataFrame:
    """(session_id, text): words in spoken form, one space between them."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_id", T.spoken(F.col("text")).alias("t")))), lambda x: x["t"])
    return words.groupBy(*KEY).agg(F.array_join(F.filter(listed, lambda t: t != ""), " ").alias("text"))


def clip_samples(audio: Column, start: Column, end: Column) -> Column:
    """The samples of an interval, null where it reaches outside the audio."""
    inside = (start >= 0) & (end >= start) & (end <= F.size(audio))
    return F.when(inside, F.slice(audio, F.when(inside, start + 1).otherwise(1).cast("int"), F.when(inside, end - start).otherwise(0).cast("int")))


def spliced_samples(clips: DataFrame) -> DataFrame:
    """(session_id, samples) of clips with samples, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("clip_ix", "samples"))), lambda x: x["samples"])
    return clips.groupBy(*KEY).agg(F.flatten(ordered).alias("samples"))


def broken_sessions(words: DataFrame, clips: DataFrame, removed: DataFrame) -> DataFrame:
    """(session_id, problem) where the result can't be what it should: the first of four invariants that fails.

    Clips follow each other without overlap, none is empty, none meets a removed interval, and each word
    (with clip_ix) lies in its clip.
    """
    w = Window.partitionBy(*KEY).orderBy("clip_ix")
    rows = clips.withColumn("__before", F.lag("end").over(w))
    found = [rows.where("end <= start").select(*KEY, F.lit("0_empty_clip").alias("p")), rows.where("start < __before").select(*KEY, F.lit("1_clips_overlap").alias("p"))]
    both = clips.select(*KEY, "start", "end", F.lit(0).alias("gone")).union(removed.select(*KEY, "start", "end", F.lit(1)))
    # In time order an interval meets one of the other kind if it starts before the latest end of those.
    before = Window.partitionBy(*KEY).orderBy("start", "end", "gone").rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda kind: F.max(F.when(F.col("gone") == kind, F.col("end"))).over(before)
    met = F.when(F.col("gone") == 0, F.col("start") < reach(1)).otherwise(F.col("start") < reach(0))
    found.append(both.where("end > start").withColumn("__met", met).where("__met").select(*KEY, F.lit("2_removed_audio_kept").alias("p")))
    outside = words.join(clips.select(*KEY, "clip_ix", F.col("start").alias("__s"), F.col("end").alias("__e")), [*KEY, "clip_ix"], "left").where("__s IS NULL OR start < __s OR end > __e")
    found.append(outside.select(*KEY, F.lit("3_word_outside_clip").alias("p")))
    every = found[0].union(found[1]).union(found[2]).union(found[3])
    return every.groupBy(*KEY).agg(F.substring(F.min("p"), 3, 100).alias("problem"))


def mono(left: Column, right: Column) -> Column:
    """The mean of two channels in whole numbers, towards zero."""
    total = left + right
    return (F.signum(total) * F.floor(F.abs(total) / 2)).cast("long")


def low_pass_weights(source: int, target: int, taps: int = 63) -> list[float]:
    """Weights of a windowed sinc (Blackman) that cuts at 0.45 of the lower rate; they sum to 1."""
    cut, middle = 0.45 * min(source, target) / source, (taps - 1) / 2
    out = []
    for k in range(taps):
        x = k - middle
        sinc = 2 * cut if x == 0 else math.sin(2 * math.pi * cut * x) / (math.pi * x)
        out.append(sinc * (0.42 - 0.5 * math.cos(2 * math.pi * k / (taps - 1)) + 0.08 * math.cos(4 * math.pi * k / (taps - 1))))
    total = sum(out)
    return [x / total for x in out]


def resampled(filtered: DataFrame, source: int, target: int) -> DataFrame:
    """(session_id, pos, value): of filtered samples (session_id, pos, filtered), those nearest before each time of the other rate.

    Output n lies at n * source / target; the weights of a sample are its own, so sessions need no order here.
    """
    first = F.ceil(F.col("pos") * target / source).cast("long")
    stop = F.ceil((F.col("pos") + 1) * target / source).cast("long")
    value = F.least(F.greatest(F.round("filtered"), F.lit(-32_768)), F.lit(32_767)).cast("long")
    rows = filtered.select(*KEY, first.alias("a"), stop.alias("b"), value.alias("value")).where("b > a")
    return rows.select(*KEY, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("pos"), "value")


def bounded(frames: DataFrame, most: int) -> DataFrame:
    """Frames (session_id, seq, size) with ``accepted``: a frame that doesn't fit whole is refused, and so are all after it."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    # Up to the first refusal all were accepted, so the plain running sum tells where it is.
    total = F.sum("size").over(w)
    return frames.withColumn("accepted", F.max(F.when(total > most, 1).otherwise(0)).over(w) == 0)
