"""From a recogniser's tokens to words, filters on its segments, and what a transcript needs to be used.

Tokens are rows (segment_id, token_ix, text, onset, guessed, probability, low, high, total): onset (``guessed`` if it
isn't aligned) and the segment's bounds (low, high) in samples, of an audio of ``total`` samples. All is windows by segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import intervals
from vellum.operators.control import first_reason

#: Above this share a segment is taken for silence, in a final and in a partial pass.
NO_SPEECH, PARTIAL_NO_SPEECH = 0.6, 0.6


def marks_only(text: Column) -> Column:
    """Whether a token, white space aside, has marks and nothing else."""
    return F.trim(text).rlike(r"^[^\p{IsAlphabetic}\p{N}]+$")


def grouped_words(tokens: DataFrame) -> DataFrame:
    """(segment_id, word_ix, text, start, end, confidence, unreliable) from tokens.

    A token that begins with white space begins a word, marks alone never do. A word starts at its first
    token's onset, held between the start of the word before and the segment's end, and ends where the next one
    starts; the last ends with the segment. The confidence is the least of its tokens', held to 0 to 1. A word
    with a guessed onset, with one before the start of the word before, or without length is unreliable.
    Segments are cut to the audio. Empty tokens are left out, and words of white space alone.
    """
    w = Window.partitionBy("segment_id").orderBy("token_ix")
    high = F.least("high", "total")
    rows = tokens.where(F.col("text") != "").select("segment_id", "token_ix", "text", "onset", "guessed", "probability", F.least("low", high).alias("low"), high.alias("high"))
    begins = (F.col("text").rlike(r"^\s") & ~marks_only(F.col("text"))) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("word_ix", F.sum(begins.cast("int")).over(w) - 1)
    words = rows.groupBy("segment_id", "word_ix").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_ix", "text"))), lambda x: x["text"]), "")).alias("text"),
        F.min_by("onset", "token_ix").alias("onset"), F.min("probability").alias("confidence"), F.bool_or("guessed").alias("guessed"), F.first("low").alias("low"), F.first("high").alias("high"),
    )
    order = Window.partitionBy("segment_id").orderBy("word_ix")
    start = F.least(F.greatest(F.max("onset").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("low")), F.col("high"))
    words = words.withColumn("start", start)
    words = words.withColumn("end", F.coalesce(F.lead("start").over(order), F.col("high")))
    early = F.col("onset") < F.coalesce(F.lag("start").over(order), F.col("low"))
    words = words.withColumns({"unreliable": F.col("guessed") | (F.col("end") == F.col("start")) | early, "confidence": F.when(F.isnan("confidence"), 0.0).otherwise(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))})
    return words.where("text <> ''").select("segment_id", F.col("word_ix").cast("long").alias("word_ix"), "text", "start", "end", "confidence", "unreliable")


def spoken_segments(segments: DataFrame, speech: DataFrame, most: float = NO_SPEECH) -> DataFrame:
    """Segments (session_id, start, end, no_speech) that aren't likely invented: not taken for silence, and some speech within.

    One window over both, by time: of the speech that begins before a segment ends, the latest end tells whether any of it
    lies within. Speech may come in any order and overlap; no segment is cut into cells, however long.
    """
    asked = segments.where((F.col("no_speech") <= most) & (F.col("end") > F.col("start")) & F.col("session_id").isNotNull()).select("*", F.col("end").alias("__at"), F.lit(0).alias("__kind"))
    heard = speech.where("end > start AND session_id IS NOT NULL").select("session_id", F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.col("end").alias("__heard"))
    order = Window.partitionBy("session_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(heard, allowMissingColumns=True).withColumn("__heard", F.max("__heard").over(order))
    return both.where("__kind = 0 AND __heard > start").select(*segments.columns)


def partial_segments(segments: DataFrame, offset: Column, most: float = PARTIAL_NO_SPEECH) -> DataFrame:
    """Segments of a partial pass, moved to the session's time; those likely silent go."""
    return segments.where(F.col("no_speech") < most).withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset})


def word_reason(start: Column, end: Column, confidence: Column) -> Column:
    """Why a word can't be: its times are turned round, or its confidence isn't in [0, 1]."""
    bad = confidence.isNull() | F.isnan(confidence) | ~confidence.between(0.0, 1.0)
    return first_reason([("word_times_inverted", end < start), ("word_confidence_invalid", bad)])


def unordered_words(words: DataFrame) -> DataFrame:
    """(session_id, word_id) of words whose id doesn't exceed the one before, in the order of ``pos``."""
    w = Window.partitionBy("session_id").orderBy("pos")
    return words.select("session_id", "word_id", F.lag("word_id").over(w).alias("__before")).where("word_id <= __before").drop("__before")


def usable_reason(words: Column, samples: Column) -> Column:
    return first_reason([("empty_transcript", F.coalesce(words, F.lit(0)) == 0), ("no_audio", F.coalesce(samples, F.lit(0)) == 0)])


def caption_tail(text: Column, n: int) -> Column:
    """The last n characters."""
    return F.when(F.char_length(text) > n, F.right(text, F.lit(n))).otherwise(text)


def prompts(words: DataFrame, windows: DataFrame) -> DataFrame:
    """(session_id, window_ix, first_id, last_id, prompt): the words of each window as ``id:word``, one a line.

    Words meet windows by blocks of 64 ids, so a word meets the few windows near it only.
    """
    block = 64
    cells = F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor((F.col("stop_word") - 1) / block)))
    dealt = windows.where("stop_word > first_word").select("session_id", "window_ix", "first_word", "stop_word", cells.alias("__cell"))
    met = words.select("session_id", "word_id", "text", F.floor(F.col("word_id") / block).alias("__cell")).join(dealt, ["session_id", "__cell"]).where("word_id >= first_word AND word_id < stop_word")
    line = F.concat(F.col("word_id").cast("string"), F.lit(":"), F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_id", line.alias("line")))), lambda x: x["line"])
    return met.groupBy("session_id", "window_ix").agg(F.min("word_id").alias("first_id"), F.max("word_id").alias("last_id"), F.array_join(listed, "\n").alias("prompt"))


def uncovered_words(words: DataFrame, windows: DataFrame) -> DataFrame:
    """(session_id, word_id) of words that no window shows; windows that overlap count once."""
    seen = intervals.merge(windows.select("session_id", F.col("first_word").alias("start"), F.col("stop_word").alias("end")), ["session_id"])
    one = words.select("session_id", F.col("word_id").alias("start"), (F.col("word_id") + 1).alias("end"))
    covered = intervals.overlap_lengths(one, seen, ["session_id"], 256)
    return covered.where("covered = 0").select("session_id", F.col("start").alias("word_id"))
