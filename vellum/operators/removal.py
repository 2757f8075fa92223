"""From sensitive spans to retained clips: sentences, expansion, padded removal to a fixed point, clips.

Words are rows (session_id, word_id, text, display, start, end, confidence, unreliable) with word_id
counting from 0. Everything is a window, an equi-join or an aggregate by session; there is no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numbers import clip_milliseconds, weighted_mean
from vellum.operators import intervals
from vellum.operators.control import first_reason

#: Fixed values, in samples of 16 kHz: a pause that ends a sentence (700 ms), the padding of a removal (250 ms).
PAUSE, PADDING = 11_200, 4000
KEY = ["session_id"]
#: Problems of timings that refuse a whole session.
FATAL = ("overlapping_or_nonmonotonic", "word_outside_audio", "zero_length_word", "empty_word_text")


def with_sentences(words: DataFrame, pause: int = PAUSE) -> DataFrame:
    """``sentence_ix``: a sentence ends at a closing mark or before a long pause."""
    w = Window.partitionBy("session_id").orderBy("word_id")
    ends = F.col("display").rlike(r"[.!?]\s*$") | F.coalesce(F.lead("start").over(w) - F.col("end") >= pause, F.lit(False))
    marked = words.withColumn("__ends", ends.cast("int"))
    return marked.withColumn("sentence_ix", F.coalesce(F.sum("__ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__ends")


def sentences(words: DataFrame) -> DataFrame:
    """(session_id, sentence_ix, first_word, stop_word, start, end) of words with sentences."""
    return words.groupBy("session_id", "sentence_ix").agg(
        F.min("word_id").alias("first_word"), (F.max("word_id") + 1).alias("stop_word"), F.min_by("start", "word_id").alias("start"), F.max_by("end", "word_id").alias("end")
    )


def alignment_problems(words: DataFrame, bounds: DataFrame, least: float = 0.45) -> DataFrame:
    """(session_id, problems): what is wrong with a session's timings, sorted. Order is checked against the word before."""
    w = Window.partitionBy("session_id").orderBy("word_id")
    rows = words.join(bounds, "session_id")
    empty = F.col("start") == F.col("end")
    checks = {
        "empty_word_text": F.trim("text") == "", "zero_length_word": empty & ~F.col("unreliable"), "overlapping_or_nonmonotonic": F.col("start") < F.lag("end").over(w),
        "word_outside_audio": (F.col("start") < F.col("low")) | (F.col("end") > F.col("high")), "low_confidence_word": F.col("confidence") < F.lit(least).cast("float"), "unreliable_timing": F.col("unreliable"),
    }
    first = F.lag("end").over(w).isNull() & (F.col("start") < F.col("low"))
    checks["overlapping_or_nonmonotonic"] = F.coalesce(checks["overlapping_or_nonmonotonic"], F.lit(False)) | first
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return rows.select("session_id", found.alias("p")).groupBy("session_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("problems"))


def unusable_sentences(words: DataFrame, least: float = 0.45) -> DataFrame:
    return words.where((F.col("confidence") < F.lit(least).cast("float")) | F.col("unreliable")).select("session_id", "sentence_ix").distinct()


def touched_sentences(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The sentences that spans (session_id, start, stop as word ids) reach into."""
    own = words.select("session_id", "word_id", "sentence_ix")
    ends = spans.where("stop > start").select("session_id", F.explode(F.array("start", F.col("stop") - 1)).alias("word_id"), "start", "stop").distinct()
    found = ends.join(own, ["session_id", "word_id"]).groupBy("session_id", "start", "stop").agg(F.min("sentence_ix").alias("a"), F.max("sentence_ix").alias("b"))
    return found.select("session_id", F.explode(F.sequence("a", "b")).alias("sentence_ix")).distinct()


def removed_words(words: DataFrame, dropped: DataFrame, bounds: DataFrame, padding: int = PADDING, own: DataFrame | None = None) -> DataFrame:
    """``words`` with ``removed``: those of dropped sentences, those of ``own`` (session_id, word_id), and all that padded cuts reach, to the fixed point.

    Words nearer to each other than the padding form islands; a cut that touches one takes all of it.
    That needs words in time order, which ``alignment_problems`` tells. Words without length go if they
    lie strictly inside a cut.
    """
    seeded = words.join(dropped.withColumn("__seed", F.lit(1)), ["session_id", "sentence_ix"], "left").join(bounds.select("session_id", "low", "high"), "session_id")
    if own is not None:
        seeded = seeded.join(own.select("session_id", "word_id", F.lit(1).alias("__own")), ["session_id", "word_id"], "left").withColumn("__seed", F.coalesce("__seed", "__own")).drop("__own")
    w = Window.partitionBy("session_id", "__long").orderBy("start", "word_id")
    rows = seeded.withColumn("__long", F.col("end") > F.col("start"))
    rows = rows.withColumn("__new", F.coalesce(F.col("start") - F.lag("end").over(w) >= padding, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = F.max("__seed").over(Window.partitionBy("session_id", "__long", "__island")).isNotNull()
    rows = rows.withColumn("__gone", F.col("__seed").isNotNull() | (F.col("__long") & island))
    order = Window.partitionBy("session_id").orderBy("start", "word_id")
    cut = F.col("__gone") & F.col("__long")
    before = F.max(F.when(cut, F.least(F.col("end") + padding, F.col("high")))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(cut, F.greatest(F.col("start") - padding, F.col("low")))).over(order.rowsBetween(1, Window.unboundedFollowing))
    inside = ~F.col("__long") & (F.coalesce(F.col("start") < before, F.lit(False)) | F.coalesce(F.col("start") > after, F.lit(False)))
    return rows.withColumn("removed", F.col("__gone") | inside).drop("__seed", "__long", "__new", "__island", "__gone", "low", "high")


def removed_intervals(words: DataFrame, dropped: DataFrame, bounds: DataFrame, padding: int = PADDING) -> DataFrame:
    """(session_id, start, end): the merged, padded cuts of words with ``removed`` and of whole sentences."""
    whole = sentences(words).join(dropped, ["session_id", "sentence_ix"], "left_semi").select("session_id", "start", "end")
    merged = intervals.merge(words.where("removed").select("session_id", "start", "end").union(whole), KEY)
    grown = merged.join(bounds, "session_id")
    s, e = intervals.padded(F.col("start"), F.col("end"), padding, F.col("low"), F.col("high"))
    return intervals.merge(grown.select("session_id", s.alias("start"), e.alias("end")), KEY)


def clip_words(words: DataFrame, retained: DataFrame) -> DataFrame:
    """Words not removed that lie wholly in a retained interval, with it: clip_start, clip_end.

    The interval of a word is the last that starts no later: one window over both, ordered by time.
    """
    both = words.where(~F.col("removed")).select("session_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.struct("word_id", "display", "text", "start", "end", "confidence").alias("w"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("c"))
    clips = retained.select("session_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(both.schema["w"].dataType).alias("w"), F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("c"))
    last = F.last("c", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.unionByName(clips).withColumn("c", last).where("kind = 1 AND c IS NOT NULL AND w.end <= c.e")
    return placed.select("session_id", "w.*", F.col("c.s").alias("clip_start"), F.col("c.e").alias("clip_end"))


def clip_reason(duration: Column, words: Column, text: Column, confidence: Column, speech: Column, least_ms: int = 1000, most_ms: int = 30_000, least_words: int = 3, least_confidence: float = 0.6, least_speech: float = 0.35) -> Column:
    """The first gate that a clip fails, or null."""
    low = lambda x, bound: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < F.lit(bound).cast("float"))
    return first_reason([
        ("clip_too_short", duration < least_ms), ("clip_too_long", duration > most_ms), ("clip_too_few_words", words < least_words), ("clip_empty_text", F.trim(text) == ""),
        ("clip_low_confidence", low(confidence, least_confidence)), ("clip_mostly_silence", low(speech, least_speech)),
    ])


def consistency_reason(aligned: Column, speech: Column, ratio: Column, least: float = 0.35) -> Column:
    """Whether text and audio agree: enough speech, and most of it explained by words (in integers)."""
    bad = ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf")) | (ratio < F.lit(least).cast("float"))
    return first_reason([("clip_no_speech_detected", bad), ("unexplained_speech_in_clip", (speech > 0) & (aligned * 100 < speech * 45))])


def session_reason(clips: Column, total: Column, least_ms: int = 1500, most_ms: int = 600_000) -> Column:
    return first_reason([("no_retained_clips", clips == 0), ("retained_audio_too_short", total < least_ms), ("retained_audio_too_long", total > most_ms)])


def early_reason(analysis_reason: Column, uncertain: Column, words: Column, samples: Column, language: Column, silent: Column, problems: Column) -> Column:
    """Why a session is refused before anything is cut, in this order: what the analysis said, an uncertain
    analysis, no words, no audio, another language, silence, timings that can't be used. ``problems`` are those of
    ``alignment_problems``, null if none. Unknown language and length are refused, unknown flags are not.
    """
    checks = [
        ("uncertain_analysis", uncertain), ("empty_transcript", F.coalesce(words, F.lit(0)) == 0), ("no_audio", F.coalesce(samples, F.lit(0)) == 0), ("language_not_validated", F.coalesce(language != "en", F.lit(True))),
        ("session_silent", silent), ("alignment_unusable", F.arrays_overlap(problems, F.array(*map(F.lit, FATAL)))),
    ]
    return F.coalesce(analysis_reason, first_reason(checks))


def spliced(made: DataFrame) -> DataFrame:
    """(session_id, text): the texts of the clips that pass their gates, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("clip_ix", "text"))), lambda x: x["text"])
    return made.where("reason IS NULL").groupBy("session_id").agg(F.array_join(ordered, " ").alias("text"))


def clips(words: DataFrame, retained: DataFrame) -> DataFrame:
    """A row per retained interval: its index, length, words, text, mean confidence, speech ratio and the gate it fails."""
    inside = clip_words(words, retained)
    per = inside.groupBy("session_id", F.col("clip_start").alias("start"), F.col("clip_end").alias("end")).agg(
        F.count("*").alias("word_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "display"))), lambda x: x["display"]), " ").alias("text"),
        weighted_mean(F.col("confidence"), F.lit(1)).alias("mean_confidence"), F.sum(F.col("end") - F.col("start")).alias("aligned"),
    )
    numbered = retained.withColumn("clip_ix", F.row_number().over(Window.partitionBy("session_id").orderBy("start")) - 1)
    out = numbered.join(per, ["session_id", "start", "end"], "left").select(
        "session_id", "clip_ix", "start", "end", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("mean_confidence", F.lit(0.0).cast("float")).alias("mean_confidence"),
        F.coalesce("aligned", F.lit(0)).alias("aligned"),
    )
    out = out.withColumns({"duration_ms": clip_milliseconds(F.col("end") - F.col("start")), "speech_ratio": (F.col("aligned") / (F.col("end") - F.col("start"))).cast("float")})
    gate = clip_reason(F.col("duration_ms"), F.col("word_count"), F.col("text"), F.col("mean_confidence"), F.col("speech_ratio"))
    return out.withColumn("reason", F.coalesce(gate, consistency_reason(F.col("aligned"), F.col("aligned"), F.col("speech_ratio"))))


def content_hash(ix: Column, text: Column) -> Column:
    """An aggregate: SHA-256 of the texts in order, a NUL after each."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ix.alias("ix"), text.alias("text")))), lambda x: F.concat(x["text"], F.char(F.lit(0))))
    return F.sha2(F.array_join(ordered, ""), 256)


def session_results(sessions: DataFrame, made: DataFrame, seen: DataFrame | None = None, unclean: DataFrame | None = None) -> DataFrame:
    """(session_id, reason, clips, words, duration_ms, mean_confidence, content_hash).

    ``sessions`` has session_id and early_reason (null where nothing spoke against it before). Of sessions
    with the same content the smallest id stays; ``seen`` holds hashes of earlier ones. ``unclean`` has the
    session_id of those whose retained text was checked once more and isn't clean.
    """
    good = made.where("reason IS NULL").groupBy("session_id").agg(
        F.count("*").alias("clips"), F.sum("word_count").alias("words"), F.sum("duration_ms").alias("duration_ms"), weighted_mean(F.col("mean_confidence"), F.col("word_count")).alias("mean_confidence"),
        content_hash(F.col("clip_ix"), F.col("text")).alias("content_hash"),
    )
    any_clip = made.select("session_id").distinct().withColumn("__any", F.lit(True))
    rows = sessions.join(any_clip, "session_id", "left").join(good, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    reason = F.coalesce("early_reason", first_reason([("fully_redacted", F.col("__any").isNull())]), session_reason(zero("clips"), zero("duration_ms")))
    if unclean is not None:
        rows = rows.join(unclean.select("session_id").distinct().withColumn("__unclean", F.lit(True)), "session_id", "left")
        reason = F.coalesce(reason, first_reason([("sensitive_after_removal", F.col("__unclean"))]))
    rows = rows.withColumn("reason", reason)
    first = rows.where("reason IS NULL").groupBy("content_hash").agg(F.min("session_id").alias("__first"))
    rows = rows.join(first, "content_hash", "left")
    duplicate = F.col("reason").isNull() & (F.col("__first") != F.col("session_id"))
    if seen is not None:
        rows = rows.join(seen.select("content_hash", F.lit(True).alias("__seen")).distinct(), "content_hash", "left")
        duplicate = duplicate | (F.col("reason").isNull() & F.col("__seen"))
    reason = F.when(duplicate, "duplicate_example").otherwise(F.col("reason"))
    return rows.select("session_id", reason.alias("reason"), zero("clips").alias("clips"), zero("words").alias("words"), zero("duration_ms").alias("duration_ms"), "mean_confidence", F.when(reason.isNull(), F.col("content_hash")).alias("content_hash"))
