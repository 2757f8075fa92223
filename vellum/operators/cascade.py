"""A session's whole way to a training copy: analysis, ordered exits, cuts, clips, and the same analysis of what is left.

Words are rows (session_id, word_id, text, display, start, end, confidence, unreliable), word_id counting
from 0 within a session and displays without white space. Sessions are rows (session_id, language,
total_samples, samples): the length that the transcript states, and that of the audio. Speech is rows
(session_id, start, end), merged, as ``vad.speech_intervals`` gives them.

Every step is by session. Sessions that nothing is cut from skip the windows over their words: their one
clip is the whole audio. Words of a transcript meet in one row for the detectors, as large as its text.

Defined cases: sessions without words, audio or speech have their reasons; rows of words, speech or spans
without a session are not looked at; a null session_id is left out; a repeated session row counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numbers import clip_milliseconds, weighted_mean
from vellum.operators import detect, intervals, recognised, records, removal, splice, vad
from vellum.operators.control import first_reason
from vellum.operators.storage import kept

#: A function of the prompts' column: struct<answer:string, failure:string>, where a failure is a reason code.
Classifier = Callable[[Column], Column]
#: A function of the retained transcripts' words: (session_id, reason) of those that aren't clean.
Recheck = Callable[[DataFrame], DataFrame]
#: Width of the cells in which speech meets clips (30 s at 16 kHz).
CELL = 480_000
SPAN = ["session_id", "start", "stop", "category", "action", "source"]


def transcripts(words: DataFrame) -> DataFrame:
    """(session_id, display, spoken, n_words, ends): a row for each session; ends are the positions after its sentences."""
    marked = removal.with_sentences(words) if "sentence_ix" not in words.columns else words
    clean = F.translate(F.col("display"), detect.OPEN + detect.CLOSE, "")
    listed = F.array_sort(F.collect_list(F.struct("word_id", clean.alias("display"), "text", "sentence_ix")))
    rows = marked.groupBy("session_id").agg(listed.alias("w"))
    last = F.transform("w", lambda x, i: F.when((i + 1 == F.size("w")) | (x["sentence_ix"] != F.get("w", i + 1)["sentence_ix"]), i + 1))
    return rows.select("session_id", F.col("w.display").alias("display"), F.col("w.text").alias("spoken"), F.size("w").alias("n_words"), F.array_compact(last).alias("ends"))


def analysed(words: DataFrame, classify: Classifier | None = None, private_terms: Sequence[str] = (), find: Callable[[DataFrame], DataFrame] | None = None, size: int = 220, overlap: int = 40, word_cuts: bool = False) -> tuple[DataFrame, DataFrame]:
    """((session_id, reason, uncertain), spans): detectors and a model together; a model can only add.

    A session is refused where a window gets no answer (the failure's code) or one of another form
    (``schema_violation``), the first window first, and where no window shows one of its words
    (``window_coverage_gap``). It is uncertain where the model says so or a detector finds an attempt to
    instruct it. ``find`` takes the transcripts and gives hits; all detectors unless told otherwise.
    """
    rows = kept(transcripts(words))
    hits = kept((find or (lambda x: detect.hits(x, private_terms)))(rows.select("session_id", "display", "spoken")))
    told = hits.where(F.col("detector") == "injection_attempt").select("session_id", F.lit(True).alias("told")).distinct()
    out = rows.select("session_id").join(told, "session_id", "left")
    if classify is None:
        return out.select("session_id", F.lit(None).cast("string").alias("reason"), F.coalesce("told", F.lit(False)).alias("uncertain")), detect.spans(hits).select(*SPAN)
    windows = kept(records.classifier_windows(rows, size, overlap))
    asked = recognised.prompts(words, windows).join(windows, ["session_id", "window_ix"])
    answered = asked.withColumn("said", classify(F.col("prompt"))).select("session_id", "window_ix", "first_word", "stop_word", F.col("said.answer").alias("answer"), F.col("said.failure").alias("failure"))
    judged = kept(records.classifier_answers(answered, word_cuts=word_cuts))
    why = F.coalesce("failure", F.when(F.col("answer").isNull(), "privacy_worker_unavailable"), F.when(F.col("reason").isNotNull(), "schema_violation"))
    by_session = judged.withColumn("why", why).groupBy("session_id").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("window_ix", "why"))).alias("first"), F.max("uncertain").alias("unsure"))
    gaps = recognised.uncovered_words(words, windows).select("session_id", F.lit(True).alias("gap")).distinct()
    out = out.join(by_session, "session_id", "left").join(gaps, "session_id", "left")
    reason = F.coalesce(F.when(F.col("gap"), "window_coverage_gap"), F.col("first.why"))
    model = judged.where(why.isNull()).select("session_id", F.explode("spans").alias("s")).select("session_id", "s.start", "s.stop", "s.category", "s.action", F.lit("model").alias("source"))
    return out.select("session_id", reason.alias("reason"), (F.coalesce("told", F.lit(False)) | F.coalesce("unsure", F.lit(False)) | reason.isNotNull()).alias("uncertain")), detect.spans(hits, model).select(*SPAN)


def analysis_recheck(classify: Classifier | None = None, private_terms: Sequence[str] = (), find: Callable[[DataFrame], DataFrame] | None = None) -> Recheck:
    """The whole analysis once more over what is left: its refusal, an uncertain one, or any span refuses."""

    def check(retained: DataFrame) -> DataFrame:
        analysis, spans = analysed(retained, classify, private_terms, find)
        found = analysis.join(spans.select("session_id", F.lit(True).alias("any")).distinct(), "session_id", "left")
        reason = F.coalesce(F.when(F.col("reason") == "empty_transcript", "empty_after_removal").otherwise(F.col("reason")), first_reason([("uncertain_after_removal", F.col("uncertain")), ("sensitive_after_removal", F.col("any"))]))
        return found.select("session_id", reason.alias("reason")).where("reason IS NOT NULL")

    return check


def early_exits(sessions: DataFrame, words: DataFrame, speech: DataFrame, analysis: DataFrame) -> DataFrame:
    """``sessions`` with early_reason: the exits before anything is cut, in order."""
    counted = words.groupBy("session_id").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    heard = speech.groupBy("session_id").agg(F.sum(F.col("end") - F.col("start")).alias("heard"))
    bounds = sessions.select("session_id", F.lit(0).cast("long").alias("low"), F.col("samples").alias("high"))
    rows = sessions.join(counted, "session_id", "left").join(heard, "session_id", "left").join(removal.alignment_problems(words, bounds), "session_id", "left").join(analysis.select("session_id", F.col("reason").alias("said"), "uncertain"), "session_id", "left")
    silent = F.coalesce((F.coalesce("heard", F.lit(0)) / F.nullif("samples", F.lit(0))).cast("float"), F.lit(0.0)) < F.lit(vad.SILENT_RATIO).cast("float")
    span = F.greatest(F.coalesce("total_samples", F.lit(0)), F.coalesce("last", F.lit(0)))
    # A transcript without words is refused by the analysis; one without a span or audio is not.
    said = F.coalesce("said", F.when(F.col("n").isNull(), "empty_transcript"))
    reason = removal.early_reason(said, F.col("uncertain"), F.col("n"), F.when(span > 0, 1).otherwise(0), F.col("language"), F.lit(False), F.lit(None).cast("array<string>"))
    late = removal.early_reason(F.lit(None).cast("string"), F.lit(False), F.lit(1), F.col("samples"), F.lit("en"), silent, F.col("problems"))
    return rows.select(*sessions.columns, F.coalesce(reason, late).alias("early_reason"))


def cuts_and_clips(words: DataFrame, sessions: DataFrame, speech: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed intervals, clips with their gates, words with their clip) of sessions that went past the early exits."""
    bounds = sessions.select("session_id", F.lit(0).cast("long").alias("low"), F.col("samples").alias("high"))
    doubtful = words.where((F.col("confidence") < F.lit(0.45).cast("float")) | F.col("unreliable")).select("session_id")
    touched = kept(spans.select("session_id").union(doubtful).distinct())
    hit = kept(removal.with_sentences(words.join(touched, "session_id", "left_semi")))
    whole = spans.where("action = 'drop_sentence'").select("session_id", "start", "stop")
    dropped = kept(removal.touched_sentences(hit, whole).union(removal.unusable_sentences(hit)).distinct())
    own = spans.where("action <> 'drop_sentence' AND stop > start").select("session_id", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("word_id")).distinct()
    marked = kept(removal.removed_words(hit, dropped, bounds, own=own))
    removed = kept(removal.removed_intervals(marked, dropped, bounds))
    untouched = bounds.join(touched, "session_id", "left_anti")
    retained = kept(intervals.complement(removed, bounds.join(touched, "session_id", "left_semi"), ["session_id"]).unionByName(untouched.select("session_id", F.col("low").alias("start"), F.col("high").alias("end"))))
    columns = ["session_id", "word_id", "display", "text", "start", "end", "confidence", "unreliable", "clip_start", "clip_end"]
    plain = words.join(untouched, "session_id").where("end <= high").withColumns({"clip_start": F.col("low"), "clip_end": F.col("high")})
    inside = removal.clip_words(marked, retained).join(marked.select("session_id", "word_id", "unreliable"), ["session_id", "word_id"])
    placed = kept(inside.select(*columns).unionByName(plain.select(*columns)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "display"))), lambda x: x["display"]), " ")
    per = placed.groupBy("session_id", F.col("clip_start").alias("start"), F.col("clip_end").alias("end")).agg(F.count("*").alias("word_count"), text.alias("text"), weighted_mean(F.col("confidence"), F.lit(1)).alias("mean_confidence"), F.sum(F.col("end") - F.col("start")).alias("aligned"))
    heard = intervals.overlap_lengths(retained, speech, ["session_id"], CELL).withColumnRenamed("covered", "speech")
    numbered = retained.withColumn("clip_ix", F.row_number().over(Window.partitionBy("session_id").orderBy("start")) - 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    clips = numbered.join(per, ["session_id", "start", "end"], "left").join(heard, ["session_id", "start", "end"], "left").join(bounds.select("session_id", F.col("high").alias("samples")), "session_id")
    clips = clips.select("session_id", "clip_ix", "start", "end", zero("word_count"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("mean_confidence", F.lit(0.0).cast("float")).alias("mean_confidence"), zero("aligned"), zero("speech"), "samples")
    clips = clips.withColumns({"duration_ms": clip_milliseconds(F.col("end") - F.col("start")), "speech_ratio": (F.col("speech") / (F.col("end") - F.col("start"))).cast("float")})
    gate = removal.clip_reason(F.col("duration_ms"), F.col("word_count"), F.col("text"), F.col("mean_confidence"), F.col("speech_ratio"))
    return removed, kept(clips.withColumn("reason", F.coalesce(gate, removal.consistency_reason(F.col("aligned"), F.col("speech"), F.col("speech_ratio"))))), placed


def retained_transcripts(clips: DataFrame, placed: DataFrame) -> DataFrame:
    """The words of clips that passed, counted from 0 on the spliced timeline: original ids would tell where words were removed."""
    kept_clips = splice.placed(clips.where("reason IS NULL")).select("session_id", F.col("start").alias("clip_start"), F.col("end").alias("clip_end"), "clip_ix", "shift")
    rows = placed.join(kept_clips, ["session_id", "clip_start", "clip_end"])
    ix = (F.row_number().over(Window.partitionBy("session_id").orderBy("clip_ix", "word_id")) - 1).cast("long")
    return rows.select("session_id", ix.alias("word_id"), "text", "display", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"), "confidence", "unreliable")


def training_copies(words: DataFrame, sessions: DataFrame, speech: DataFrame, analysis: DataFrame, spans: DataFrame, seen: DataFrame | None = None, recheck: Recheck | None = None) -> DataFrame:
    """(session_id, reason, clips, words, duration_ms, mean_confidence, speech_ratio, removed_intervals, removed_ms, content_hash).

    The exits in order: the analysis's refusal, an uncertain analysis, no words, no span, language, no audio,
    silence, timings, nothing left, a clip over a cut or outside the audio, the session's length, a word that
    can't be in the retained transcript, what the re-check says, a content seen before (in ``seen``, or in a
    session with a smaller id), and the invariants of what is put out. A refused session has zeros.
    """
    sessions = sessions.where("session_id IS NOT NULL").dropDuplicates(["session_id"])
    rows = kept(early_exits(sessions, words, speech, analysis))
    going = rows.where("early_reason IS NULL").drop("early_reason")
    few = lambda x: x.join(going.select("session_id"), "session_id", "left_semi")
    removed, clips, placed = cuts_and_clips(kept(few(words)), going, few(speech), few(spans))
    good = clips.where("reason IS NULL")
    totals = good.groupBy("session_id").agg(
        F.count("*").alias("clips"), F.sum("word_count").alias("words"), F.sum("duration_ms").alias("duration_ms"), weighted_mean(F.col("mean_confidence"), F.col("word_count")).alias("mean_confidence"),
        weighted_mean(F.col("speech_ratio"), F.col("duration_ms")).alias("speech_ratio"), removal.content_hash(F.col("clip_ix"), F.col("text")).alias("content_hash"), F.max(F.col("end") > F.col("samples")).alias("outside"),
    )
    cut = removed.groupBy("session_id").agg(F.count("*").alias("removed_intervals"), clip_milliseconds(F.sum(F.col("end") - F.col("start"))).alias("removed_ms"))
    left = kept(retained_transcripts(clips, placed))
    wrong = recognised.word_reason(F.col("start"), F.col("end"), F.col("confidence")).isNotNull()
    invalid = left.where(wrong).select("session_id", F.lit(True).alias("invalid")).distinct()
    with_clip = placed.join(good.select("session_id", F.col("start").alias("clip_start"), F.col("end").alias("clip_end"), "clip_ix"), ["session_id", "clip_start", "clip_end"])
    broken = splice.broken_sessions(with_clip, good.select("session_id", "clip_ix", "start", "end"), removed)
    any_clip = clips.groupBy("session_id").agg(F.lit(True).alias("any"))
    rows = rows.select("session_id", "early_reason").join(any_clip, "session_id", "left").join(totals, "session_id", "left").join(cut, "session_id", "left").join(invalid, "session_id", "left").join(broken, "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    overlap = F.col("problem") == "removed_audio_kept"
    reason = F.coalesce("early_reason", first_reason([("fully_redacted", F.col("any").isNull()), ("retained_interval_overlaps_removal", overlap), ("clip_outside_audio", F.col("outside"))]), removal.session_reason(zero("clips"), zero("duration_ms")), first_reason([("recheck_transcript_invalid", F.col("invalid"))]))
    rows = rows.withColumn("reason", reason)
    if recheck is not None:
        ask = rows.where("reason IS NULL").select("session_id")
        said = recheck(left.join(kept(ask), "session_id", "left_semi")).groupBy("session_id").agg(F.min("reason").alias("said"))
        rows = rows.join(said, "session_id", "left").withColumn("reason", F.coalesce("reason", "said")).drop("said")
    rows = kept(rows)
    first = rows.where("reason IS NULL").groupBy("content_hash").agg(F.min("session_id").alias("first"))
    rows = rows.join(first, "content_hash", "left")
    again = F.col("first") != F.col("session_id")
    if seen is not None:
        rows = rows.join(seen.where("content_hash IS NOT NULL").select("content_hash", F.lit(True).alias("seen")).distinct(), "content_hash", "left")
        again = again | F.coalesce("seen", F.lit(False))
    last = first_reason([("duplicate_example", again), ("clip_length_mismatch", F.col("problem").isin("empty_clip", "clips_overlap")), ("word_outside_clip", F.col("problem") == "word_outside_clip")])
    rows = rows.withColumn("reason", F.coalesce("reason", last))
    ok = F.col("reason").isNull()
    figures = [F.when(ok, zero(c)).otherwise(0).alias(c) for c in ("clips", "words", "duration_ms", "removed_intervals", "removed_ms")]
    ratios = [F.when(ok, F.col(c)).otherwise(F.lit(0.0)).cast("float").alias(c) for c in ("mean_confidence", "speech_ratio")]
    return rows.select("session_id", "reason", *figures, *ratios, F.when(ok, F.col("content_hash")).alias("content_hash"))
