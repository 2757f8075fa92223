"""Transcripts from tables of texts and from files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Samples before the first word, of a word, after it, after a sentence's end.
LEAD, WORD, GAP, PAUSE = 1600, 6400, 800, 12_800
CASES = "id string, suite string, text string, sensitive array<struct<phrase:string,category:string>>"


def timed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: Column | None = None) -> DataFrame:
    """One row per word: session_id, word_id, text (spoken), display, start, end, confidence, unreliable.

    Timings are synthetic. A text is a session; it is dealt by its id before it is cut into words, so
    texts are shuffled and not words, and windows over the session need no further exchange. How many
    sentence ends come before a word is a running sum within that session.
    """
    from pyspark.sql import Window

    tokens = docs.select(F.col(id_col).alias("session_id"), F.col(text_col).alias("body")).repartition("session_id")
    rows = tokens.select("session_id", F.posexplode(T.words(F.col("body"))).alias("word_id", "display"))
    w = Window.partitionBy("session_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, -1)
    pauses = F.coalesce(F.sum(F.col("display").rlike(r"[.?!]$").cast("long")).over(w), F.lit(0))
    start = LEAD + F.col("word_id").cast("long") * (WORD + GAP) + pauses * (PAUSE - GAP)
    rows = rows.withColumns({"text": T.spoken(F.col("display")), "start": start, "confidence": F.lit(0.95) if confidence is None else confidence})
    return rows.select("session_id", F.col("word_id").cast("long").alias("word_id"), "text", "display", "start", (F.col("start") + WORD).alias("end"), F.col("confidence").cast("float").alias("confidence"), F.lit(False).alias("unreliable"))


def session_ends(words: DataFrame) -> DataFrame:
    """(session_id, low, high): a session's bounds in samples."""
    last = F.max(F.struct("end", F.col("display").rlike(r"[.?!]$").alias("stop")))
    return words.groupBy("session_id").agg(last.alias("l")).select("session_id", F.lit(0).cast("long").alias("low"), (F.col("l.end") + F.when(F.col("l.stop"), PAUSE).otherwise(GAP) + LEAD).alias("high"))


def freeze(segments: DataFrame, total: str = "total_samples") -> DataFrame:
    """Words of recognised segments (session_id, segment_ix, words: array of text, start, end, probability, unreliable).

    Spoken form, empty words dropped, times within the audio, probabilities within 0 to 1 (0 if none), numbered from 0.
    """
    from pyspark.sql import Window

    w = segments.select("session_id", "segment_ix", F.col(total).alias("total"), F.posexplode("words").alias("at", "w")).select("session_id", "segment_ix", "at", "total", "w.*")
    p = F.when(F.isnan("probability") | F.col("probability").isNull(), 0.0).otherwise(F.least(F.greatest("probability", F.lit(0.0)), F.lit(1.0)))
    start = F.least("start", "total")
    w = w.withColumn("spoken", T.spoken(F.col("text"))).where("spoken <> ''")
    order = Window.partitionBy("session_id").orderBy("segment_ix", "at")
    return w.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("word_id"), F.col("spoken").alias("text"), F.col("text").alias("display"), start.alias("start"), F.greatest(start, F.least("end", "total")).alias("end"), p.cast("float").alias("confidence"), "unreliable")


def shifted(words: Column, offset: Column | int) -> Column:
    """An array of word structs moved in time."""
    return F.transform(words, lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; missing fields are empty, blank lines are skipped."""
    rows = spark.read.schema(CASES).json(path)
    return rows.where("id IS NOT NULL OR text IS NOT NULL").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("id", "suite", "text")), F.coalesce("sensitive", F.array().cast("array<struct<phrase:string,category:string>>")).alias("sensitive"))


def _chunks(raw: bytes) -> dict[bytes, bytes]:
    out, at = {}, 12
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        out.setdefault(raw[at : at + 4], raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def wav_samples(raw: bytes | None, rate: int = 16_000) -> np.ndarray | None:
    """The samples of a mono 16-bit file of the given rate; None for anything else."""
    if raw is None or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    parts = _chunks(raw)
    head, data = parts.get(b"fmt ", b""), parts.get(b"data")
    if len(head) < 16 or data is None or len(data) % 2:
        return None
    kind, channels = int.from_bytes(head[:2], "little"), int.from_bytes(head[2:4], "little")
    if (kind, channels, int.from_bytes(head[4:8], "little"), int.from_bytes(head[14:16], "little")) != (1, 1, rate, 16):
        return None
    return np.frombuffer(data, dtype="<i2")


def wav_bytes(samples: np.ndarray, rate: int = 16_000) -> bytes:
    """A canonical file: a header of 44 bytes, then the samples."""
    data = np.asarray(samples, dtype="<i2").tobytes()
    n = lambda x, size: int(x).to_bytes(size, "little")
    return b"RIFF" + n(36 + len(data), 4) + b"WAVEfmt " + n(16, 4) + n(1, 2) + n(1, 2) + n(rate, 4) + n(2 * rate, 4) + n(2, 2) + n(16, 2) + b"data" + n(len(data), 4) + data


def read_wavs(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, pcm array of samples or null where the file isn't mono 16-bit audio of that rate)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "pcm": [wav_samples(x, rate) for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, pcm array<smallint>")


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, pcm, text) of each audio file with a text of the same name beside it."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    audio = read_wavs(spark, f"{folder}/*.wav").select(stem(F.col("path")).alias("stem"), "pcm")
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem(F.input_file_name()).alias("stem"), F.col("value").alias("text"))
    return audio.join(texts, "stem")


def read_archives(spark: SparkSession, path: str, most_entries: int = 512, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, reason, manifest, payloads): tar archives of a manifest and flat files.

    ``reason`` says why an archive is refused: not readable, an entry that is no plain file, an unsafe or
    repeated name, too many or too large entries, no manifest.
    """
    import io
    import re
    import tarfile

    def decode(raw: bytes) -> tuple[str | None, str | None, dict[str, bytes] | None]:
        files: dict[str, bytes] = {}
        try:
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as tar:
                for k, entry in enumerate(tar):
                    if k >= most_entries or entry.size > most_bytes:
                        return "archive_too_large", None, None
                    if not entry.isreg():
                        return "archive_entry_not_file", None, None
                    if not re.fullmatch(T.SAFE_ENTRY[2:-2], entry.name) or ".." in entry.name:
                        return "archive_entry_name", None, None
                    if entry.name in files:
                        return "archive_entry_duplicate", None, None
                    files[entry.name] = tar.extractfile(entry).read()
        except tarfile.TarError:
            return "archive_malformed", None, None
        if "manifest.json" not in files:
            return "manifest_missing", None, None
        return None, files.pop("manifest.json").decode(errors="replace"), files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [decode(x) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "reason": [x[0] for x in found], "manifest": [x[1] for x in found], "payloads": [x[2] for x in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, reason string, manifest string, payloads map<string,binary>")
