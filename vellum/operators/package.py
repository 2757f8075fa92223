"""Validation of whole packages: a manifest, its files, and what they say of each other. The first violation gives the reason.

A package is a row (package_id, manifest as JSON, payloads as a map of file name to bytes). Files are looked up
within their row; only a clip's counts and reason are shuffled, never its bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from vellum.functions import text as T
from vellum.operators import records
from vellum.operators.control import first_reason

#: Most clips of a package, bytes of a file, of all files and of a text.
MOST_CLIPS, FILE_BYTES, PACKAGE_BYTES, TEXT_BYTES = 128, 8 << 20, 32 << 20, 64 << 10
RATE = 16_000


@F.pandas_udf(StructType().add("reason", StringType()).add("samples", LongType()))
def wave(audio: pd.Series) -> pd.DataFrame:
    """The samples of a mono 16-bit file at ``RATE``, or why it is none."""

    def one(raw: bytes | None) -> tuple[str | None, int | None]:
        number = lambda at, size: int.from_bytes(raw[at : at + size], "little")
        if raw is None or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or number(4, 4) + 8 != len(raw):
            return "invalid_wav", None
        form, samples, at = None, None, 12
        while at + 8 <= len(raw):
            name, size, body = raw[at : at + 4], number(at + 4, 4), at + 8
            if body + size > len(raw) or (name == b"fmt " and size < 16) or (name == b"data" and size % 2):
                return "invalid_wav", None
            if name == b"fmt ":
                form = (number(body, 2), number(body + 2, 2), number(body + 4, 4), number(body + 12, 2), number(body + 14, 2))
            if name == b"data":
                samples = size // 2
            at = body + size + size % 2
        if form != (1, 1, RATE, 2, 16):
            return "invalid_wav_format", None
        return ("invalid_wav", None) if samples is None else (None, samples)

    found = [one(None if x is None else bytes(x)) for x in audio]
    return pd.DataFrame({"reason": pd.Series([r for r, _ in found], dtype=object), "samples": pd.Series([n for _, n in found], dtype="Int64")})


def clips_of(packages: DataFrame) -> DataFrame:
    """(package_id, clip_ix, clip, audio_name, text_name, audio, text): a row for each entry of a manifest's clips, with its files where they exist."""
    listed = F.try_variant_get(F.try_parse_json("manifest"), "$.clips", "array<variant>")
    rows = packages.select("package_id", "payloads", F.posexplode(listed).alias("clip_ix", "__clip")).withColumn("clip", F.to_json("__clip"))
    rows = rows.withColumns({"audio_name": records.string_of(F.col("clip"), "audio"), "text_name": records.string_of(F.col("clip"), "text")})
    return rows.select("package_id", "clip_ix", "clip", "audio_name", "text_name", F.try_element_at("payloads", F.col("audio_name")).alias("audio"), F.try_element_at("payloads", F.col("text_name")).alias("text"))


def clip_reasons(packages: DataFrame) -> DataFrame:
    """(package_id, clip_ix, reason, duration_ms, words, audio_name, text_name) of each clip, as observed."""
    number, clip, name = records.number_of, F.col("clip"), F.format_string("clip-%03d", F.col("clip_ix"))
    rows = clips_of(packages).withColumn("text", F.col("text").cast("string")).withColumns({"wave": wave("audio"), "words": F.size(T.words(F.col("text"))).cast("long"), "sha": records.string_of(clip, "sha256")})
    rows = rows.withColumn("duration_ms", F.expr(f"(wave.samples * 1000 + {RATE // 2}) div {RATE}"))
    before = first_reason([
        ("invalid_clip", F.json_object_keys(clip).isNull()), ("package_fields_mismatch", ~records.same_keys(clip, records.CLIP_KEYS)), ("invalid_field_type", F.col("audio_name").isNull() | F.col("text_name").isNull()),
        ("unsafe_clip_filename", (F.col("audio_name") != F.concat(name, F.lit(".wav"))) | (F.col("text_name") != F.concat(name, F.lit(".txt")))), ("package_missing_file", F.col("audio").isNull() | F.col("text").isNull()),
        ("invalid_field_type", F.col("sha").isNull()), ("package_checksum_mismatch", F.col("sha") != F.sha2("audio", 256)),
    ])
    after = first_reason([
        ("invalid_field_type", number(clip, "duration_ms").isNull()), ("clip_duration_mismatch", number(clip, "duration_ms") != F.col("duration_ms")), ("clip_text_not_utf8", ~F.is_valid_utf8("text")),
        ("invalid_clip_text", (F.col("words") == 0) | (F.octet_length("text") > TEXT_BYTES)), ("invalid_field_type", number(clip, "word_count").isNull()), ("clip_word_count_mismatch", number(clip, "word_count") != F.col("words")),
    ])
    return rows.select("package_id", "clip_ix", F.coalesce(before, F.col("wave.reason"), after).alias("reason"), "duration_ms", "words", "audio_name", "text_name")


def _first(names: Column, problem) -> Column:
    """The first problem of the sorted names."""
    return F.get(F.array_compact(F.transform(F.array_sort(names), problem)), F.lit(0))


def quality_reason(quality: Column, duration: Column, words: Column, clips: Column) -> Column:
    """Why a manifest's quality block (JSON) doesn't fit what was observed, or null."""
    checks = [("package_fields_mismatch", ~records.same_keys(quality, records.QUALITY_KEYS))]
    for key, seen in (("duration_ms", duration), ("word_count", words), ("clip_count", clips)):
        declared = records.number_of(quality, key)
        checks += [("invalid_field_type", declared.isNull()), ("quality_metrics_mismatch", declared != seen)]
    checks += [("invalid_field_type", records.number_of(quality, k).isNull()) for k in ("removed_interval_count", "removed_duration_ms")]
    for key in ("mean_confidence", "speech_ratio"):
        share = F.get_json_object(quality, f"$.{key}").try_cast("double")
        checks.append(("invalid_quality_metric", F.coalesce(records.kind_of(quality, key).isin("STRING", "BOOLEAN") | ~share.between(0, 1), F.lit(True))))
    return first_reason(checks)


def package_reasons(packages: DataFrame, versions: Sequence[int] = (1,)) -> DataFrame:
    """(package_id, reason, clips, words, duration_ms): why a package is refused (null: it isn't), and what its clips amount to.

    A null manifest is no object; null payloads are none. Package ids must be unique.
    """
    packages = packages.select("package_id", "manifest", F.coalesce("payloads", F.create_map().cast("map<string,binary>")).alias("payloads"))
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("clip_ix", "reason")))
    seen = clip_reasons(packages).groupBy("package_id").agg(
        first["reason"].alias("clip_reason"), F.count("*").alias("clips"), F.sum("words").alias("words"), F.sum("duration_ms").alias("duration_ms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("audio_name", "text_name"))))).alias("referenced"),
    )
    m = F.col("manifest")
    rows = packages.select(
        "package_id", "manifest", F.array_sort(F.map_keys("payloads")).alias("names"), F.transform_values("payloads", lambda _, v: F.octet_length(v)).alias("sizes"), F.transform_values("payloads", lambda _, v: F.sha2(v, 256)).alias("digests"),
        F.when(records.kind_of(m, "checksums").startswith("OBJECT"), F.from_json(F.get_json_object(m, "$.checksums"), "map<string,string>")).alias("sums"),
        F.when(records.kind_of(m, "quality").startswith("OBJECT"), F.get_json_object(m, "$.quality")).alias("quality"), F.coalesce(records.kind_of(m, "clips").startswith("ARRAY"), F.lit(False)).alias("listed"),
    )
    rows = rows.join(seen, "package_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("clips", "words", "duration_ms")})
    bounds = _first(F.col("names"), lambda n: F.when(~T.safe_entry(n), "unsafe_archive_entry").when(F.element_at("sizes", n) > FILE_BYTES, "package_file_too_large"))
    total = F.aggregate(F.map_values("sizes"), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = _first(F.col("names"), lambda n: F.when(F.coalesce(~F.element_at("sums", n).rlike(T.DIGEST), F.lit(True)), "invalid_checksum").when(F.element_at("sums", n) != F.element_at("digests", n), "package_checksum_mismatch"))
    reason = F.coalesce(
        records.manifest_form(m), F.when(records.forbidden_key("manifest").isNotNull(), "package_forbidden_field"), records.header_reason(m, versions, MOST_CLIPS), bounds, first_reason([("package_too_large", total > PACKAGE_BYTES)]),
        first_reason([("invalid_checksums", F.col("sums").isNull()), ("package_checksum_coverage_mismatch", F.array_sort(F.map_keys("sums")) != F.col("names"))]), sums,
        first_reason([("invalid_clips", ~F.col("listed")), ("clip_count_mismatch", records.number_of(m, "clip_count") != F.col("clips"))]), F.col("clip_reason"),
        first_reason([("package_unreferenced_payload", F.col("referenced") != F.col("names")), ("package_duration_mismatch", records.number_of(m, "duration_ms") != F.col("duration_ms")), ("invalid_quality", F.col("quality").isNull())]),
        quality_reason(F.col("quality"), F.col("duration_ms"), F.col("words"), F.col("clips")),
    )
    return rows.select("package_id", reason.alias("reason"), "clips", "words", "duration_ms")
