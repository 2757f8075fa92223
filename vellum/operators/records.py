"""Validation of JSON records: package manifests and classifier answers. The first violation gives the reason."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from vellum.functions import text as T
from vellum.operators.control import first_reason

#: The exact keys of a manifest, of its clips and of its quality block.
MANIFEST_KEYS = (
    "eligibility_version", "sample_id", "sample_rate", "language", "duration_ms", "clip_count", "quality", "asr_model", "asr_model_revision", "privacy_model", "privacy_model_revision", "policy_version",
    "consent_version", "consent_reference", "clips", "checksums",
)
CLIP_KEYS = ("audio", "text", "duration_ms", "word_count", "sha256")
QUALITY_KEYS = ("duration_ms", "word_count", "mean_confidence", "speech_ratio", "removed_interval_count", "removed_duration_ms", "clip_count")
#: Keys that must not occur anywhere in a manifest.
FORBIDDEN_KEYS = (
    "tenant", "tenant_id", "customer_id", "account_id", "session_id", "session", "user", "username", "user_name", "hostname", "device_name", "machine", "path", "filename", "file_path", "app", "application",
    "window_title", "foreground_app", "prompt", "system_prompt", "spans", "removed", "removal_map", "boundary_manifest", "source_start", "source_end", "source_interval", "original_text", "full_transcript",
    "latitude", "longitude", "location", "ip", "ip_address", "created_at",
)
#: Text fields of a manifest, categories and actions of an answer.
STRINGS = ("asr_model", "asr_model_revision", "privacy_model", "privacy_model_revision", "policy_version", "consent_version", "consent_reference")
CATEGORIES = (
    "direct_identifier", "contact", "address", "account_identifier", "government_id", "financial", "credential_secret", "health", "political_religious", "sexuality", "customer_confidential", "user_defined", "sensitive_narrative",
    "contextual_combination",
)
ACTIONS = ("drop_sentence", "drop_words")


def same_keys(record: Column, keys: Sequence[str]) -> Column:
    return F.array_sort(F.array_distinct(F.json_object_keys(record))) == F.array_sort(F.array(*map(F.lit, keys)))


def unknown_keys(record: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.json_object_keys(record), F.array(*map(F.lit, allowed)))


@F.pandas_udf(StringType())
def forbidden_key(records: pd.Series) -> pd.Series:
    """The first forbidden key found anywhere in a record, whatever its case; null if none or not JSON."""

    def find(x: object) -> str | None:
        todo = deque([x])
        while todo:
            x = todo.popleft()
            if isinstance(x, dict):
                for k in x:
                    if k.lower() in FORBIDDEN_KEYS:
                        return k
                todo += x.values()
            elif isinstance(x, list):
                todo += x
        return None

    def one(raw: str | None) -> str | None:
        try:
            return find(json.loads(raw)) if raw is not None else None
        except ValueError:
            return None

    return records.map(one)


def kind_of(record: Column, key: str) -> Column:
    """The type of a record's value, as ``schema_of_variant`` names it; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{key}", "variant"))


def number_of(record: Column, key: str) -> Column:
    """A whole number of a record that is written as one; null for anything else."""
    raw = F.get_json_object(record, f"$.{key}")
    return F.when((kind_of(record, key) == "BIGINT") & raw.rlike(r"\A[0-9]{1,18}\z"), raw.cast("long"))


def string_of(record: Column, key: str) -> Column:
    return F.when(kind_of(record, key) == "STRING", F.get_json_object(record, f"$.{key}"))


def manifest_form(record: Column) -> Column:
    """Whether a manifest is an object of exactly its keys: the reason if not, or null."""
    return first_reason([("package_manifest_not_object", F.json_object_keys(record).isNull()), ("package_fields_mismatch", ~same_keys(record, MANIFEST_KEYS))])


def header_reason(record: Column, versions: Sequence[int] = (1,), most_clips: int = 128) -> Column:
    """Why the plain fields of a manifest of the right form are refused, or null."""
    version, rate, clips = (number_of(record, k) for k in ("eligibility_version", "sample_rate", "clip_count"))
    sample, language = string_of(record, "sample_id"), string_of(record, "language")
    checks = []
    for value, code, failed in (
        (version, "unknown_eligibility_version", ~version.isin(*versions)), (sample, "invalid_sample_id", ~sample.rlike(T.SAMPLE_ID)), (rate, "invalid_sample_rate", rate != 16_000), (language, "language_not_validated", language != "en"),
        (number_of(record, "duration_ms"), "invalid_field_type", F.lit(False)), (clips, "invalid_clip_count", (clips < 1) | (clips > most_clips)),
    ):
        checks += [("invalid_field_type", value.isNull()), (code, failed)]
    for k in STRINGS:
        size = F.octet_length(string_of(record, k))
        checks += [("invalid_field_type", size.isNull()), ("invalid_manifest_string", (size < 1) | (size > 256))]
    return first_reason(checks)


def manifest_reason(record: Column, versions: Sequence[int] = (1,), most_clips: int = 128) -> Column:
    """Why a manifest's header is refused, or null."""
    return F.coalesce(manifest_form(record), header_reason(record, versions, most_clips))


def checksum_problems(packages: DataFrame) -> DataFrame:
    """(package_id, name, problem) from checksums (map of name to digest) and payloads (map of name to bytes): a full outer join."""
    declared = packages.select("package_id", F.explode("checksums").alias("name", "declared"))
    present = packages.select("package_id", F.explode("payloads").alias("name", "body")).select("package_id", "name", F.sha2("body", 256).alias("actual"))
    problem = first_reason([("checksum_without_file", F.col("actual").isNull()), ("file_without_checksum", F.col("declared").isNull()), ("checksum_malformed", ~F.col("declared").rlike(T.DIGEST)), ("checksum_mismatch", F.lower("declared") != F.col("actual"))])
    return declared.join(present, ["package_id", "name"], "full_outer").select("package_id", "name", problem.alias("problem")).where("problem IS NOT NULL")


ANSWER = "struct<reason:string,uncertain:boolean,spans:array<struct<start:bigint,stop:bigint,category:string,action:string>>>"


def classifier_answers(rows: DataFrame, answer: str = "answer", first: str = "first_word", stop: str = "stop_word", word_cuts: bool = False, most: int = 64) -> DataFrame:
    """``rows`` with reason, uncertain, spans from a classifier's answers about the words first to stop - 1.

    Answers may stand in a code fence. Anything but the exact form (keys, types, order, ids shown, known
    names) is refused as a whole. Without ``word_cuts`` an answer that would drop words drops sentences.
    """

    def whole(x: object) -> bool:
        return isinstance(x, int) and not isinstance(x, bool) and x >= 0

    def check(raw: str | None, a: int, b: int) -> tuple:
        try:
            body = (raw or "").strip()
            if body.startswith("```"):
                body = body.split("\n", 1)[1].rsplit("```", 1)[0]
            x = json.loads(body)
        except (ValueError, IndexError):
            return ("malformed_json", None, None)
        if not isinstance(x, dict):
            return ("not_an_object", None, None)
        if set(x) - {"spans", "uncertain"}:
            return ("unknown_key", None, None)
        if not isinstance(x.get("uncertain"), bool):
            return ("uncertain_missing", None, None)
        spans = x.get("spans")
        if not isinstance(spans, list):
            return ("spans_missing", None, None)
        if len(spans) > most:
            return ("too_many_spans", None, None)
        out, before = [], None
        for s in spans:
            if not isinstance(s, dict):
                return ("span_not_object", None, None)
            if set(s) - {"start_word_id", "end_word_id_exclusive", "category", "action"}:
                return ("span_unknown_key", None, None)
            start, end = s.get("start_word_id"), s.get("end_word_id_exclusive")
            if not whole(start) or not whole(end):
                return ("span_id_invalid", None, None)
            if end <= start:
                return ("span_empty", None, None)
            if before is not None and start < before:
                return ("spans_unordered", None, None)
            if start < a or end > b:
                return ("span_outside_window", None, None)
            if s.get("category") not in CATEGORIES:
                return ("category_unknown", None, None)
            if s.get("action") not in ACTIONS:
                return ("action_unknown", None, None)
            before = start
            out.append((start, end, s["category"], s["action"] if word_cuts else "drop_sentence"))
        return (None, x["uncertain"], out)

    @F.pandas_udf(ANSWER)
    def run(answers: pd.Series, firsts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        found = [check(*x) for x in zip(answers, firsts, stops, strict=True)]
        spans = [None if s is None else [dict(zip(("start", "stop", "category", "action"), x, strict=True)) for x in s] for _, _, s in found]
        return pd.DataFrame({"reason": pd.Series([r for r, _, _ in found], dtype=object), "uncertain": pd.Series([u for _, u, _ in found], dtype=object), "spans": pd.Series(spans, dtype=object)})

    return rows.withColumn("__a", run(answer, first, stop)).select(*rows.columns, "__a.*")


def classifier_windows(sessions: DataFrame, size: int = 220, overlap: int = 40) -> DataFrame:
    """(session_id, window_ix, first_word, stop_word): overlapping windows that end at sentence ends where they can.

    ``sessions`` has n_words and ends, the sorted word positions after each sentence.
    """
    size, overlap = max(size, 1), min(overlap, max(size, 1) - 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<first:int,stop:int>>").alias("w"))
    n = F.col("n_words").cast("int")

    def step(s: Column, _: Column) -> Column:
        most = F.least(s["at"] + size, n)
        snapped = F.array_max(F.filter("ends", lambda e: (e > s["at"]) & (e <= most)))
        end = F.when(most < n, F.coalesce(snapped.cast("int"), most)).otherwise(most)
        again = F.struct(F.greatest(end - overlap, s["at"] + 1).alias("at"), (end >= n).alias("done"), F.array_append(s["w"], F.struct(s["at"].alias("first"), end.alias("stop"))).alias("w"))
        return F.when(s["done"], s).otherwise(again)

    turns = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    windows = F.when(n > 0, F.aggregate(turns, start, step, lambda s: s["w"])).otherwise(F.array().cast("array<struct<first:int,stop:int>>"))
    return sessions.select("session_id", F.posexplode(windows).alias("window_ix", "w")).select("session_id", "window_ix", F.col("w.first").cast("long").alias("first_word"), F.col("w.stop").cast("long").alias("stop_word"))


def packages(clips: DataFrame, headers: DataFrame) -> DataFrame:
    """(sample_id, manifest, payloads): a manifest with checksums and the files that it names.

    ``clips``: sample_id, clip_ix, audio (bytes), text, duration_ms, word_count; ``headers``: sample_id,
    quality (struct) and the manifest's other plain fields.
    """
    name = F.format_string("clip-%03d", F.col("clip_ix"))
    rows = clips.select("sample_id", "clip_ix", F.concat(name, F.lit(".wav")).alias("audio"), F.concat(name, F.lit(".txt")).alias("text"), "duration_ms", "word_count", F.sha2("audio", 256).alias("sha256"), F.sha2("text", 256).alias("t"), F.col("audio").alias("a"), F.col("text").cast("binary").alias("b"))
    both = lambda x, y: F.array(F.struct(F.col("audio").alias("k"), F.col(x).alias("v")), F.struct(F.col("text").alias("k"), F.col(y).alias("v")))
    listed = F.array_sort(F.collect_list(F.struct("clip_ix", F.struct(*CLIP_KEYS).alias("c"))))
    made = rows.groupBy("sample_id").agg(
        F.transform(listed, lambda x: x["c"]).alias("clips"), F.map_from_entries(F.array_sort(F.flatten(F.collect_list(both("sha256", "t"))))).alias("checksums"), F.map_from_entries(F.flatten(F.collect_list(both("a", "b")))).alias("payloads"), F.count("*").alias("clip_count")
    )
    whole = headers.join(made, "sample_id")
    return whole.select("sample_id", F.to_json(F.struct(*MANIFEST_KEYS)).alias("manifest"), "payloads")


@F.pandas_udf(BinaryType())
def archive(manifests: pd.Series, payloads: pd.Series) -> pd.Series:
    """A tar archive: the manifest, then the files by name; equal packages give equal bytes."""
    import io
    import tarfile

    def one(manifest: str, files: object) -> bytes:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for name, body in [("manifest.json", manifest.encode()), *sorted((k, bytes(v)) for k, v in dict(files).items())]:
                info = tarfile.TarInfo(name)
                info.size, info.mode = len(body), 0o600
                tar.addfile(info, io.BytesIO(body))
        return raw.getvalue()

    return pd.Series([one(m, p) for m, p in zip(manifests, payloads, strict=True)])
