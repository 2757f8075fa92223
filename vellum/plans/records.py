"""Queries on JSON records and text functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import package, records
from vellum.operators.removal import sentences
from vellum.plans.transcripts import _words, read
from vellum.sources.transcripts import wav_bytes


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest per supplier, some of them faulty."""
    k = F.col("s_suppkey")
    text = {c: F.lit("x") for c in records.STRINGS}
    fields = {
        "eligibility_version": F.when(k % 7 == 0, 9).otherwise(1), "sample_id": F.concat(F.lit("sample-"), F.lpad(F.hex(k), F.when(k % 5 == 0, F.lit(15)).otherwise(F.lit(16)), F.lit("0"))),
        "sample_rate": F.when(k % 11 == 0, 8000).otherwise(16_000), "language": F.when(k % 3 == 0, "de").otherwise("en"), "duration_ms": k * 10, "clip_count": k % 80, "quality": F.struct(F.lit(1).alias("clip_count")),
        "clips": F.array(F.struct(F.when(k % 13 == 0, "c").alias("path"), F.lit("a").alias("audio"))), "checksums": F.struct(F.lit("0").alias("a")),
    } | text
    record = F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 17 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record).alias("record"))


def manifest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir).select("s_suppkey", records.manifest_reason(F.col("record"), most_clips=64).alias("reason"))


def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir).select("s_suppkey", records.forbidden_key("record").alias("found"))


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of names, keys and digests."""
    key = F.concat(F.lit("key-"), F.col("c_custkey").cast("string"))
    digest = F.sha2(F.col("c_name"), 256)
    return read(spark, sf_dir, "customer").select(
        "c_custkey", key.rlike(T.IDEMPOTENCY_KEY).alias("key_ok"), T.safe_entry(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "..").otherwise(".x"))).alias("entry_ok"), F.substring(digest, 1, 64).rlike(T.DIGEST).alias("digest_ok"),
        digest.alias("digest"), T.digits(F.col("c_name")).alias("digits"),
    )


#: What may follow a name: nothing, characters that end a line, blanks, letters that are no ASCII.
_ENDS = ("", "\n", "\r", "\u2028", "\r\n", " ", "\u0130", "\x00", "\u00e9")


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, keys, digests and ids with what must not follow or precede them."""
    k = F.col("o_orderkey")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % len(_ENDS) + 1).cast("int"))
    odd = lambda name: F.when(k % 2 == 0, F.concat(name, end)).otherwise(F.concat(end, name))
    digest = F.sha2(k.cast("string"), 256)
    return read(spark, sf_dir, "orders").select(
        k, odd(F.concat(F.lit("key_"), k.cast("string"), F.lit("-ab"))).rlike(T.IDEMPOTENCY_KEY).alias("key_ok"), T.safe_entry(odd(F.concat(F.lit("clip."), k.cast("string")))).alias("entry_ok"),
        odd(F.substring(digest, 1, 63 + 2)).rlike(T.DIGEST).alias("digest_ok"), odd(F.concat(F.lit("sample-"), F.substr(digest, F.lit(1), F.when(k % 5 == 0, 16).when(k % 5 == 1, 17).otherwise(32)))).rlike(T.SAMPLE_ID).alias("sample_ok"),
        odd(F.lit("a-b_c")).rlike(T.METADATA).alias("metadata_ok"),
    )


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words joined again, no space before a closing mark."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.joined(T.words(F.col("text"))), 256).alias("joined"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


def classifier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows in which a classifier would see each document; a fold that SQL can't state."""
    words = _words(spark, sf_dir)
    ends = sentences(words).groupBy("session_id").agg(F.array_sort(F.collect_list("stop_word")).alias("ends"), F.max("stop_word").alias("n_words"))
    return records.classifier_windows(ends)


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of two clips for each supplier, most of them with one fault, dealt by the key."""
    k, ix = F.col("s_suppkey"), F.col("clip_ix")
    fault = lambda n, bad, good: F.when(k % 20 == n, bad).otherwise(good)
    keyed = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("sample-"), F.lpad(F.hex("s_suppkey"), 16, "0")).alias("sample_id"))
    sound = F.when(ix == 0, F.lit(wav_bytes(np.zeros(160)))).when(k % 20 == 8, F.lit(b"RIFX")).when(k % 20 == 9, F.lit(wav_bytes(np.zeros(320), 8000))).otherwise(F.lit(wav_bytes(np.zeros(320))))
    clips = keyed.select("sample_id", "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("clip_ix")).select(
        "sample_id", "clip_ix", sound.alias("audio"), F.when(ix == 0, "one two").otherwise(fault(7, F.lit(" "), F.lit("three"))).alias("text"), F.when(ix == 0, 10).otherwise(fault(5, F.lit(21), F.lit(20))).alias("duration_ms"),
        F.when(ix == 0, 2).otherwise(fault(6, F.lit(9), F.lit(1))).alias("word_count"),
    )
    quality = {
        "duration_ms": F.lit(30), "word_count": fault(3, F.lit(4), F.lit(3)), "mean_confidence": F.lit(0.9), "speech_ratio": fault(4, F.lit(1.5), F.lit(0.5)), "removed_interval_count": F.lit(0), "removed_duration_ms": F.lit(0), "clip_count": F.lit(2),
    }
    fields = {"eligibility_version": F.lit(1), "sample_rate": fault(16, F.lit(8000), F.lit(16_000)), "language": F.lit("en"), "duration_ms": fault(2, F.lit(31), F.lit(30)), "quality": F.struct(*(v.alias(n) for n, v in quality.items()))}
    headers = keyed.select("s_suppkey", "sample_id", *(v.alias(n) for n, v in (fields | {c: F.lit("x") for c in records.STRINGS}).items()))
    made = records.packages(clips, headers).join(keyed, "sample_id")
    m = F.col("manifest")
    edited = (
        F.when(k % 20 == 11, F.replace(m, F.lit('"text":"clip-001.txt"'), F.lit('"text":"clip-1.txt"'))).when(k % 20 == 12, F.concat(F.lit("["), m, F.lit("]"))).when(k % 20 == 13, F.replace(m, F.lit('"mean_confidence"'), F.lit('"Device_Name"')))
        .when(k % 20 == 15, F.replace(m, F.lit('"clip_count":2,"quality"'), F.lit('"clip_count":3,"quality"'))).when(k % 20 == 17, F.replace(m, F.lit('"word_count":1,"sha256"'), F.lit('"word_count":"1","sha256"'))).otherwise(m)
    )
    files = F.when(k % 20 == 1, F.map_concat("payloads", F.create_map(F.lit("more.txt"), F.lit(b"x")))).when(k % 20 == 10, F.transform_values("payloads", lambda n, v: F.when(n == "clip-001.txt", F.lit(b"four")).otherwise(v))).otherwise(F.col("payloads"))
    return made.select(k.alias("package_id"), edited.alias("manifest"), files.alias("payloads"))


def package_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why whole packages are refused, and what their clips amount to."""
    return package.package_reasons(_packages(spark, sf_dir)).select("package_id", "reason", "clips", "words")


def package_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of packages by the manifest, with their texts."""
    return package.clips_of(_packages(spark, sf_dir)).select("package_id", "clip_ix", "audio_name", F.octet_length("audio").alias("audio_bytes"), F.col("text").cast("string").alias("text"))


QUERIES = (package_reasons, package_clips, manifest_reasons, forbidden_keys, sample_ids, odd_names, display_texts, classifier_windows)
SQL = {
    "package_reasons": """SELECT s_suppkey AS package_id, CASE s_suppkey % 20 WHEN 1 THEN 'package_checksum_coverage_mismatch' WHEN 2 THEN 'package_duration_mismatch' WHEN 3 THEN 'quality_metrics_mismatch' WHEN 4 THEN 'invalid_quality_metric'
  WHEN 5 THEN 'clip_duration_mismatch' WHEN 6 THEN 'clip_word_count_mismatch' WHEN 7 THEN 'invalid_clip_text' WHEN 8 THEN 'invalid_wav' WHEN 9 THEN 'invalid_wav_format' WHEN 10 THEN 'package_checksum_mismatch' WHEN 11 THEN 'unsafe_clip_filename'
  WHEN 12 THEN 'package_manifest_not_object' WHEN 13 THEN 'package_forbidden_field' WHEN 15 THEN 'clip_count_mismatch' WHEN 16 THEN 'invalid_sample_rate' WHEN 17 THEN 'invalid_field_type' END AS reason,
  CASE WHEN s_suppkey % 20 = 12 THEN 0 ELSE 2 END::BIGINT AS clips, CASE s_suppkey % 20 WHEN 7 THEN 2 WHEN 11 THEN 2 WHEN 12 THEN 0 ELSE 3 END::BIGINT AS words FROM supplier""",
    "package_clips": """SELECT s_suppkey AS package_id, ix::INT AS clip_ix, 'clip-00' || ix || '.wav' AS audio_name, CASE WHEN ix = 0 THEN 364 WHEN s_suppkey % 20 = 8 THEN 4 ELSE 684 END::INT AS audio_bytes,
  CASE WHEN ix = 0 THEN 'one two' WHEN s_suppkey % 20 = 11 THEN NULL WHEN s_suppkey % 20 = 7 THEN ' ' WHEN s_suppkey % 20 = 10 THEN 'four' ELSE 'three' END AS text FROM supplier, range(2) AS r(ix) WHERE s_suppkey % 20 <> 12""",
    "manifest_reasons": """SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN 'package_manifest_not_object' WHEN s_suppkey % 7 = 0 THEN 'unknown_eligibility_version' WHEN s_suppkey % 5 = 0 THEN 'invalid_sample_id' WHEN s_suppkey % 11 = 0 THEN 'invalid_sample_rate'
  WHEN s_suppkey % 3 = 0 THEN 'language_not_validated' WHEN s_suppkey % 80 = 0 OR s_suppkey % 80 > 64 THEN 'invalid_clip_count' END AS reason FROM supplier""",
    "forbidden_keys": "SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'path' END AS found FROM supplier",
    "sample_ids": """SELECT c_custkey, length('key-' || c_custkey) BETWEEN 8 AND 128 AS key_ok, c_custkey % 4 <> 0 AND regexp_full_match(c_mktsegment || '.x', '[A-Za-z0-9._-]{1,64}') AS entry_ok, true AS digest_ok, sha256(c_name) AS digest,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer""",
    "odd_names": """WITH o AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS clean, o_orderkey % 5 AS m FROM orders)
SELECT o_orderkey, clean AND length('key_' || o_orderkey || '-ab') BETWEEN 8 AND 128 AS key_ok, clean AS entry_ok, clean AS digest_ok, clean AND m <> 1 AS sample_ok, clean AS metadata_ok FROM o""",
    "display_texts": rf"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '{T.SPACES}'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, sha256(regexp_replace(array_to_string(w, ' '), ' ([,.!?;:])', '\1', 'g')) AS joined, len(w) AS n_words FROM t""",
}
