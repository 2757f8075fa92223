"""Queries of upkeep: deletion requests, expiry, clients, grants, metadata, outcomes and the checks before a session is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import control, detect, removal
from vellum.plans.tables import NOW, _events
from vellum.plans.transcripts import SQL as TRANSCRIPTS
from vellum.plans.transcripts import _word_hits, read


def deletion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a request for deletion; filled ones are completed, those of the highest priorities were sent before. ``pending`` tells what is left."""
    key, sent = F.col("o_orderkey"), F.col("o_orderpriority") < "3"
    rows = read(spark, sf_dir, "orders").select(key.alias("request_id"), F.col("o_orderstatus").alias("status"), F.when(sent, key).cast("long").alias("sent_at"), F.lit(None).cast("long").alias("completed_at"))
    done = control.completed_deletions(rows, rows.where("status = 'F'"), NOW)
    pending = control.pending_deletions(done).select("request_id", F.lit(True).alias("pending"))
    return done.join(pending, "request_id", "left").select("request_id", "sent_at", "completed_at", F.coalesce("pending", F.lit(False)).alias("pending"))


def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of the nodes that orders name, from a lineage of all customers."""
    lineage = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("kind"))
    return control.node_kinds(read(spark, sf_dir, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey") * 2).alias("node")), lineage)


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.lit(NOW) + (F.col("o_orderkey") % 40 - 15) * 3600).cast("long").alias("expires_at"))


def cleanup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders (as scopes) and events (as metadata) have expired."""
    metadata = read(spark, sf_dir, "events").select((F.lit(NOW) + F.col("event_id") % 9 - 4).cast("long").alias("expires_at"))
    return control.cleanup_report(_scopes(spark, sf_dir), metadata, NOW)


def unexpired_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.unexpired(_scopes(spark, sf_dir), NOW)


def client_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each customer, as a client, last came with a token that is known and not revoked."""
    token = lambda k: F.concat(F.lit("client-"), k)
    key = F.col("c_custkey")
    clients = read(spark, sf_dir, "customer").select(key.alias("client_id"), control.token_hash(token(key)).alias("token_hash"), F.when(key % 6 == 0, 1).alias("revoked_at"), F.when(key % 4 == 0, 7).cast("long").alias("last_used_at"))
    requests = read(spark, sf_dir, "orders").select(token(F.col("o_custkey")).alias("token"), F.col("o_orderkey").cast("long").alias("at"))
    return control.last_used(clients, control.api_clients(requests, clients)).select("client_id", "last_used_at")


def grant_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    purposes = F.when(key % 5 == 0, F.array()).when(key % 3 == 0, F.array(F.lit(control.PURPOSE), F.col("c_mktsegment"))).otherwise(F.array(F.lit(control.PURPOSE)))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.repeat("c_name", (key % 9 + 1).cast("int")).alias("consent_id"), purposes.alias("purposes"))
    return rows.select("c_custkey", control.grant_refusal(F.col("consent_id"), F.col("purposes")).alias("reason"))


def recordable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events, as metadata, hold tokens alone: types as states, reasons that are now and then free text, too long or missing."""
    k = F.col("event_id")
    reason = F.when(k % 7 == 0, "free text").when(k % 5 == 0, F.repeat(F.lit("x"), 65)).when(k % 3 == 0, F.concat(F.lit("code:"), k)).when(k % 11 == 0, "code\n")
    return read(spark, sf_dir, "events").select("event_id", control.recordable(F.concat(F.lit("event-"), k), F.col("event_type"), reason).alias("ok"))


def outcome_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    outcome = F.when(k % 4 == 0, "cancelled").when(k % 3 == 0, "kept_base_model").when(k % 7 != 0, "delivered").otherwise("unknown")
    return read(spark, sf_dir, "supplier").select("s_suppkey", control.outcome_record(outcome, F.concat(F.lit("v"), k), F.lit("not_better"), F.when(k % 5 != 0, k)).alias("record"))


def artifact_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as files against specifications of which some have another size or digest."""
    k, content = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = read(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    size = F.octet_length("content") + F.when(k % 9 == 0, 1).otherwise(0)
    sha256 = F.when(k % 4 == 0, "0").otherwise(F.sha2("content", 256))
    return rows.select("doc_id", control.artifact_reason(F.col("content"), size, sha256).alias("reason"))


def session_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors of single words that hit each document, and whether none does."""
    sessions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"))
    return detect.findings(sessions, _word_hits(spark, sf_dir)).select(F.col("session_id").alias("doc_id"), F.array_join("detectors", ",").alias("detectors"), "clean")


def early_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a session with its flags: the first reason against it."""
    k = F.col("o_orderkey")
    problems = F.when(k % 13 == 0, F.array(F.lit("low_confidence_word"), F.lit("word_outside_audio"))).when(k % 3 == 0, F.array(F.lit("low_confidence_word")))
    reason = removal.early_reason(F.when(k % 19 == 0, "malformed_answer"), k % 17 == 0, k % 11, k % 29, F.when(k % 7 == 0, "de").when(k % 31 != 0, "en"), F.when(k % 2 == 0, k % 5 == 0), problems)
    return read(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


QUERIES = (deletion_requests, node_kinds, cleanup_report, unexpired_scopes, client_use, grant_refusals, recordable_metadata, outcome_records, artifact_reasons, session_findings, early_reasons)

SQL = {
    "deletion_requests": f"""SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority < '3' THEN o_orderkey WHEN o_orderstatus = 'F' THEN {NOW} END AS sent_at, CASE WHEN o_orderstatus = 'F' THEN {NOW} END AS completed_at, o_orderstatus <> 'F' AS pending FROM orders""",
    "node_kinds": "SELECT 'customer-' || c_custkey AS node, c_mktsegment AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)",
    "cleanup_report": """SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 40 <= 15) AS expired_scopes, (SELECT count(*) FROM events WHERE event_id % 9 <= 4) AS expired_metadata""",
    "unexpired_scopes": f"SELECT o_orderkey, {NOW} + (o_orderkey % 40 - 15) * 3600 AS expires_at FROM orders WHERE o_orderkey % 40 > 15",
    "client_use": """SELECT c_custkey AS client_id, coalesce(CASE WHEN c_custkey % 6 <> 0 THEN max(o_orderkey) END, CASE WHEN c_custkey % 4 = 0 THEN 7 END) AS last_used_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "grant_refusals": "SELECT c_custkey, CASE WHEN (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) OR strlen(c_name) * (c_custkey % 9 + 1) > 128 THEN 'purpose_not_grantable' END AS reason FROM customer",
    "recordable_metadata": "SELECT event_id, NOT (event_id % 7 = 0 OR event_id % 5 = 0 OR (event_id % 3 <> 0 AND event_id % 11 = 0)) AS ok FROM events",
    "outcome_records": """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '{"outcome":"cancelled"}' WHEN s_suppkey % 3 = 0 THEN '{"outcome":"kept_base_model","reason":"not_better","evaluation":' || e || '}' WHEN s_suppkey % 7 <> 0 THEN '{"outcome":"delivered","model_version":"v' || s_suppkey || '","evaluation":' || e || '}' END AS record
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'null' ELSE s_suppkey::VARCHAR END AS e FROM supplier)""",
    "artifact_reasons": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'size_mismatch' WHEN doc_id % 4 = 0 THEN 'checksum_mismatch' END AS reason FROM documents",
    "session_findings": f"""SELECT d.doc_id, coalesce(string_agg(DISTINCT detector, ',' ORDER BY detector), '') AS detectors, count(detector) = 0 AS clean FROM documents d LEFT JOIN ({TRANSCRIPTS["identifier_hits"]}) h ON h.doc_id = d.doc_id GROUP BY d.doc_id""",
    "early_reasons": """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'malformed_answer' WHEN o_orderkey % 17 = 0 THEN 'uncertain_analysis' WHEN o_orderkey % 11 = 0 THEN 'empty_transcript' WHEN o_orderkey % 29 = 0 THEN 'no_audio' WHEN o_orderkey % 7 = 0 OR o_orderkey % 31 = 0 THEN 'language_not_validated'
  WHEN o_orderkey % 10 = 0 THEN 'session_silent' WHEN o_orderkey % 13 = 0 THEN 'alignment_unusable' END AS reason FROM orders""",
}
