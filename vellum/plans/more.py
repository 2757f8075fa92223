"""Queries on control tables in batches, recognised words, spliced clips and histories, with SQL that folds by recursion where an order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import control, recognised, recording, splice
from vellum.plans.tables import _CONSENT, _FRAMES, NOW, _consents, _events
from vellum.plans.transcripts import read


def admission_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a request of its customer: keys that repeat, wrong digests, samples deleted before, caps that fill up."""
    o = F.col("o_orderkey")
    requests = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tenant_id"), F.concat(F.lit("request-"), F.when(o % 9 == 0, o - o % 5).otherwise(o)).alias("key"), o.cast("long").alias("at"), F.when(o % 13 == 0, "x").otherwise("y").alias("declared_sha256"), F.lit("y").alias("archive_sha256"),
        (F.lit(1000) + o % 700).cast("long").alias("bytes"), F.when(o % 17 == 0, "manifest_keys").alias("package_reason"), F.concat(F.lit("sample-"), o).alias("sample_id"), F.concat(F.lit("consent-"), F.col("o_custkey")).alias("consent_id"),
    )
    limits = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), (F.col("c_custkey") % 5 + 3).alias("max_samples"), F.lit(6000).alias("max_bytes"))
    before = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), F.concat(F.lit("old-"), F.col("c_custkey")).alias("sample_id"), F.lit(500).cast("long").alias("bytes"))
    tombstones = read(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("sample-"), F.col("l_orderkey")).alias("sample_id")).distinct()
    receipts = spark.createDataFrame([], "tenant_id long, key string, accepted boolean, reason string")
    out = control.admissions(requests, receipts, _consents(spark, sf_dir), tombstones, before, limits, NOW)
    return out.select("at", "accepted", "reason", "duplicate")


def delivered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a model isn't taken, for each supplier as a delivery."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(
        "s_suppkey", (k % 7 != 0).alias("signed"), F.when(k % 5 == 0, "other").otherwise("base").alias("base"), F.when(k % 11 == 0, "x").otherwise("gguf").alias("format"), (k * 3 % 100).alias("memory"),
        (k % 3 != 0).alias("accepted"), F.sha2(k.cast("string"), 256).alias("sha256"), F.concat(F.lit("v"), F.when(k % 13 == 0, "_").otherwise("-"), k).alias("version"),
    )
    return rows.select("s_suppkey", control.delivery_reason("base", 90, "gguf").alias("reason"))


def paused_consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    consents = _consents(spark, sf_dir).withColumnRenamed("withdrawn_at", "revoked_at")
    requests = consents.where("tenant_id % 2 = 0").select("consent_id", (F.col("tenant_id") % 4 == 0).alias("pause"))
    return control.paused(consents, requests).select("consent_id", "paused")


def withdrawn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of customers that withdraw: what becomes of them, and whether the sample goes."""
    key = F.concat(F.lit("consent-"), F.col("o_custkey"))
    jobs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), key.alias("consent_id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "acknowledged").when(F.col("o_orderstatus") == "O", "eligible").otherwise("uploading").alias("state"), F.lit(None).cast("string").alias("reason"))
    consents = _consents(spark, sf_dir)
    asked = consents.where("tenant_id % 3 = 0").select("tenant_id", "consent_id")
    marked, ended, gone = control.withdrawn(consents, jobs, jobs.select("tenant_id", "consent_id", "job_id"), asked, NOW)
    return ended.join(marked.select("tenant_id", "withdrawn_at"), "tenant_id").join(gone.select("job_id", F.lit(True).alias("gone")), "job_id", "left").select("job_id", "state", "reason", "withdrawn_at", F.coalesce("gone", F.lit(False)).alias("gone"))


def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("running").alias("state"), F.lit(None).cast("string").alias("reason"), F.when(F.col("o_orderkey") % 10 == 0, 5).cast("long").alias("finished_at"))
    results = read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("at"), "l_returnflag", "l_linestatus").select("job_id", "at", F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("reason"))
    return control.finished(jobs, results)


def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as installs and rollbacks."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") == "error", "rollback").otherwise("install").alias("kind"), F.concat(F.lit("model-"), F.col("event_id")).alias("artifact"))
    return control.installs(rows, "user_id", ["event_id"])


#: The order in which the query below deals the machine's events to ids.
_RECORDING = ("hold_down", "capture_started", "lock", "hold_up", "stop", "finalized", "delivered", "toggle", "cancel", "failed", "duration_limit", "reset")


def recording_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as those of a recording device; a start in seven names no session."""
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.element_at(F.array(*map(F.lit, _RECORDING)), (k % 12 + 1).cast("int")).alias("event"), F.when(k % 7 != 0, "s").otherwise("").alias("session"))
    return recording.recorded(rows, "user_id", ["event_id"]).select("user_id", "event_id", "event", "before", "after", "accepted")


def deletion_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    scope = F.when(k % 5 == 0, "everything").when(k % 5 == 1, F.concat(F.lit("sample:"), k)).when(k % 5 == 2, F.concat(F.lit("receipt:a:"), k)).when(k % 5 == 3, "sample:").otherwise("other:1")
    return control.routed(read(spark, sf_dir, "orders").select("o_orderkey", scope.alias("scope")))


def oldest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "local_pending").otherwise("deleted").alias("state"), F.col("o_orderdate").alias("created_at"))
    return control.oldest_pending(jobs, ["o_custkey"]).select("o_custkey", "job_id", "created_at")


def authenticated_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda c: F.concat(F.lit("secret-"), c)
    tenants = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), control.token_hash(token(F.col("c_custkey"))).alias("token_hash"), (F.col("c_custkey") % 6 == 0).alias("disabled"))
    return control.authenticated(read(spark, sf_dir, "orders").select("o_orderkey", token(F.col("o_custkey") + F.col("o_orderkey") % 2).alias("token")), tenants)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of each number in an order."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a segment's tokens."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    lines = _lines(spark, sf_dir)
    text = F.when(p % 7 == 0, ".").when(p % 3 == 0, F.lit("ing")).otherwise(F.concat(F.lit(" w"), p % 50))
    tokens = lines.select(
        F.col("l_orderkey").alias("segment_id"), n.cast("long").alias("token_ix"), text.alias("text"), (n * 900 + p % 2000).cast("long").alias("onset"), F.lit(1000).cast("long").alias("low"), F.lit(7000).cast("long").alias("high"),
        (F.lit(6000) + F.col("l_orderkey") % 3000).cast("long").alias("total"), (p % 100 / F.lit(100.0)).alias("probability"), (p % 11 == 0).alias("guessed"),
    )
    out = recognised.grouped_words(tokens)
    return out.withColumn("confidence", F.round("confidence", 4))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber").cast("long"), F.col("l_linenumber") * 100 + F.col("l_partkey") % 40
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("session_id"), (n - 1).alias("clip_ix"), s.cast("long").alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))


def spliced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words a clip, renumbered on the new timeline."""
    words = _clips(spark, sf_dir).select("session_id", "clip_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("k"), "start", "end")
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    words = words.select("session_id", "clip_ix", (F.col("clip_ix") * 2 + F.col("k")).alias("word_id"), F.col("k").cast("string").alias("text"), F.when(F.col("k") == 0, F.col("start")).otherwise(middle).alias("start"), F.when(F.col("k") == 0, middle).otherwise(F.col("end")).alias("end"))
    return splice.renumbered(words, _clips(spark, sf_dir))


def mapped_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.explode(F.sequence(F.lit(90).cast("long"), F.lit(800).cast("long"), F.lit(71).cast("long"))).alias("at"))
    return splice.mapped(times, _clips(spark, sf_dir), 128)


def bounded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("long").alias("size"))
    return splice.bounded(rows, 120)


def mono_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") % 201 - 100, F.col("l_suppkey") % 95 - 47
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", splice.mono(a, b).alias("mono"))


QUERIES = (recording_states, 
    admission_answers, delivered_models, paused_consents, withdrawn_samples, finished_jobs, active_models, deletion_routes, oldest_jobs, authenticated_tenants, recognised_words, spliced_words, mapped_times, bounded_frames, mono_samples,
)

_CLIPS = """
clips AS (SELECT l_orderkey AS session_id, l_linenumber - 1 AS clip_ix, l_linenumber * 100 + l_partkey % 40 AS s, l_linenumber * 100 + l_partkey % 40 + l_quantity::BIGINT AS e FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
placed AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY session_id ORDER BY clip_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - s AS shift FROM clips)"""
_SPOKEN = r"list_filter([lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) for w in string_split_regex(coalesce(%s, ''), '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')], lambda x: x <> '')"
SQL = {
    "admission_answers": f"""WITH RECURSIVE {_CONSENT},
q AS (
  SELECT o_custkey AS t, 'request-' || CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - o_orderkey % 5 ELSE o_orderkey END AS key, o_orderkey AS "at", 1000 + o_orderkey % 700 AS bytes,
    CASE WHEN length('request-' || CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - o_orderkey % 5 ELSE o_orderkey END) < 8 THEN 'invalid_idempotency_key' WHEN o_orderkey % 13 = 0 THEN 'declared_checksum_mismatch' WHEN o_orderkey % 17 = 0 THEN 'invalid_package:manifest_keys'
      WHEN NOT EXISTS (SELECT 1 FROM consent WHERE tenant_id = o_custkey AND withdrawn_at IS NULL AND expires_at > {NOW}) THEN 'consent_not_active' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'sample_previously_deleted' END AS why FROM orders
),
k AS (SELECT *, "at" > min("at") OVER (PARTITION BY t, key) AS again FROM q),
open AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY "at", key) AS i FROM k WHERE why IS NULL AND NOT again),
fold AS (
  SELECT t, 0 AS i, 1 AS n, 500 AS b, NULL::BIGINT AS "at", true AS ok FROM (SELECT DISTINCT t FROM open)
  UNION ALL
  SELECT o.t, o.i, CASE WHEN x.ok THEN n + 1 ELSE n END, CASE WHEN x.ok THEN b + bytes ELSE b END, o."at", x.ok FROM fold f JOIN open o ON o.t = f.t AND o.i = f.i + 1, LATERAL (SELECT n < o.t % 5 + 3 AND b + bytes <= 6000 AS ok) x
),
head AS (SELECT k.t, k.key, k."at", CASE WHEN why IS NOT NULL THEN why WHEN NOT ok THEN 'tenant_storage_cap_reached' END AS reason FROM k LEFT JOIN fold f ON f."at" = k."at" WHERE NOT again)
SELECT k."at", head.reason IS NULL AS accepted, head.reason, again AS duplicate FROM k JOIN head USING (t, key)""",
    "delivered_models": """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'bad_signature' WHEN s_suppkey % 5 = 0 THEN 'incompatible_base' WHEN s_suppkey % 11 = 0 THEN 'unsupported_format' WHEN s_suppkey * 3 % 100 > 90 THEN 'exceeds_device_budget'
  WHEN s_suppkey % 3 = 0 THEN 'evaluation_not_accepted' WHEN s_suppkey % 13 = 0 THEN 'malformed_manifest' END AS reason FROM supplier""",
    "paused_consents": f"WITH {_CONSENT} SELECT consent_id, CASE WHEN withdrawn_at IS NULL AND tenant_id % 2 = 0 THEN tenant_id % 4 = 0 ELSE paused END AS paused FROM consent",
    "withdrawn_samples": f"""WITH {_CONSENT} SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'deleted' WHEN o_orderstatus = 'F' THEN 'acknowledged' WHEN o_orderstatus = 'O' THEN 'eligible' ELSE 'uploading' END AS state,
  CASE WHEN o_custkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'consent_withdrawn' END AS reason, CASE WHEN o_custkey % 3 = 0 THEN coalesce(withdrawn_at, {NOW}) ELSE withdrawn_at END AS withdrawn_at, o_custkey % 3 = 0 AS gone FROM orders JOIN consent ON tenant_id = o_custkey""",
    "finished_jobs": """WITH f AS (SELECT l_orderkey, l_linenumber AS "at", l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 25 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) = 1)
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 10 <> 0 AND "at" IS NOT NULL THEN l_returnflag ELSE 'running' END AS state, CASE WHEN o_orderkey % 10 <> 0 THEN l_linestatus END AS reason, CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE "at" END AS finished_at FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""",
    "recording_states": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ({list(_RECORDING)})[event_id % 12 + 1] AS event, event_id % 7 <> 0 AS named, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, '' AS event, '' AS before, 'idle' AS after, false AS locked, false AS stopped, false AS accepted FROM events
  UNION ALL
  SELECT user_id, i, event_id, event, s, t, CASE s WHEN 'idle' THEN event = 'toggle' WHEN 'starting' THEN locked OR event = 'lock' ELSE locked END, s = 'starting' AND (stopped OR later), t <> s OR (s = 'starting' AND (later OR event = 'lock')) OR (s = 'error' AND event = 'failed')
  FROM (
    SELECT e.*, f.after AS s, locked, stopped, e.event IN ('toggle', 'stop') OR (e.event = 'hold_up' AND NOT locked) AS later,
      CASE WHEN e.event = 'cancel' AND f.after NOT IN ('idle', 'cancelled') THEN 'cancelled' WHEN e.event = 'failed' AND f.after <> 'idle' THEN 'error' WHEN e.event = 'reset' AND f.after IN ('cancelled', 'error') THEN 'idle'
        WHEN f.after = 'idle' AND named AND e.event IN ('hold_down', 'toggle') THEN 'starting'
        WHEN f.after = 'starting' AND e.event = 'capture_started' THEN CASE WHEN stopped THEN 'finalizing' WHEN locked THEN 'recording_locked' ELSE 'recording_held' END
        WHEN f.after IN ('recording_held', 'recording_locked') AND e.event IN ('toggle', 'stop', 'duration_limit') THEN 'finalizing' WHEN f.after = 'recording_held' AND e.event = 'hold_up' THEN 'finalizing'
        WHEN f.after = 'recording_held' AND e.event = 'lock' THEN 'recording_locked' WHEN f.after = 'finalizing' AND e.event = 'finalized' THEN 'delivering' WHEN f.after = 'delivering' AND e.event = 'delivered' THEN 'idle' ELSE f.after END AS t
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1
  )
)
SELECT user_id, event_id, event, before, after, accepted FROM f WHERE i > 0""",
    "active_models": """WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS back, 'model-' || event_id AS artifact, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (
  SELECT user_id, 0 AS i, NULL::VARCHAR AS active, NULL::VARCHAR AS previous FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN back THEN previous ELSE artifact END, CASE WHEN back THEN NULL ELSE active END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, active, previous FROM r WHERE user_id IN (SELECT user_id FROM e WHERE NOT back) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "deletion_routes": """SELECT o_orderkey, scope, CASE WHEN o_orderkey % 5 = 0 THEN 'everything' WHEN o_orderkey % 5 = 1 THEN 'sample' WHEN o_orderkey % 5 = 2 THEN 'receipt' ELSE 'unknown' END AS route, CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey::VARCHAR WHEN o_orderkey % 5 = 2 THEN 'a:' || o_orderkey END AS target
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'everything' WHEN 1 THEN 'sample:' || o_orderkey WHEN 2 THEN 'receipt:a:' || o_orderkey WHEN 3 THEN 'sample:' ELSE 'other:1' END AS scope FROM orders)""",
    "oldest_jobs": "SELECT o_custkey, o_orderkey AS job_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "authenticated_tenants": "SELECT o_orderkey, c_custkey AS tenant_id FROM orders JOIN customer ON c_custkey = o_custkey + o_orderkey % 2 WHERE c_custkey % 6 <> 0",
    "recognised_words": r"""WITH t AS (
  SELECT l_orderkey AS segment_id, l_linenumber AS ix, CASE WHEN l_partkey % 7 = 0 THEN '.' WHEN l_partkey % 3 = 0 THEN 'ing' ELSE ' w' || l_partkey % 50 END AS text, l_linenumber * 900 + l_partkey % 2000 AS onset, l_partkey % 100 / 100.0::DOUBLE AS p, l_partkey % 11 = 0 AS guessed, least(7000, 6000 + l_orderkey % 3000) AS high FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)
), w0 AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ix) AS nr FROM t), w AS (SELECT *, sum(CASE WHEN starts_with(text, ' ') OR nr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY ix) - 1 AS word_ix FROM w0),
g AS (SELECT segment_id, word_ix, trim(string_agg(text, '' ORDER BY ix)) AS text, arg_min(onset, ix) AS onset, min(p) AS confidence, bool_or(guessed) AS guessed, max(high) AS high FROM w GROUP BY ALL),
s AS (SELECT *, least(greatest(max(onset) OVER (PARTITION BY segment_id ORDER BY word_ix), 1000), high) AS start FROM g),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY segment_id ORDER BY word_ix), high) AS "end", coalesce(lag(start) OVER (PARTITION BY segment_id ORDER BY word_ix), 1000) AS before FROM s)
SELECT segment_id, word_ix::BIGINT AS word_ix, text, start, "end", round(confidence, 4) AS confidence, guessed OR "end" = start OR onset < before AS unreliable FROM e""",
    "spliced_words": f"""WITH {_CLIPS}, w AS (SELECT session_id, clip_ix, k, CASE WHEN k = 0 THEN s ELSE (s + e) // 2 END + shift AS start, CASE WHEN k = 0 THEN (s + e) // 2 ELSE e END + shift AS "end" FROM placed, (VALUES (0), (1)) v(k))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY clip_ix, k) - 1 AS word_id, k::VARCHAR AS text, start::BIGINT AS start, "end"::BIGINT AS "end" FROM w""",
    "mapped_times": f"""WITH {_CLIPS}, t AS (SELECT o_orderkey AS session_id, unnest(range(90, 801, 71)) AS "at" FROM orders)
SELECT t.session_id, t."at", ("at" + shift)::BIGINT AS "to" FROM t LEFT JOIN placed p ON p.session_id = t.session_id AND "at" >= s AND "at" < e""",
    "bounded_frames": "SELECT l_orderkey AS session_id, l_linenumber AS seq, l_quantity::BIGINT AS size, max(CASE WHEN total > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 0 AS accepted FROM (SELECT *, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS total FROM lineitem)",
    "mono_samples": "SELECT l_orderkey, l_linenumber, trunc((l_partkey % 201 - 100 + l_suppkey % 95 - 47) / 2.0::DOUBLE)::BIGINT AS mono FROM lineitem",
    "job_states": """WITH RECURSIVE e AS (
  SELECT user_id, CASE event_type WHEN 'signup' THEN 'analyzing' WHEN 'view' THEN 'building' WHEN 'click' THEN 'eligible' WHEN 'purchase' THEN 'uploading' WHEN 'error' THEN 'local_pending' END AS target, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events
), r AS (
  SELECT user_id, 0 AS i, 'local_pending' AS state, 0 AS moved, 0 AS conflicts FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN ok THEN target ELSE state END, moved + ok::INT, conflicts + (NOT ok)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1,
    LATERAL (SELECT coalesce((state = 'local_pending' AND target = 'analyzing') OR (state = 'analyzing' AND target IN ('building', 'local_pending')) OR (state = 'building' AND target IN ('eligible', 'local_pending')) OR (state = 'eligible' AND target = 'uploading') OR (state = 'uploading' AND target = 'eligible'), false) AS ok) x
)
SELECT user_id, state, moved, conflicts FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "speech_runs": f"""WITH {_FRAMES}, q AS (SELECT session_id, (list(level ORDER BY level))[greatest(1, count(*) // 5)] AS floor FROM l GROUP BY session_id),
a AS (SELECT l.session_id, frame_ix, level >= greatest((floor + 9)::FLOAT, -55::FLOAT) AS loud FROM l JOIN q USING (session_id)),
b AS (SELECT *, frame_ix - coalesce(max(CASE WHEN NOT loud THEN frame_ix END) OVER w, -1) AS up, frame_ix - coalesce(max(CASE WHEN loud THEN frame_ix END) OVER w, -1) AS down FROM a WINDOW w AS (PARTITION BY session_id ORDER BY frame_ix)),
c AS (SELECT *, coalesce(last_value(CASE WHEN up >= 2 THEN true WHEN down >= 8 THEN false END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_ix ROWS UNBOUNDED PRECEDING), false) AS speech FROM b),
d AS (SELECT session_id, frame_ix, frame_ix - row_number() OVER (PARTITION BY session_id ORDER BY frame_ix) AS g FROM c WHERE speech)
SELECT session_id, min(frame_ix) * 16 AS start, (max(frame_ix) + 1) * 16 AS "end" FROM d GROUP BY session_id, g""",
    "word_error_rate": rf"""WITH RECURSIVE p AS (SELECT h.conv_id, h.turn, h.role, {_SPOKEN % 'r.text'} AS a, {_SPOKEN % 'h.text'} AS b FROM conversations h JOIN conversations r ON r.conv_id = h.conv_id AND r.turn = h.turn - 1),
d AS (
  SELECT conv_id, turn, 0 AS i, unnest(range(0, len(a) + 1)) AS j, unnest(range(0, len(a) + 1)) AS c FROM p
  UNION ALL
  SELECT conv_id, turn, i + 1, j, j + min(x - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
    SELECT d.conv_id, d.turn, i, j, CASE WHEN j = 0 THEN c + 1 ELSE least(c + 1, lag(c) OVER (PARTITION BY d.conv_id, d.turn ORDER BY j) + CASE WHEN a[j] = b[i + 1] THEN 0 ELSE 1 END) END AS x
    FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn AND len(b) > i)
)
SELECT role, sum(c)::BIGINT AS edits, sum(len(a))::BIGINT AS n_reference, sum(c) / nullif(sum(len(a)), 0)::DOUBLE AS wer FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn AND i = len(b) AND j = len(a) GROUP BY role""",
}
