"""Queries over the order, event and conversation tables: intervals, control tables, evaluation, audio frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import numbers
from vellum.operators import control, evaluate, intervals, vad
from vellum.plans.transcripts import read

NOW = 1_735_689_600  # what the queries take as the present


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of orders: two for each line. Quantities become whole as in SQL: the nearest, of two the even one."""
    start = F.col("l_linenumber") * 12 + F.col("l_partkey") % 40
    return read(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + F.rint("l_quantity").cast("long") % 15).alias("end"))


KEY = ["l_orderkey"]


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_spans(spark, sf_dir), KEY)


def interval_pad_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = intervals.padded(F.col("start"), F.col("end"), 3, F.lit(10), F.lit(100))
    return intervals.merge(_spans(spark, sf_dir).select("l_orderkey", s.alias("start"), e.alias("end")), KEY)


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(20).cast("long").alias("low"), F.lit(110).cast("long").alias("high"))


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.complement(intervals.merge(_spans(spark, sf_dir), KEY), _bounds(spark, sf_dir), KEY)


def interval_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.destinations(interval_complement(spark, sf_dir), KEY)
    return out.select("l_orderkey", "start", "end", F.col("index").cast("long").alias("index"), "to_start", "to_end")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each order's cells of 30 its merged intervals cover."""
    cells = _bounds(spark, sf_dir).select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(120).cast("long"), F.lit(30).cast("long"))).alias("start")).withColumn("end", F.col("start") + 30)
    return intervals.overlap_lengths(cells, intervals.merge(_spans(spark, sf_dir), KEY), KEY, 64)


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar rules on sample counts and milliseconds."""
    n, end = F.col("l_partkey"), F.col("l_partkey") + F.col("l_suppkey")
    (a, b), (c, d) = numbers.removal_at(n, end, 44_100), numbers.retained_at(n, end, 44_100)
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.samples(n, 44_100).alias("samples"), numbers.clip_milliseconds(n).alias("clip_ms"), numbers.buffer_milliseconds(n).alias("buffer_ms"), numbers.whole_seconds(n).alias("seconds"),
        a.alias("removed_start"), b.alias("removed_end"), c.alias("kept_start"), d.alias("kept_end"),
    )


def usage_per_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.usage(read(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long")), "l_suppkey", "size")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", numbers.day(F.col("at")).alias("day")).agg(F.count("*").alias("packages"), F.sum(numbers.whole_seconds(F.col("event_id"))).alias("seconds"))


def daily_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_volume(spark, sf_dir).select("user_id", "day", control.over_quota(F.col("packages"), F.col("seconds"), 3, 20).alias("reason"))


def _consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's consent: some withdrawn, paused, expired, of an old version or without the purpose."""
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("tenant_id"), F.concat(F.lit("consent-"), key).alias("consent_id"), F.lit(NOW - 10 * 86_400).cast("long").alias("granted_at"), (F.lit(NOW) + (key % 13 - 2) * 86_400).alias("expires_at"),
        F.when(key % 5 == 0, NOW - key).alias("withdrawn_at"), (key % 7 == 0).alias("paused"), F.when(key % 11 == 0, "1").otherwise("2").alias("version"),
        F.when(key % 17 == 0, F.array()).otherwise(F.array(F.lit(control.PURPOSE))).alias("purposes"),
    )


def consent_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.concat(F.lit("consent-"), F.col("o_custkey")).alias("consent_id"), F.col("o_orderkey").alias("sample_id"))
    return control.trainable(samples, _consents(spark, sf_dir), NOW).select("tenant_id", "sample_id")


def session_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each order of each customer isn't eligible, by the consent that it stands under; some customers have none."""
    consents = _consents(spark, sf_dir).withColumnRenamed("withdrawn_at", "revoked_at")
    consents = consents.withColumn("consent_id", F.when(F.col("tenant_id") % 23 != 0, F.col("consent_id")))
    sessions = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("tenant_id"), (F.lit(NOW) - F.col("o_orderkey") % 20 * 86_400).alias("started_at"), (F.col("o_orderkey") % 19 == 0).alias("opted_out"), F.when(F.col("o_orderkey") % 3 == 0, "de").otherwise("en").alias("language"))
    reason = control.consent_refusal(NOW, "2", "test", "started_at", "opted_out", "language")
    return sessions.join(consents, "tenant_id", "left").select("o_orderkey", reason.alias("reason"))


def full_session_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; an earlier name."""
    return session_eligibility(spark, sf_dir)


def tombstone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tombstones = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return control.absent(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), tombstones, ["o_orderkey"])


def orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order that is filled."""
    live = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return control.orphans(read(spark, sf_dir, "customer").select("c_custkey"), live, "c_custkey")


def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.last_wins(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def first_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", numbers.day(F.col("at")).alias("day"), "at", "event_id")
    return control.first_wins(rows, ["user_id", "event_type", "day"], ["at", "event_id"])


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.col("event_id") % 10
    return read(spark, sf_dir, "events").select("event_id", numbers.retry_delay(attempts, F.col("event_type") != "error").alias("delay"), numbers.next_midnight(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("next_midnight"))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tenant"), "o_orderdate", "o_orderkey")
    return control.time_split(rows, "tenant", ["o_orderdate", "o_orderkey"]).select("tenant", "o_orderkey", "held_out")


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda k: (F.col("s_suppkey") * k % 100) / F.lit(200.0)
    ok = control.accepted(rate(7), rate(3), rate(11), rate(13), 0.05, 0.01)
    return read(spark, sf_dir, "supplier").select("s_suppkey", ok.alias("accepted"))


def consent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = _events(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("at").alias("granted_at"), F.col("event_id").alias("consent_id"))
    return control.consent_history(grants, "user_id", "granted_at")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions, customers under nations, orders under customers."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    return (
        read(spark, sf_dir, "nation").select(node("region", "n_regionkey").alias("parent"), node("nation", "n_nationkey").alias("child"))
        .union(read(spark, sf_dir, "customer").select(node("nation", "c_nationkey"), node("customer", "c_custkey")))
        .union(read(spark, sf_dir, "orders").select(node("customer", "o_custkey"), node("order", "o_orderkey")))
    )


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("node"))
    return control.descendants(_edges(spark, sf_dir), roots)


def cascade_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each tenant's samples after a deletion, and how many nodes it revokes."""
    samples = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("sample_id"))
    requested = samples.where("tenant_id < 3")
    stay, revoked = control.deletion(samples, _edges(spark, sf_dir), requested)
    return stay.groupBy("tenant_id").agg(F.count("*").alias("samples")).crossJoin(F.broadcast(revoked.agg(F.count("*").alias("revoked"))))  # one row on the right


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs folded over their requests."""
    target = F.element_at(F.create_map(*(F.lit(x) for kv in {"signup": "analyzing", "view": "building", "click": "eligible", "purchase": "uploading", "error": "local_pending"}.items() for x in kv)), F.col("event_type"))
    return control.fold_states(_events(spark, sf_dir).withColumn("target", target), "user_id", ["at", "event_id"], "target")


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that don't follow the one before within 60 ids."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("step"))
    return rows.where("step > 60")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a user fall in the hour up to each, and whether that is within 2."""
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)
    return _events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("recent"), (F.count("*").over(w) <= 2).alias("allowed"))


def recall_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluate.tallies(rows.withColumn("hit", F.col("quality") == 1), ["lang", "source"], "hit")


def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before, by role."""
    return evaluate.word_error_rate(_turn_pairs(spark, sf_dir), by=["role"])


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "role", "reference", F.col("text").alias("hypothesis"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up signal for each supplier: 40 frames of 16 samples, some loud."""
    pos = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(639).cast("long")))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), pos.alias("pos"))
    loud = ((F.col("pos") / 16).cast("long") * 7 + F.col("session_id") * 3) % 11 < 5
    return rows.withColumn("value", F.when(loud, (F.col("pos") * 37 % 200 - 100) * 80).otherwise(F.col("pos") % 7 - 3))


def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vad.levels(_samples(spark, sf_dir), 16)
    return out.select("session_id", "frame_ix", F.round(F.col("level").cast("double"), 3).alias("level"))


def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vad.floors(vad.levels(_samples(spark, sf_dir), 16))
    return out.select("session_id", F.round(F.col("floor").cast("double"), 3).alias("floor"))


def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of speech after hysteresis."""
    return vad.speech_intervals(vad.activity(vad.levels(_samples(spark, sf_dir), 16)), 16)


QUERIES = (
    interval_merge, interval_pad_merge, interval_complement, interval_destinations, interval_overlap, rounding, usage_per_tenant, daily_volume, daily_caps, consent_semi_join, session_eligibility, full_session_eligibility, tombstone_anti_join, orphan_objects,
    latest_delivery, first_receipt, retry_backoff, time_split, promotion, consent_history, lineage_closure, cascade_deletion, job_states, sequence_gaps, rate_limit, recall_tallies, word_error_rate, audio_frames, noise_floors, speech_runs,
)


def _merged(rows: str) -> str:
    """CTEs that end in ``merged`` (l_orderkey, s, e)."""
    return f"""
spans AS ({rows}),
i1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM spans WHERE e > s),
i2 AS (SELECT *, sum(nw) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM i1),
merged AS (SELECT l_orderkey, min(s) AS s, max(e) AS e FROM i2 GROUP BY l_orderkey, g)"""


_SPANS = "SELECT l_orderkey, l_linenumber * 12 + l_partkey % 40 AS s, l_linenumber * 12 + l_partkey % 40 + l_quantity::BIGINT % 15 AS e FROM lineitem"
_GAPS = """
gaps AS (
  SELECT o_orderkey AS k, greatest(20, coalesce(max(e) OVER (PARTITION BY o_orderkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20)) AS a, least(110, s) AS b FROM orders JOIN merged ON o_orderkey = l_orderkey
  UNION ALL SELECT o_orderkey, greatest(20, coalesce(max(e), 20)), 110 FROM orders LEFT JOIN merged ON o_orderkey = l_orderkey GROUP BY o_orderkey
),
kept AS (SELECT k AS l_orderkey, a AS start, b AS "end" FROM gaps WHERE b > a)"""
_CONSENT = f"""
consent AS (
  SELECT c_custkey AS tenant_id, 'consent-' || c_custkey AS consent_id, {NOW} - 864000 AS granted_at, {NOW} + (c_custkey % 13 - 2) * 86400 AS expires_at, CASE WHEN c_custkey % 5 = 0 THEN {NOW} - c_custkey END AS withdrawn_at,
    c_custkey % 7 = 0 AS paused, CASE WHEN c_custkey % 11 = 0 THEN '1' ELSE '2' END AS version, c_custkey % 17 <> 0 AS purpose FROM customer
)"""
_DAILY = "SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, count(*) AS packages, sum((event_id + 999) // 1000)::BIGINT AS seconds FROM events GROUP BY 1, 2"
_EDGES = """
edges AS (
  SELECT 'region-' || n_regionkey AS parent, 'nation-' || n_nationkey AS child FROM nation UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey FROM customer
  UNION ALL SELECT 'customer-' || o_custkey, 'order-' || o_orderkey FROM orders
)"""
_FRAMES = """
x AS (SELECT s_suppkey AS session_id, unnest(range(640)) AS pos FROM supplier),
v AS (SELECT session_id, pos, CASE WHEN ((pos // 16) * 7 + session_id * 3) % 11 < 5 THEN (pos * 37 % 200 - 100) * 80 ELSE pos % 7 - 3 END AS value FROM x),
f AS (SELECT session_id, pos // 16 AS frame_ix, avg((value / 32768.0::DOUBLE) * (value / 32768.0::DOUBLE)) AS mean FROM v GROUP BY 1, 2),
l AS (SELECT session_id, frame_ix, (CASE WHEN mean <= 1e-12 THEN -120 ELSE 10 * log10(mean) END)::FLOAT AS level FROM f)"""
SQL = {
    "interval_merge": f'WITH {_merged(_SPANS)} SELECT l_orderkey, s AS start, e AS "end" FROM merged',
    "interval_pad_merge": f'WITH {_merged(f"SELECT l_orderkey, greatest(s - 3, 10) AS s, greatest(least(e + 3, 100), greatest(s - 3, 10)) AS e FROM ({_SPANS})")} SELECT l_orderkey, s AS start, e AS "end" FROM merged',
    "interval_complement": f"WITH {_merged(_SPANS)}, {_GAPS} SELECT * FROM kept",
    "interval_destinations": f"""WITH {_merged(_SPANS)}, {_GAPS} SELECT *, row_number() OVER w - 1 AS "index", (sum("end" - start) OVER w - ("end" - start))::BIGINT AS to_start, (sum("end" - start) OVER w)::BIGINT AS to_end FROM kept WINDOW w AS (PARTITION BY l_orderkey ORDER BY start ROWS UNBOUNDED PRECEDING)""",
    "interval_overlap": f"""WITH {_merged(_SPANS)}, cells AS (SELECT o_orderkey AS l_orderkey, unnest(range(0, 121, 30)) AS a FROM orders)
SELECT c.l_orderkey, a AS start, a + 30 AS "end", sum(CASE WHEN e IS NULL THEN 0 ELSE greatest(0, least(a + 30, e) - greatest(a, s)) END)::BIGINT AS covered FROM cells c LEFT JOIN merged m ON c.l_orderkey = m.l_orderkey AND s < a + 30 AND e > a GROUP BY ALL""",
    "rounding": """SELECT l_orderkey, l_linenumber, (l_partkey * 44100 + 500) // 1000 AS samples, (l_partkey * 1000 + 8000) // 16000 AS clip_ms, l_partkey * 1000 // 16000 AS buffer_ms, (l_partkey + 999) // 1000 AS seconds,
  l_partkey * 44100 // 16000 AS removed_start, ((l_partkey + l_suppkey) * 44100 + 15999) // 16000 AS removed_end, (l_partkey * 44100 + 15999) // 16000 AS kept_start,
  greatest((l_partkey * 44100 + 15999) // 16000, (l_partkey + l_suppkey) * 44100 // 16000) AS kept_end FROM lineitem""",
    "usage_per_tenant": "SELECT l_suppkey, count(*) AS samples, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS total FROM lineitem GROUP BY l_suppkey",
    "daily_volume": _DAILY,
    "daily_caps": f"SELECT user_id, day, CASE WHEN packages >= 3 THEN 'daily_package_cap_reached' WHEN seconds >= 20 THEN 'daily_duration_cap_reached' END AS reason FROM ({_DAILY})",
    "consent_semi_join": f"WITH {_CONSENT} SELECT o_custkey AS tenant_id, o_orderkey AS sample_id FROM orders WHERE EXISTS (SELECT 1 FROM consent WHERE tenant_id = o_custkey AND withdrawn_at IS NULL AND expires_at > {NOW})",
    "session_eligibility": f"""WITH {_CONSENT}
SELECT o_orderkey, CASE WHEN consent_id IS NULL THEN 'no_consent' WHEN withdrawn_at IS NOT NULL OR expires_at <= {NOW} THEN 'consent_expired_or_revoked' WHEN paused THEN 'consent_paused' WHEN version <> '2' THEN 'consent_version_outdated'
  WHEN NOT purpose THEN 'purpose_not_granted' WHEN {NOW} - o_orderkey % 20 * 86400 < granted_at THEN 'session_before_consent' WHEN o_orderkey % 19 = 0 THEN 'session_opted_out' WHEN o_orderkey % 3 = 0 THEN 'language_not_validated' END AS reason
FROM orders LEFT JOIN (SELECT * FROM consent WHERE tenant_id % 23 <> 0) ON tenant_id = o_custkey""",
    "tombstone_anti_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "orphan_objects": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "latest_delivery": "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "first_receipt": """SELECT user_id, event_type, day, "at", event_id, duplicates FROM (SELECT *, count(*) OVER k - 1 AS duplicates, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY "at", event_id) AS r
  FROM (SELECT user_id, event_type, floor(epoch(ts) / 86400)::BIGINT AS day, floor(epoch(ts))::BIGINT AS "at", event_id FROM events) WINDOW k AS (PARTITION BY user_id, event_type, day)) WHERE r = 1""",
    "retry_backoff": "SELECT event_id, CASE WHEN event_type <> 'error' AND event_id % 10 < 8 THEN least(30 * 2 ** greatest(event_id % 10 - 1, 0), 21600)::BIGINT END AS delay, (floor(epoch(ts) / 86400)::BIGINT + 1) * 86400 AS next_midnight FROM events",
    "time_split": """SELECT tenant, o_orderkey, r > n - greatest(ceil(n * 0.2::DOUBLE), 30) AS held_out FROM (SELECT o_orderstatus AS tenant, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
    "promotion": """SELECT s_suppkey, (s_suppkey * 7 % 100) / 200.0::DOUBLE - (s_suppkey * 3 % 100) / 200.0::DOUBLE >= 0.05::DOUBLE AND (s_suppkey * 13 % 100) / 200.0::DOUBLE - (s_suppkey * 11 % 100) / 200.0::DOUBLE <= 0.01::DOUBLE AS accepted FROM supplier""",
    "consent_history": "SELECT user_id, floor(epoch(ts))::BIGINT AS granted_at, event_id AS consent_id, lead(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS revoked_at FROM events WHERE event_type = 'signup'",
    "lineage_closure": f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT child AS node FROM edges WHERE parent IN ('region-0', 'region-1') UNION SELECT child FROM reach JOIN edges ON parent = node) SELECT DISTINCT node FROM reach""",
    "cascade_deletion": """SELECT c_nationkey AS tenant_id, count(*) AS samples, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 3) AS revoked FROM customer WHERE c_nationkey >= 3 GROUP BY c_nationkey""",
    "sequence_gaps": "SELECT * FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) WHERE step > 60",
    "rate_limit": """SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 2 AS allowed FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS "at" FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""",
    "recall_tallies": """WITH t AS (
  SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS value, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS caught, count(*) AS total
  FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))
), p AS (SELECT *, caught / total::DOUBLE AS p, total::DOUBLE AS n, 1.959964::DOUBLE AS z FROM t)
SELECT dimension, value, caught, total, p AS recall, greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)) AS low,
  least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)) AS high FROM p""",
    "audio_frames": f"WITH {_FRAMES} SELECT session_id, frame_ix, round(level::DOUBLE, 3) AS level FROM l",
    "noise_floors": f"WITH {_FRAMES} SELECT session_id, round((list(level ORDER BY level))[greatest(1, count(*) // 5)]::DOUBLE, 3) AS floor FROM l GROUP BY session_id",
}
SQL["full_session_eligibility"] = SQL["session_eligibility"]
