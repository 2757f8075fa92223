"""State machines and timers over the events of users, orders as jobs; each with recursive SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import machines, recording, resample, splice
from vellum.plans.tables import read

_RECORDING = ("hold_down", "capture_started", "lock", "hold_up", "stop", "finalized", "delivered", "toggle", "cancel", "failed", "capture_started", "reset")
_ACTIONS = ("hold", "lock", "hold", "toggle", "hold", "cancel", "hold")
_CALLS = ("start", "begin_finalization", "finalization_completed", "delivery_completed", "start", "cancel", "fail", "begin_finalization")
#: Limits that users' events, some hours apart, can meet.
LIMIT, WARN, GRACE = 72_000, 14_400, 200
PENDING, LIFETIME, RATE, SPAN = 1, 10, 2, 400
STEP = 60


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("second", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def recording_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's recordings with a warning and an end by the clock."""
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select("user_id", (F.col("second") * 1000).alias("at"), _pick(_RECORDING, k).alias("event"), F.when(k % 7 != 0, "s").otherwise("").alias("session"))
    return machines.run(rows, machines.RecordingLimit(LIMIT, WARN), "user_id").select("user_id", "at", "event", "before", "after", "accepted")


def shortcut_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select("user_id", F.floor(F.col("second") / 100).alias("at"), _pick(_ACTIONS, k).alias("action"), (k % 3 != 0).alias("pressed"))
    return machines.run(rows, machines.Shortcuts(GRACE), "user_id")


def pairing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    m, group = k % 7, F.floor(k / 7)
    action = F.when(m.isin(0, 6), "open").when((m == 2) & (F.col("event_type") != "error"), F.when(k % 2 == 0, "approve").otherwise("deny")).otherwise("poll")
    name = F.concat(F.when(m == 6, "q").otherwise("p"), group)
    secret = F.when(m == 4, "wrong").otherwise(F.concat(F.lit("secret-"), group))
    rows = _events(spark, sf_dir).select((group % 20).alias("server"), F.floor(F.col("second") / 100).alias("at"), action.alias("action"), name.alias("pairing_id"), secret.alias("secret"), F.concat(F.lit("token-"), k).alias("token"))
    return machines.run(rows, machines.Pairings(PENDING, LIFETIME, RATE, SPAN), "server")


def live_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's calls; some name another session or an older epoch."""
    w = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)")
    k = F.col("event_id")
    rows = _events(spark, sf_dir).withColumn("n", w).select("user_id", k.alias("at"), _pick(_CALLS, F.col("n")).alias("call"), F.when(k % 11 == 0, "t").otherwise("s").alias("session"), (F.floor(F.col("n") / 8) + F.when(k % 5 == 0, 0).otherwise(1)).alias("epoch"))
    return machines.run(rows, machines.Phases(), "user_id")


def partial_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("at"), F.when(F.col("event_type").isin("error", "click"), "done").otherwise("poll").alias("kind"), F.col("event_id").alias("captured"))
    return machines.run(rows, machines.PartialPasses(STEP), "user_id")


def online_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("at"), (F.col("value") > 15).alias("loud"))
    return machines.run(rows, machines.Speech(2, 3), "user_id")


def preempted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs whose lines are stages; the foreground is busy around each event of the device."""
    busy = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("device_id"), F.col("second").alias("start"), (F.col("second") + 3000).alias("end"))
    checks = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("device_id"), F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), (F.lit(1_704_067_200) + F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 1000, F.lit(2_592_000))).alias("at"))
    return machines.preempted(checks, busy, width=3600)


#: From and to, in samples a second.
RATES = (44_100, 16_000)


def resampled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as samples, in chunks of fifty orders, at another rate."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.floor(F.col("l_orderkey") / 50).alias("seq"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"), (F.col("l_partkey") % 2000 - 1000).alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    chunks = lines.groupBy(F.col("l_suppkey").alias("session_id"), "seq").agg(listed.alias("samples"))
    out = resample.resampled(chunks, *RATES)
    return out.select(F.col("session_id").alias("l_suppkey"), "first", F.posexplode("samples").alias("k", "value")).select("l_suppkey", (F.col("first") + F.col("k")).alias("n"), F.col("value").cast("long").alias("value"))


QUERIES = (resampled_audio, recording_limits, shortcut_events, pairing_answers, live_phases, partial_passes, online_speech, preempted_jobs)

_MOVES = ", ".join(f"('{s}', '{e}', '{after}', {str(reason is None).lower()})" for (s, e), (after, _, reason) in recording.table().items())
_SECOND = "floor(epoch(ts))::BIGINT"
SQL = {
    "resampled_audio": f"""WITH x AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_partkey % 2000 - 1000 AS v FROM lineitem),
w AS (SELECT unnest({splice.low_pass_weights(*RATES)}::DOUBLE[]) AS w, unnest(range(63)) AS k),
o AS (SELECT s, i, i * {RATES[1]} // {RATES[0]} AS n FROM x WHERE (i + 1) * {RATES[1]} // {RATES[0]} > i * {RATES[1]} // {RATES[0]})
SELECT o.s AS l_suppkey, n, least(32767, greatest(-32768, round(sum(x.v * w.w))))::BIGINT AS value FROM o JOIN w ON true JOIN x ON x.s = o.s AND x.i = o.i - 62 + w.k GROUP BY o.s, n""",
    "recording_limits": f"""WITH RECURSIVE moves(s, event, t, ok) AS (VALUES {_MOVES}),
e AS (SELECT user_id, {_SECOND} * 1000 AS "at", ({list(_RECORDING)})[event_id % 12 + 1] AS event, event_id % 7 <> 0 AS named FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", event, named) AS i FROM e UNION ALL SELECT user_id, 1::BIGINT << 61, NULL, false, count(*) + 1 FROM e GROUP BY user_id),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS "at", NULL::VARCHAR AS event, 'idle' AS s0, 'idle' AS s1, 'idle' AS s2, NULL::BIGINT AS warn_at, NULL::BIGINT AS end_at, false AS ok, 0::BIGINT AS started, false AS warned, 0::BIGINT AS last FROM e
  UNION ALL
  SELECT user_id, i, "at", event, s, x.s1, x.s2, w, l, x.ok, CASE WHEN x.s1 = 'idle' AND x.s2 <> 'idle' THEN "at" ELSE started END, NOT (x.s1 = 'idle' AND x.s2 <> 'idle') AND (warned OR w IS NOT NULL), greatest(coalesce(l, w, last), "at")
  FROM (
    SELECT *, CASE WHEN l IS NOT NULL THEN 'finalizing' ELSE s END AS s1 FROM (
      SELECT *, CASE WHEN s IN ('recording_held', 'recording_locked') AND greatest(coalesce(w, last), started + {LIMIT * 1000}) < "at" AND (warned OR w IS NOT NULL OR greatest(last, started + {(LIMIT - WARN) * 1000}) >= started + {LIMIT * 1000}) THEN greatest(coalesce(w, last), started + {LIMIT * 1000}) END AS l FROM (
        SELECT n.*, f.s2 AS s, f.started, f.warned, f.last,
          CASE WHEN f.s2 IN ('recording_held', 'recording_locked') AND NOT f.warned AND greatest(f.last, f.started + {(LIMIT - WARN) * 1000}) < least(n."at", f.started + {LIMIT * 1000}) THEN greatest(f.last, f.started + {(LIMIT - WARN) * 1000}) END AS w
        FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
    )
  ) AS y, LATERAL (SELECT y.s1, coalesce(CASE WHEN y.s1 = 'idle' AND y.event IN ('hold_down', 'toggle') AND NOT named THEN y.s1 ELSE (SELECT t FROM moves WHERE moves.s = y.s1 AND moves.event = y.event) END, y.s1) AS s2,
    coalesce((SELECT m.ok FROM moves m WHERE m.s = y.s1 AND m.event = y.event), false) AND NOT (y.s1 = 'idle' AND y.event IN ('hold_down', 'toggle') AND NOT named) AS ok) x
),
shown AS (
  SELECT user_id, "at", event, s1 AS a, s2 AS b, ok FROM f WHERE event IS NOT NULL
  UNION ALL SELECT user_id, warn_at, 'warning', s0, s0, true FROM f WHERE warn_at IS NOT NULL
  UNION ALL SELECT user_id, end_at, 'duration_limit', s0, 'finalizing', true FROM f WHERE end_at IS NOT NULL
)
SELECT user_id, "at", event, regexp_replace(a, '^starting.*', 'starting') AS before, regexp_replace(b, '^starting.*', 'starting') AS after, ok AS accepted FROM shown""",
    "shortcut_events": f"""WITH e AS (SELECT user_id, {_SECOND} // 100 AS "at", ({list(_ACTIONS)})[event_id % 7 + 1] AS action, event_id % 3 <> 0 AS pressed FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", action, pressed) AS i FROM e),
good AS (SELECT * FROM n QUALIFY pressed <> coalesce(lag(pressed) OVER (PARTITION BY user_id, action ORDER BY i), false)),
held AS (SELECT *, min(CASE WHEN pressed AND action IN ('hold', 'lock') THEN "at" END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stopped FROM good)
SELECT user_id, "at", CASE action WHEN 'hold' THEN 'hold_down' ELSE action END AS event FROM good WHERE pressed
UNION ALL SELECT user_id, "at" + {GRACE}, 'hold_up' FROM held WHERE NOT pressed AND action = 'hold' AND coalesce(stopped > "at" + {GRACE}, true)""",
    "pairing_answers": f"""WITH RECURSIVE e AS (
  SELECT event_id // 7 % 20 AS server, {_SECOND} // 100 AS "at", CASE WHEN event_id % 7 IN (0, 6) THEN 'open' WHEN event_id % 7 = 2 AND event_type <> 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE 'deny' END ELSE 'poll' END AS action,
    CASE WHEN event_id % 7 = 6 THEN 'q' ELSE 'p' END || event_id // 7 AS pairing_id, CASE WHEN event_id % 7 = 4 THEN 'wrong' ELSE 'secret-' || event_id // 7 END AS secret, 'token-' || event_id AS token FROM events
),
n AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY "at", action, pairing_id, secret, token) AS i FROM e),
f AS (
  SELECT DISTINCT server, 0::BIGINT AS i, NULL::BIGINT AS "at", '' AS action, '' AS pairing_id, '' AS result, NULL::VARCHAR AS given, []::BIGINT[] AS log, []::STRUCT(id VARCHAR, made BIGINT, stage VARCHAR, secret VARCHAR, token VARCHAR)[] AS entries FROM e
  UNION ALL
  SELECT server, i, "at", action, pairing_id, result, CASE WHEN action = 'poll' AND result = 'approved' THEN own.token END,
    CASE WHEN action = 'open' AND result <> 'rate_limited' THEN list_append(log, "at") WHEN action = 'open' THEN log ELSE log END,
    CASE WHEN result = 'opened' THEN list_append(list_filter(live, lambda x: x.id <> pairing_id), {{'id': pairing_id, 'made': "at", 'stage': 'pending', 'secret': secret, 'token': NULL::VARCHAR}}) WHEN result = 'rate_limited' OR result = 'refused' THEN entries
      WHEN result = 'done' THEN list_transform(entries, lambda x: CASE WHEN x.id = pairing_id THEN {{'id': x.id, 'made': x.made, 'stage': CASE WHEN action = 'approve' THEN 'approved' ELSE 'denied' END, 'secret': x.secret, 'token': CASE WHEN action = 'approve' THEN token END}} ELSE x END)
      WHEN result IN ('approved', 'denied') THEN list_filter(live, lambda x: x.id <> pairing_id) ELSE live END
  FROM (
    SELECT *, CASE WHEN action = 'open' THEN CASE WHEN len(log) >= {RATE} THEN 'rate_limited' WHEN len(list_filter(live, lambda x: x.stage = 'pending')) >= {PENDING} THEN 'too_many_pending' ELSE 'opened' END
      WHEN action = 'poll' THEN CASE WHEN own IS NULL OR own.secret <> secret THEN 'unknown' ELSE own.stage END WHEN was IS NULL OR was.stage <> 'pending' THEN 'refused' ELSE 'done' END AS result
    FROM (
      SELECT *, list_filter(live, lambda x: x.id = pairing_id)[1] AS own, list_filter(entries, lambda x: x.id = pairing_id)[1] AS was
      FROM (SELECT n.*, CASE WHEN n.action = 'open' THEN list_filter(f.log, lambda t: n."at" - t < {SPAN}) ELSE f.log END AS log, f.entries, list_filter(f.entries, lambda x: n."at" - x.made < {LIFETIME}) AS live FROM f JOIN n ON n.server = f.server AND n.i = f.i + 1)
    )
  )
)
SELECT server, "at", action, pairing_id, result, given AS token FROM f WHERE i > 0""",
    "live_phases": f"""WITH RECURSIVE n AS (
  SELECT user_id, event_id AS "at", ({list(_CALLS)})[i % 8 + 1] AS call, CASE WHEN event_id % 11 = 0 THEN 't' ELSE 's' END AS session, i // 8 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS epoch, i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS "at", '' AS call, '' AS session, 0::BIGINT AS epoch, NULL::VARCHAR AS phase, NULL::VARCHAR AS reason, 0::BIGINT AS last, NULL::VARCHAR AS who FROM events
  UNION ALL
  SELECT user_id, i, "at", call, session, CASE WHEN begun THEN last + 1 ELSE epoch END, CASE WHEN begun THEN 'capturing' WHEN reason IS NOT NULL THEN phase WHEN call = 'begin_finalization' THEN 'finalizing' WHEN call = 'finalization_completed' THEN 'delivering' END, reason, CASE WHEN begun THEN last + 1 ELSE last END, CASE WHEN begun THEN session WHEN reason IS NOT NULL THEN who WHEN call IN ('begin_finalization', 'finalization_completed') THEN who END
  FROM (
    SELECT *, reason IS NULL AND call = 'start' AS begun FROM (
      SELECT n.*, f.phase, f.last, f.who, CASE WHEN n.call = 'start' THEN CASE WHEN f.phase IS NOT NULL THEN 'busy' END WHEN f.phase IS NULL THEN 'no_active_session' WHEN n.session <> f.who OR n.epoch <> f.last THEN 'stale_completion'
        WHEN f.phase <> CASE n.call WHEN 'begin_finalization' THEN 'capturing' WHEN 'finalization_completed' THEN 'finalizing' WHEN 'delivery_completed' THEN 'delivering' ELSE f.phase END THEN 'wrong_phase' END AS reason
      FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1
    )
  )
)
SELECT user_id, "at", call, session, epoch, phase, reason FROM f WHERE i > 0""",
    "partial_passes": f"""WITH RECURSIVE n AS (SELECT user_id, event_id, event_type IN ('error', 'click') AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, false AS begun, false AS busy, 0::BIGINT AS before, 0::BIGINT AS stop FROM events
  UNION ALL
  SELECT user_id, i, event_id, begun, begun OR (busy AND NOT done), stop, CASE WHEN begun THEN event_id ELSE stop END FROM (SELECT n.*, f.busy, f.stop, NOT n.done AND NOT f.busy AND n.event_id - f.stop >= {STEP} AS begun FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
)
SELECT user_id, event_id AS "at", before AS first, stop FROM f WHERE begun""",
    "online_speech": """WITH n AS (SELECT user_id, event_id, value > 15 AS loud, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT *, i - coalesce(max(CASE WHEN loud THEN NULL ELSE i END) OVER w, 0) AS louds, i - coalesce(max(CASE WHEN loud THEN i END) OVER w, 0) AS quiets FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i)),
t AS (SELECT *, max(CASE WHEN louds >= 2 THEN i END) OVER w AS last_on, max(CASE WHEN quiets >= 3 THEN i END) OVER w AS last_off FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, event_id AS "at", last_on IS NOT NULL AND last_on > coalesce(last_off, 0) AS speech FROM t""",
    "preempted_jobs": f"""WITH c AS (SELECT l_orderkey % 10 AS device_id, l_orderkey AS job_id, l_linenumber AS stage, 1704067200 + (l_orderkey * 7919 + l_linenumber * 1000) % 2592000 AS "at" FROM lineitem)
SELECT device_id, job_id, min(stage) FILTER (busy) AS stopped_at, CASE WHEN bool_or(busy) THEN 'local_pending' ELSE 'ended' END AS state
FROM (SELECT c.*, EXISTS (SELECT 1 FROM events WHERE user_id % 10 = device_id AND c."at" >= {_SECOND} AND c."at" < {_SECOND} + 3000) AS busy FROM c) GROUP BY device_id, job_id""",
}
