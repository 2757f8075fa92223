"""Jobs, consents, deliveries, segments and clips from the given tables: the operators that other queries don't run, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import numbers
from vellum.functions import text as T
from vellum.operators import control, detect, evaluate, intervals, recognised, records, splice, training, vad
from vellum.plans.tables import read
from vellum.sources import clip_files
from vellum.sources import transcripts as source

#: A time in the middle of the orders' dates, and how they are read as seconds.
NOW = 800_000_000
_DAY = "floor(epoch(o_orderdate))::BIGINT"
_OPEN = "state NOT IN ('acknowledged', 'rejected', 'deleted')"
_STATES = ("local_pending", "analyzing", "building", "eligible", "uploading", "acknowledged", "rejected", "deleted", "unheard_of")


def _seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: their states by priority and key, their times by their dates."""
    at = _seconds("o_orderdate")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("tenant_id"), control.decoded_state(state).alias("state"), F.when(F.col("o_orderstatus") == "F", "failed").alias("reason"), at.alias("updated_at"),
        (at + F.col("o_totalprice").cast("long") * 100).alias("expires_at"), F.when(F.col("o_orderstatus") == "O", at + 86_400).alias("next_attempt_at"), F.col("o_orderpriority").alias("priority"),
    )


_JOBS = f"""j AS (SELECT o_orderkey AS job_id, o_custkey AS tenant_id, ['local_pending', 'analyzing', 'building', 'eligible', 'uploading', 'acknowledged', 'rejected', 'deleted', 'rejected'][o_orderkey % 9 + 1] AS state, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS reason,
  {_DAY} AS updated_at, {_DAY} + trunc(o_totalprice)::BIGINT * 100 AS expires_at, CASE WHEN o_orderstatus = 'O' THEN {_DAY} + 86400 END AS next_attempt_at, o_orderpriority AS priority FROM orders)"""


def job_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs may be uploaded now, which are to be cleaned up, which have work left."""
    jobs = _jobs(spark, sf_dir)
    flag = lambda rows, name: rows.select("job_id", F.lit(True).alias(name))
    out = jobs.join(flag(control.ready(jobs, NOW), "ready"), "job_id", "left").join(flag(control.stale(jobs, NOW), "stale"), "job_id", "left")
    return out.select("job_id", F.coalesce("ready", F.lit(False)).alias("ready"), F.coalesce("stale", F.lit(False)).alias("stale"), control.pending(F.col("state")).alias("pending"), F.col("state").isin(*control.predecessors("deleted")).alias("may_be_deleted"))


def moved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded moves: the first line of an order asks its job to move on; withdrawn tenants' jobs are cancelled after."""
    jobs = _jobs(spark, sf_dir).drop("updated_at", "expires_at", "priority")
    asked = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")).alias("l"))
    moves = asked.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l.l_returnflag") == "A", "analyzing").when(F.col("l.l_returnflag") == "N", "rejected").otherwise("eligible").alias("target"), F.when(F.col("l.l_linestatus") == "F", "asked").alias("reason"), F.when(F.col("l.l_partkey") % 2 == 0, F.col("l.l_partkey")).alias("next_attempt_at"))
    moved = control.apply_moves(jobs, moves)
    gone = control.cancelled(moved.where("tenant_id % 10 = 0"), "consent_withdrawn").select(moved.columns)
    return moved.where("tenant_id % 10 <> 0").union(gone).select("job_id", "state", "reason", "next_attempt_at", "outcome")


def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as attempts to upload."""
    q, p, n = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_linenumber")
    state = F.when(F.col("l_returnflag") == "R", "deleted").otherwise("uploading")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("l_linenumber"), F.when(q > 45, "no_consent").alias("refusal"), F.when(q < 5, "daily_package_cap_reached").alias("cap"), (p % 7 != 0).alias("archive_present"), (p % 3 == 0).alias("acked"), (p % 2 == 0).alias("accepted"), state.alias("state"), (F.col("l_linestatus") == "O").alias("retriable"), (p % 10).cast("int").alias("attempts"))
    return rows.select("l_orderkey", "l_linenumber", control.upload_outcome(NOW).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_linenumber").alias("lines"))


def grown_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes that are there, orders as new ones under two parents each; some are there already."""
    orders = read(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    there = read(spark, sf_dir, "customer").select(name(F.col("c_custkey")).alias("node"), F.col("c_mktsegment").alias("kind"))
    old = orders.where("o_orderkey % 3 = 0").select(name(F.col("o_custkey")).alias("parent"), name(F.col("o_orderkey")).alias("child"))
    new = orders.select(name(F.col("o_orderkey")).alias("node"), F.col("o_orderpriority").alias("kind"), F.array(name(F.col("o_custkey")), name(F.floor(F.col("o_custkey") / 2))).alias("parents"))
    nodes, edges = control.lineage_added(there, old.distinct(), new)
    return nodes.select("node", "kind").union(edges.select(F.col("child"), F.concat(F.lit("from "), "parent")))


def training_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants with one job, their orders as samples, their first order as the run."""
    orders = read(spark, sf_dir, "orders")
    key, k = F.col("o_orderkey"), F.col("c_custkey")
    samples = orders.select(F.col("o_custkey").alias("tenant_id"), key.alias("sample_id"), F.concat(F.lit("c"), key % 4).alias("consent_id"), _seconds("o_orderdate").alias("received_at"), (F.col("o_custkey") % 29 != 0).alias("readable"))
    customers = read(spark, sf_dir, "customer")
    purposes = F.when(F.col("n") == 3, "product_improvement").when(k % 5 == 0, "product_improvement,customer_personalization").otherwise("customer_personalization")
    ends = F.when((k % 13 == 0) & (F.col("n") == 1), F.lit(NOW + 50)).otherwise(NOW + 1000)
    consents = customers.select("c_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("n")).select(k.alias("tenant_id"), F.concat(F.lit("c"), "n").alias("consent_id"), F.when((k % 17 == 0) & (F.col("n") == 2), "v1").otherwise("v2").alias("version"), purposes.alias("purposes"), ends.alias("expires_at"), F.when((k % 19 == 0) & (F.col("n") == 0), NOW - 5).alias("withdrawn_at"))
    jobs = customers.select(k.alias("tenant_id"), F.concat(F.lit("job"), k).alias("job_id"))
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("o"))
    price, r = F.col("o.o_totalprice").cast("long"), F.col("o.o_totalprice").cast("long") % 23
    magic = F.unhex(F.lit("6C6D6767" + "00" * 40))
    header = F.when(r == 7, F.lit(b"short")).when(r == 8, F.concat(magic, F.unhex(F.lit("08000000")))).when(r == 9, F.concat(F.unhex(F.lit("00" * 44)), F.unhex(F.lit("09000000")))).otherwise(F.concat(magic, F.unhex(F.lit("D9070000"))))
    rate = lambda m: (price % m).cast("double") / 100.0
    runs = first.select(
        F.concat(F.lit("job"), "o_custkey").alias("job_id"), (r == 0).alias("cancelled"), F.when(r == 1, None).when(r == 2, 1).otherwise(0).alias("trained_status"), (r != 3).alias("model_present"), (r != 4).alias("quantizer_started"),
        F.when(r == 5, None).when(r == 6, 2).otherwise(0).alias("quantizer_status"), header.alias("header"), (r == 10).alias("over_cap"), (r != 11).alias("regression_present"), F.when(r == 12, "worker_unavailable").alias("failure"),
        (rate(31) + 0.2).alias("heldout_base"), F.when(r == 13, None).otherwise(rate(37)).alias("heldout_candidate"), rate(11).alias("regression_base"), rate(13).alias("regression_candidate"), (price % 1200).alias("peak_mib"),
    )
    return training.outcomes(jobs, samples, consents, runs, NOW, NOW + 100, "v2", least_train=3, least_held=2)


def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a customer's samples, lines as their clips: the side and the name of each in the training folder."""
    samples = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("sample_id"), _seconds("o_orderdate").alias("received_at"))
    clips = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("clip_ix")).distinct()
    return clip_files.split_clips(samples, clips, 0.2, 2)


def live_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deliveries to customers, returned lines as revocations: the latest that still counts."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("version"), _seconds("o_orderdate").alias("created_at"))
    revoked = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("version")).distinct()
    return control.live_delivery(orders, revoked)


def consents_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as consents: the place of each in its customer's history, and which one holds now."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("consent_id"), _seconds("o_orderdate").alias("granted_at"), F.when(F.col("o_orderstatus") == "F", NOW).alias("revoked_at"))
    return control.consents_by_age(orders, "tenant_id")


def segment_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as recognised segments, heavy ones as speech."""
    lines = read(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 50
    segments = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n"), start.alias("start"), (start + F.col("l_suppkey") * 10 + 1).alias("end"), (F.col("l_discount") * 10).alias("no_speech"))
    speech = lines.where("l_quantity > 25").select(F.col("l_orderkey").alias("session_id"), (start + 40).alias("start"), (start + 60).alias("end"))
    whole = recognised.spoken_segments(segments, speech, 0.7).groupBy("session_id").agg(F.count("*").alias("spoken"), F.sum("n").alias("lines"))
    part = recognised.partial_segments(segments, F.lit(16), 0.5).groupBy("session_id").agg(F.count("*").alias("partial"), F.min("start").alias("first"), F.max("end").alias("last"))
    return whole.join(part, "session_id", "full_outer")


def word_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as words: times, confidences and order; orders as transcripts."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") + F.when(F.col("l_partkey") % 11 == 0, -1).otherwise(0)).alias("word_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey") - 20).alias("end"), (F.col("l_quantity") / 49.0).alias("confidence"))
    bad = lines.withColumn("why", recognised.word_reason(F.col("start"), F.col("end"), F.col("confidence"))).groupBy("session_id").agg(F.count_if(F.col("why") == "word_times_inverted").alias("inverted"), F.count_if(F.col("why") == "word_confidence_invalid").alias("unsure"), F.count("*").alias("words"), F.sum("end").alias("samples"))
    late = recognised.unordered_words(lines).groupBy("session_id").agg(F.count("*").alias("unordered"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).join(bad, "session_id", "left").join(late, "session_id", "left")
    return rows.select("session_id", "inverted", "unsure", F.coalesce("unordered", F.lit(0)).alias("unordered"), recognised.usable_reason(F.col("words"), F.when(F.col("samples") > 100, F.col("samples"))).alias("reason"))


def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, captions and terms of documents; control characters go, the last forty characters stay."""
    docs = read(spark, sf_dir, "documents")
    head = F.substring("text", 1, 200)
    terms = T.term_tokens(F.translate(head, "ß", "s"))
    return docs.select("doc_id", F.sha2(recognised.caption_tail(F.col("text"), 40), 256).alias("tail"), T.shown_name(F.col("text")).alias("name"), F.size(terms).alias("n_terms"), T.display(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("lang")).alias("display"))


def spliced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as clips, a line each, and its words in spoken form."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("clip_ix"), F.coalesce("text", F.lit("")).alias("text"))
    words = turns.select("session_id", F.posexplode(T.words(F.col("text"))).alias("k", "text"), "clip_ix").select("session_id", (F.col("clip_ix") * 100_000 + F.col("k")).alias("word_id"), "text")
    joined = splice.spliced_text(turns).join(splice.spoken_text(words).withColumnRenamed("text", "spoken"), "session_id", "left")
    return joined.select(F.col("session_id").alias("conv_id"), F.sha2("text", 256).alias("lines"), F.sha2(F.coalesce("spoken", F.lit("")), 256).alias("spoken"))


def clip_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as clips of a supplier's samples, put one after another; clips beyond the audio are left out."""
    audio = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]), 1, 40).alias("audio"))
    start = F.col("l_linenumber") * 4
    clips = read(spark, sf_dir, "lineitem").where("l_orderkey % 5 = l_suppkey % 5").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").cast("long").alias("size"))
    cut = clips.join(audio, "l_suppkey").withColumn("samples", splice.clip_samples(F.col("audio"), start.cast("long"), start + F.col("size")))
    out = splice.spliced_samples(cut.where("samples IS NOT NULL").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("clip_ix"), "samples"))
    return out.select(F.col("session_id").alias("l_orderkey"), F.size("samples").alias("n"), F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("check"))


def session_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as frames of their order, the heavy ones as speech: how much of a session is speech, and whether that is next to none."""
    frames = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("size"), (F.col("l_quantity") > 40).alias("speech"))
    return vad.speech_ratios(frames).select(F.col("session_id").alias("l_orderkey"), F.round(F.col("ratio").cast("double"), 5).alias("ratio"), "silent")


def benign_over_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sessions of words, their discount as what was removed."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n_words"), F.floor(F.col("l_quantity") * F.col("l_discount")).alias("n_removed"), (F.col("l_returnflag") == "R").alias("refused"))
    return evaluate.over_redaction(rows)


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases by status and priority, caught where cheap, with the benign lines: one JSON document, and what it holds."""
    cases = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") < 100_000).alias("hit"))
    tallied = evaluate.tallies(cases, ["o_orderstatus", "o_orderpriority"], "hit")
    benign = evaluate.over_redaction(read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n_words"), F.floor(F.col("l_quantity") * F.col("l_discount")).alias("n_removed"), (F.col("l_returnflag") == "R").alias("refused")))
    held = F.from_json("report", "tallies array<struct<dimension:string,value:string,caught:bigint,total:bigint,low:double>>, benign struct<words:bigint,removed:bigint,refused:bigint>")
    return evaluate.report(tallied, benign).select(held.alias("r")).select(F.explode("r.tallies").alias("t"), "r.benign.*").select("t.dimension", "t.value", "t.caught", "t.total", F.round("t.low", 6).alias("low"), "words", "removed", "refused")


def mandatory_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans of rules, terms and models: what must be cut whatever a model says."""
    kind = F.when(F.col("l_returnflag") == "A", "rules").when(F.col("l_returnflag") == "R", "user_terms").otherwise("model")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("stop"), kind.alias("source"))
    return detect.mandatory(rows).groupBy("session_id").agg(F.count("*").alias("spans"), F.min("start").alias("first"), F.max("stop").alias("last"))


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as records: keys that aren't known, among ``k`` and one more in five."""
    record = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"extra": 1, '), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(records.unknown_keys(record, ["k"]), ",").alias("unknown"), F.size(records.unknown_keys(record, ["extra"])).alias("others"))


def interval_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of an order as intervals: whether they meet, touch, hold a point; lengths in time."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "b")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 60).alias("a"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("long") % 30).alias("b"))
    both = lines.select("*", F.lead("a").over(w).alias("c"), F.lead("b").over(w).alias("d"))
    a, b, c, d = map(F.col, "abcd")
    rows = both.select("l_orderkey", "a", "b", intervals.intersects(a, b, c, d).alias("meets"), intervals.touches(a, b, c, d).alias("touches"), intervals.contains(a, b, c).alias("holds"), numbers.milliseconds(b).alias("ms"), numbers.centiseconds_to_samples(a - 30).alias("samples"))
    total = intervals.total_length(lines.withColumnsRenamed({"a": "start", "b": "end"}), ["l_orderkey"])
    tallied = rows.groupBy("l_orderkey").agg(F.count_if("meets").alias("meets"), F.count_if("touches").alias("touches"), F.count_if("holds").alias("holds"), F.round(F.sum("ms"), 4).alias("ms"), F.sum("samples").alias("samples"))
    return tallied.join(total, "l_orderkey")


def shifted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a segment's words, moved by its key."""
    words = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("start"), F.col("l_partkey").alias("end"))).alias("words"))
    return words.select("l_orderkey", F.explode(source.shifted(F.col("words"), F.col("l_orderkey"))).alias("w")).groupBy("l_orderkey").agg(F.sum("w.start").alias("starts"), F.sum("w.end").alias("ends"))


def seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind as clients may see them, final transcripts among them."""
    kinds = ("session.started", "transcript.partial", "transcript.final", "session.stopped", "error")
    events = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int")).alias("kind"))
    wanted = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("transcript.final"), F.lit("error")))
    scopes = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("status:read"))).otherwise(F.array(F.lit("transcript:final"), F.lit("transcript:live")))
    clients = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("client_id"), scopes.alias("scopes"), wanted.alias("wanted"))
    # Counted by kind before clients meet them: the pairs of clients and events are never made. There are five kinds at most.
    tallied = events.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return control.permitted(F.broadcast(tallied), clients).groupBy("client_id", "kind").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def listed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that may be uploaded or are being built, with another attempt's time where an order of the customer asks for one."""
    jobs = _jobs(spark, sf_dir).withColumn("created_at", F.col("updated_at"))
    asked = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("at"))
    again = control.rescheduled(jobs, asked)
    return control.jobs_in(again, ["eligible", "building"]).select("job_id", "state", "next_attempt_at", "done")


def ended_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cancel or refuse the uploads of their order; the packages that go."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 40")
    ends = lines.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "A", "cancel").otherwise("reject").alias("kind"), F.col("l_linestatus").alias("reason"))
    jobs, scopes = control.ended_uploads(_jobs(spark, sf_dir).select("job_id", "state", "reason"), ends)
    return jobs.join(scopes.withColumn("dropped", F.lit(True)), F.col("scope") == F.concat(F.lit("package:"), F.col("job_id").cast("string")), "left").select("job_id", "state", "reason", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def late_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("receipt_id"), (F.col("l_returnflag") != "R").alias("accepted"))
    return control.late_deletions(_jobs(spark, sf_dir), receipts)


def final_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as final transcripts; what clients get, read again."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.char_length("text").cast("long").alias("end_ms"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    back = F.from_json("event", "version int, kind string, session string, seq long, start_ms long, end_ms long, text string, is_final boolean")
    return control.final_events(rows).select(back.alias("e"), F.array_join(F.json_object_keys("event"), ",").alias("keys")).select("keys", "e.kind", "e.session", "e.seq", "e.start_ms", "e.end_ms", F.sha2(F.coalesce("e.text", F.lit("")), 256).alias("text"), "e.is_final")


def client_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as clients with the scopes that they were given and a ratio as manifests hold it."""
    scopes = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("status:read"))).otherwise(F.array(F.lit("transcript:final"), F.lit("transcript:live")))
    clients = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("client_id"), F.col("s_nationkey").alias("created_at"), control.scopes_text(scopes).alias("scopes"), numbers.manifest_ratio(F.abs("s_acctbal") / 10_000).alias("ratio"))
    return control.clients_by_age(clients)


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as numbered events of a part: what is missing in between."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return control.sequence_gaps(rows, ["session_id"])


def span_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", control.span_reason(F.col("l_linenumber"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 6)).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def deleted_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("tenant_id"))
    deliveries = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select((F.col("o_custkey") + 1).alias("tenant_id"))
    return control.deleted_tenant(samples, deliveries)


QUERIES = (
    listed_jobs, ended_uploads, late_deletions, final_transcripts, client_list, event_gaps, span_reasons, deleted_tenants,
    job_cleanup, moved_jobs, upload_outcomes, grown_lineage, training_outcomes, clip_names, live_deliveries, consents_newest_first, segment_filters, word_checks, shown_texts, spliced_texts, clip_audio, session_speech, benign_over_redaction, evaluation_report, mandatory_spans, record_keys, interval_relations,
    shifted_words, seen_events,
)

SQL = {
    "listed_jobs": f"""WITH {_JOBS}, a AS (SELECT l_orderkey AS job_id, max(l_partkey) AS at_ FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey)
SELECT job_id, state, CASE WHEN at_ IS NOT NULL AND state = 'eligible' THEN at_ ELSE next_attempt_at END AS next_attempt_at, CASE WHEN at_ IS NOT NULL THEN state = 'eligible' END AS done FROM j LEFT JOIN a USING (job_id) WHERE state IN ('eligible', 'building')""",
    "ended_uploads": f"""WITH {_JOBS}, e AS (SELECT l_orderkey AS job_id, min({{'kind': CASE WHEN l_returnflag = 'A' THEN 'cancel' ELSE 'reject' END, 'reason': l_linestatus}}) AS e FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey)
SELECT job_id, CASE WHEN e IS NULL OR NOT {_OPEN} THEN state WHEN e.kind = 'cancel' THEN 'deleted' ELSE 'rejected' END AS state, CASE WHEN e IS NOT NULL AND {_OPEN} THEN e.reason ELSE reason END AS reason, e IS NOT NULL AND {_OPEN} AS dropped FROM j LEFT JOIN e USING (job_id)""",
    "late_deletions": f"""WITH {_JOBS} SELECT DISTINCT 'delete-' || l_orderkey || '-' || l_linenumber AS request_id, l_orderkey AS job_id, 'receipt:' || l_orderkey || '-' || l_linenumber AS scope FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT job_id FROM j WHERE state = 'deleted')""",
    "final_transcripts": """SELECT CASE WHEN turn % 3 <> 0 AND text IS NOT NULL THEN 'version,kind,session,seq,start_ms,end_ms,text,is_final' ELSE 'version,kind,session,seq,start_ms,end_ms,is_final' END AS keys, 'transcript.final' AS kind, conv_id::VARCHAR AS session, turn AS seq, 0::BIGINT AS start_ms, length(text) AS end_ms,
  sha256(CASE WHEN turn % 3 <> 0 THEN coalesce(text, '') ELSE '' END) AS text, true AS is_final FROM conversations""",
    "client_list": """SELECT s_suppkey AS client_id, s_nationkey AS created_at, CASE WHEN s_suppkey % 2 = 0 THEN 'status:read' ELSE 'transcript:final,transcript:live' END AS scopes, round(abs(s_acctbal) / 10000::DOUBLE, 4) AS ratio FROM supplier""",
    "event_gaps": """WITH e AS (SELECT DISTINCT l_suppkey AS session_id, l_orderkey * 8 + l_linenumber AS seq FROM lineitem), b AS (SELECT *, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM e)
SELECT session_id, before AS "after", seq - before - 1 AS missing FROM b WHERE seq > before + 1""",
    "span_reasons": """WITH s AS (SELECT l_orderkey, l_linenumber AS a, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey % 6 END AS b FROM lineitem)
SELECT CASE WHEN b IS NULL THEN 'span_missing' WHEN b < a THEN 'span_inverted' WHEN b = a THEN 'span_empty' END AS reason, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM s GROUP BY 1""",
    "deleted_tenants": """WITH a AS (SELECT o_custkey AS t, count(*) AS samples FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey + 1 AS t, count(*) AS artifacts FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT coalesce(a.t, b.t) AS tenant_id, coalesce(samples, 0) AS samples, coalesce(artifacts, 0) AS artifacts FROM a FULL JOIN b ON a.t = b.t""",
    "job_cleanup": f"""WITH {_JOBS} SELECT job_id, state = 'eligible' AND coalesce(next_attempt_at, 0) <= {NOW} AS ready, CASE WHEN {_OPEN} THEN expires_at <= {NOW} ELSE updated_at + 7776000 <= {NOW} END AS stale, {_OPEN} AS pending, state <> 'deleted' AS may_be_deleted FROM j""",
    "moved_jobs": f"""WITH {_JOBS}, m AS (
  SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'analyzing' WHEN 'N' THEN 'rejected' ELSE 'eligible' END AS target, CASE WHEN l_linestatus = 'F' THEN 'asked' END AS why, CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS next
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) = 1
),
o AS (SELECT j.*, target, why, next, CASE target WHEN 'analyzing' THEN state = 'local_pending' WHEN 'rejected' THEN {_OPEN} WHEN 'eligible' THEN state IN ('building', 'uploading') ELSE false END AS ok FROM j LEFT JOIN m USING (job_id)),
d AS (SELECT job_id, tenant_id, CASE WHEN ok THEN target ELSE state END AS state, CASE WHEN ok THEN coalesce(why, reason) ELSE reason END AS reason, CASE WHEN ok THEN coalesce(next, next_attempt_at) ELSE next_attempt_at END AS next_attempt_at, CASE WHEN target IS NULL THEN 'none' WHEN ok THEN 'moved' ELSE 'conflict' END AS outcome FROM o)
SELECT job_id, CASE WHEN tenant_id % 10 = 0 AND {_OPEN} THEN 'deleted' ELSE state END AS state, CASE WHEN tenant_id % 10 = 0 AND {_OPEN} THEN 'consent_withdrawn' ELSE reason END AS reason, next_attempt_at, outcome FROM d""",
    "upload_outcomes": """WITH o AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN trunc(l_quantity) > 45 THEN 'cancelled' WHEN trunc(l_quantity) < 5 THEN 'deferred' WHEN l_partkey % 7 = 0 THEN 'rejected' WHEN l_partkey % 3 = 0 AND l_returnflag = 'R' THEN 'deletion_requested' WHEN l_partkey % 3 = 0 AND l_partkey % 2 = 0 THEN 'acknowledged'
    WHEN l_partkey % 3 = 0 THEN 'rejected' WHEN l_linestatus = 'O' AND l_partkey % 10 < 8 THEN 'retry' ELSE 'gave_up' END AS outcome FROM lineitem
)
SELECT outcome, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, sum(l_linenumber)::BIGINT AS lines FROM o GROUP BY outcome""",
    "grown_lineage": """WITH e AS (SELECT DISTINCT 'n' || o_custkey AS parent, 'n' || o_orderkey AS child FROM orders WHERE o_orderkey % 3 = 0),
x AS (SELECT 'n' || o_custkey AS parent, 'n' || o_orderkey AS child FROM orders UNION SELECT 'n' || (o_custkey // 2), 'n' || o_orderkey FROM orders)
SELECT 'n' || c_custkey AS node, c_mktsegment AS kind FROM customer
UNION ALL SELECT 'n' || o_orderkey, min(o_orderpriority) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey
UNION ALL SELECT child, 'from ' || parent FROM (SELECT * FROM e UNION SELECT * FROM x)""",
    "training_outcomes": f"""WITH c AS (
  SELECT c_custkey AS t, 'c' || n AS consent_id, CASE WHEN c_custkey % 13 = 0 AND n = 1 THEN {NOW} + 50 ELSE {NOW} + 1000 END AS ends FROM customer, range(4) AS r(n)
  WHERE n <> 3 AND NOT (c_custkey % 17 = 0 AND n = 2) AND NOT (c_custkey % 19 = 0 AND n = 0)
),
s AS (SELECT o_custkey AS t, count(*) FILTER (ends > {NOW}) AS n, count(*) FILTER (ends > {NOW} + 100) AS later FROM orders JOIN c ON t = o_custkey AND consent_id = 'c' || (o_orderkey % 4) GROUP BY o_custkey),
f AS (SELECT o_custkey AS t, trunc(o_totalprice)::BIGINT AS p, trunc(o_totalprice)::BIGINT % 23 AS r FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
w AS (SELECT *, coalesce(n, 0) >= 5 AS enough, greatest(ceil(coalesce(n, 0) * 0.2::DOUBLE), 2)::BIGINT AS held FROM (SELECT c_custkey AS t FROM customer) LEFT JOIN s USING (t) LEFT JOIN f USING (t)),
v AS (
  SELECT *, CASE WHEN r IN (10, 1) THEN 'compute_cap_exceeded' WHEN r = 2 THEN 'trainer_failed' WHEN r = 3 THEN 'trainer_produced_no_model' WHEN r = 4 THEN 'quantizer_unavailable' WHEN r = 5 THEN 'compute_cap_exceeded' WHEN r = 6 THEN 'quantizer_failed' WHEN r IN (7, 8, 9) THEN 'quantizer_produced_invalid_model'
    WHEN r = 11 THEN 'regression_set_missing' WHEN r = 12 THEN 'worker_unavailable' WHEN r = 13 THEN 'measurement_failed'
    WHEN NOT (((p % 31)::DOUBLE / 100.0::DOUBLE + 0.2::DOUBLE) - (p % 37)::DOUBLE / 100.0::DOUBLE >= 0.01::DOUBLE AND (p % 13)::DOUBLE / 100.0::DOUBLE - (p % 11)::DOUBLE / 100.0::DOUBLE <= 0.005::DOUBLE) THEN 'no_measured_improvement' WHEN p % 1200 > 1024 THEN 'exceeds_device_budget' END AS why FROM w
)
SELECT t AS tenant_id, 'job' || t AS job_id,
  CASE WHEN NOT enough OR t % 29 = 0 THEN 'kept_base_model' WHEN r IS NULL THEN 'pending' WHEN r = 0 THEN 'cancelled' WHEN why IS NOT NULL THEN 'kept_base_model' WHEN later < n THEN 'cancelled' ELSE 'delivered' END AS state,
  CASE WHEN NOT enough THEN 'insufficient_data' WHEN t % 29 = 0 THEN 'stored_sample_unreadable' WHEN r IS NULL OR r = 0 THEN NULL WHEN why IS NOT NULL THEN why WHEN later < n THEN 'consent_changed_during_training' END AS reason,
  CASE WHEN enough THEN n - held ELSE 0 END AS train, CASE WHEN enough THEN held ELSE 0 END AS held_out FROM v""",
    "clip_names": f"""WITH s AS (SELECT o_custkey AS tenant_id, o_orderkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY}, o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
c AS (SELECT DISTINCT l_orderkey AS sample_id, l_linenumber AS clip_ix FROM lineitem)
SELECT tenant_id, CASE WHEN n >= total - greatest(ceil(total * 0.2::DOUBLE), 2) THEN 'heldout' ELSE 'train' END AS split, lpad(n::VARCHAR, 6, '0') || '-' || lpad(clip_ix::VARCHAR, 3, '0') AS name, sample_id, clip_ix FROM s JOIN c USING (sample_id)""",
    "live_deliveries": f"""SELECT o_custkey AS tenant_id, o_orderkey AS version, {_DAY} AS created_at FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY} DESC, o_orderkey DESC) = 1""",
    "consents_newest_first": f"""WITH c AS (SELECT o_custkey AS tenant_id, o_orderkey AS consent_id, {_DAY} AS granted_at, o_orderstatus = 'F' AS revoked, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY} DESC, o_orderkey DESC) AS place FROM orders)
SELECT tenant_id, consent_id, place, NOT revoked AND place = min(CASE WHEN NOT revoked THEN place END) OVER (PARTITION BY tenant_id) AS current FROM c""",
    "segment_filters": """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey * 50 AS a, l_partkey * 50 + l_suppkey * 10 + 1 AS b, l_discount * 10 AS p FROM lineitem),
h AS (SELECT l_orderkey AS k, l_partkey * 50 + 40 AS a, l_partkey * 50 + 60 AS b FROM lineitem WHERE l_quantity > 25),
w AS (SELECT k, count(*) AS spoken, sum(n)::BIGINT AS lines FROM s WHERE p <= 0.7::DOUBLE AND EXISTS (SELECT 1 FROM h WHERE h.k = s.k AND h.a < s.b AND s.a < h.b) GROUP BY k),
q AS (SELECT k, count(*) AS partial, min(a) + 16 AS first, max(b) + 16 AS last FROM s WHERE p < 0.5::DOUBLE GROUP BY k)
SELECT coalesce(w.k, q.k) AS session_id, spoken, lines, partial, first, last FROM w FULL JOIN q ON w.k = q.k""",
    "word_checks": """WITH l AS (SELECT l_orderkey AS k, l_linenumber - CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS id, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS a, l_partkey + l_suppkey - 20 AS b, l_quantity / 49.0::DOUBLE AS p FROM lineitem),
u AS (SELECT k, count(*) FILTER (b < a) AS inverted, count(*) FILTER (b >= a AND NOT p BETWEEN 0 AND 1) AS unsure, sum(b) AS samples FROM l GROUP BY k),
o AS (SELECT k, count(*) FILTER (id <= before) AS unordered FROM (SELECT *, lag(id) OVER (PARTITION BY k ORDER BY pos) AS before FROM l) GROUP BY k)
SELECT o_orderkey AS session_id, inverted, unsure, coalesce(unordered, 0) AS unordered, CASE WHEN u.k IS NULL THEN 'empty_transcript' WHEN samples <= 100 THEN 'no_audio' END AS reason FROM orders LEFT JOIN u ON u.k = o_orderkey LEFT JOIN o ON o.k = o_orderkey""",
    "shown_texts": r"""SELECT doc_id, sha256(CASE WHEN length(text) > 40 THEN right(text, 40) ELSE text END) AS tail, left(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), 64) AS name,
  len(list_filter(string_split_regex(lower(translate(left(text, 200), 'ß', 's')), '[^\p{L}\p{M}\p{N}'']+'), lambda x: x <> '')) AS n_terms, CASE WHEN doc_id % 2 = 0 OR source = '' THEN lang ELSE source END AS display FROM documents""",
    "spliced_texts": rf"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(coalesce(text, ''), '{T.SPACES}'), lambda x: x <> '')) AS w, unnest(range(len(list_filter(string_split_regex(coalesce(text, ''), '{T.SPACES}'), lambda x: x <> '')))) AS k FROM conversations),
s AS (SELECT conv_id, string_agg(v, ' ' ORDER BY turn, k) AS spoken FROM (SELECT *, lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS v FROM w) WHERE v <> '' GROUP BY conv_id),
t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(lines) AS lines, sha256(coalesce(spoken, '')) AS spoken FROM t LEFT JOIN s USING (conv_id)""",
    "clip_audio": """WITH a AS (SELECT l_suppkey, list(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey)[1:40] AS audio FROM lineitem GROUP BY l_suppkey),
c AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, trunc(max(l_quantity))::BIGINT AS size FROM lineitem WHERE l_orderkey % 5 = l_suppkey % 5 GROUP BY ALL),
x AS (SELECT l_orderkey, l_linenumber, audio[l_linenumber * 4 + 1:l_linenumber * 4 + size] AS s FROM c JOIN a USING (l_suppkey) WHERE l_linenumber * 4 + size <= len(audio)),
f AS (SELECT l_orderkey, flatten(list(s ORDER BY l_linenumber)) AS s FROM x GROUP BY l_orderkey)
SELECT l_orderkey, len(s) AS n, list_sum(list_transform(s, lambda x, i: x * i))::BIGINT AS "check" FROM f""",
    "session_speech": """SELECT l_orderkey, round(r::DOUBLE, 5) AS ratio, r < 0.08::FLOAT AS silent
FROM (SELECT l_orderkey, coalesce(sum(CASE WHEN l_quantity > 40 THEN l_partkey ELSE 0 END) / nullif(sum(l_partkey), 0), 0)::FLOAT AS r FROM lineitem GROUP BY l_orderkey)""",
    "benign_over_redaction": """SELECT sum(trunc(l_quantity))::BIGINT AS words, sum(floor(l_quantity * l_discount))::BIGINT AS removed, sum(floor(l_quantity * l_discount)) / sum(trunc(l_quantity)) AS fraction, count(*) FILTER (l_returnflag = 'R') AS refused FROM lineitem""",
    "evaluation_report": """WITH t AS (SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS value, count(*) FILTER (o_totalprice < 100000) AS caught, count(*) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))),
p AS (SELECT *, caught / total::DOUBLE AS p, total::DOUBLE AS n, 1.959964::DOUBLE AS z FROM t),
b AS (SELECT sum(trunc(l_quantity))::BIGINT AS words, sum(floor(l_quantity * l_discount))::BIGINT AS removed, count(*) FILTER (l_returnflag = 'R') AS refused FROM lineitem)
SELECT dimension, value, caught, total, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS low, words, removed, refused FROM p, b""",
    "mandatory_spans": "SELECT l_orderkey AS session_id, count(*) AS spans, min(l_linenumber) AS first, max(l_linenumber) + 1 AS last FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey",
    "record_keys": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'extra' ELSE '' END AS unknown, 1 AS others FROM events",
    "interval_relations": """WITH l AS (SELECT l_orderkey, l_partkey % 60 AS a, l_partkey % 60 + trunc(l_quantity)::BIGINT % 30 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, trunc(l_quantity)::BIGINT % 30) AS i FROM lineitem),
p AS (SELECT x.*, y.a AS c, y.b AS d FROM l x LEFT JOIN l y ON x.l_orderkey = y.l_orderkey AND y.i = x.i + 1)
SELECT l_orderkey, count(*) FILTER (a < d AND c < b) AS meets, count(*) FILTER (a <= d AND c <= b) AS touches, count(*) FILTER (a <= c AND c < b) AS holds, round(sum(b / 16.0::DOUBLE), 4) AS ms, sum(greatest(a - 30, 0) * 160)::BIGINT AS samples, sum(b - a)::BIGINT AS length FROM p GROUP BY l_orderkey""",
    "shifted_words": "SELECT l_orderkey, sum(l_linenumber + l_orderkey)::BIGINT AS starts, sum(l_partkey + l_orderkey)::BIGINT AS ends FROM lineitem GROUP BY l_orderkey",
    "seen_events": """WITH e AS (SELECT event_id, ['session.started', 'transcript.partial', 'transcript.final', 'session.stopped', 'error'][event_id % 5 + 1] AS kind FROM events),
c AS (SELECT s_suppkey AS client_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['session.started', 'session.stopped', 'error'] ELSE ['transcript.partial', 'transcript.final'] END) AS kind FROM supplier)
SELECT client_id, kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e JOIN c USING (kind) WHERE client_id % 3 <> 0 OR kind IN ('transcript.final', 'error') GROUP BY client_id, kind""",
}
