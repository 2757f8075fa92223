"""Consents, jobs, receipts, quotas, lineage and deletion as operators on ordinary tables.

Rules with an order (the first that fails gives the reason) are one chain of conditions. Keys that may
be hot (a tenant with a third of all rows) are only ever reduced by aggregates, which combine before
the shuffle, or by windows over tables that were reduced first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.numbers import held_out_size

#: Job states, and which may follow which.
TRANSITIONS = {
    "local_pending": ("analyzing", "rejected", "deleted"),
    "analyzing": ("building", "local_pending", "rejected", "deleted"),
    "building": ("eligible", "local_pending", "rejected", "deleted"),
    "eligible": ("uploading", "rejected", "deleted"),
    "uploading": ("acknowledged", "eligible", "rejected", "deleted"),
    "acknowledged": ("deleted",),
    "rejected": ("deleted",),
    "deleted": (),
}
TERMINAL = ("acknowledged", "rejected", "deleted")
PURPOSE = "customer_personalization"
PURPOSES = (PURPOSE,)


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first check whose condition holds; null if none does. An unknown condition doesn't hold."""
    return F.coalesce(*(F.when(failed, F.lit(code)) for code, failed in checks))


def transitions(spark: SparkSession) -> DataFrame:
    """(state, target): the allowed moves of a job."""
    return spark.createDataFrame([(a, b) for a, targets in TRANSITIONS.items() for b in targets], "state string, target string")


def may_move(state: Column, target: Column) -> Column:
    return reduce(lambda x, y: x | y, ((state == a) & target.isin(*b) for a, b in TRANSITIONS.items() if b))


def predecessors(target: str) -> list[str]:
    return [a for a, b in TRANSITIONS.items() if target in b]


def decoded_state(state: Column) -> Column:
    """A state that isn't known counts as rejected."""
    return F.when(state.isin(*TRANSITIONS), state).otherwise("rejected")


def decoded_purposes(listed: Column) -> Column:
    """The known purposes of a comma list."""
    return F.filter(F.split(listed, ","), lambda p: p.isin(*PURPOSES))


def apply_moves(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """One requested move per job (job_id, target, reason, next_attempt_at): allowed ones happen, others are conflicts.

    A null in the request keeps what the job has. Columns: those of ``jobs`` and ``outcome``.
    """
    m = moves.select("job_id", "target", F.col("reason").alias("new_reason"), F.col("next_attempt_at").alias("new_next"))
    allowed = F.coalesce(may_move(F.col("state"), F.col("target")), F.lit(False))
    outcome = F.when(F.col("target").isNull(), "none").when(allowed, "moved").otherwise("conflict")
    return jobs.join(m, "job_id", "left").select(
        *(c for c in jobs.columns if c not in ("state", "reason", "next_attempt_at")), F.when(allowed, F.col("target")).otherwise(F.col("state")).alias("state"),
        F.when(allowed, F.coalesce("new_reason", "reason")).otherwise(F.col("reason")).alias("reason"), F.when(allowed, F.coalesce("new_next", "next_attempt_at")).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        outcome.alias("outcome"),
    )


def fold_states(requests: DataFrame, key: str, order: Sequence[str], target: str, initial: str = "local_pending") -> DataFrame:
    """(key, state, moved, conflicts) after all requests of a job in order; a move that isn't allowed changes nothing."""
    from vellum.operators import automata

    moves = {(a, t): t for a, targets in TRANSITIONS.items() for t in targets}
    rows = automata.states_before(requests, key, order, F.col(target), moves, initial)
    ok = F.coalesce(may_move(F.col("before"), F.col(target)), F.lit(False))
    last = F.max_by(F.when(ok, F.col(target)).otherwise(F.col("before")), automata.POSITION)
    return rows.groupBy(key).agg(last.alias("state"), F.count_if(ok).cast("int").alias("moved"), F.count_if(~ok).cast("int").alias("conflicts"))


def cancelled(jobs: DataFrame, reason: str) -> DataFrame:
    """Withdrawal: jobs that haven't ended are deleted."""
    open_ = ~F.col("state").isin(*TERMINAL)
    return jobs.withColumns({"reason": F.when(open_, F.lit(reason)).otherwise(F.col("reason")), "state": F.when(open_, "deleted").otherwise(F.col("state"))})


def ready(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where((F.col("state") == "eligible") & (F.coalesce("next_attempt_at", F.lit(0)) <= now))


def stale(jobs: DataFrame, now: int, keep: int = 90 * 86_400) -> DataFrame:
    """Ended jobs older than ``keep`` seconds and others that have expired."""
    ended = F.col("state").isin(*TERMINAL)
    return jobs.where((ended & (F.col("updated_at") + keep <= now)) | (~ended & (F.col("expires_at") <= now)))


def usage(samples: DataFrame, tenant: str, size: str) -> DataFrame:
    return samples.groupBy(tenant).agg(F.count("*").alias("samples"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))


def over_quota(samples: Column, seconds: Column, most_samples: int, most_seconds: int) -> Column:
    return first_reason([("daily_package_cap_reached", samples >= most_samples), ("daily_duration_cap_reached", seconds >= most_seconds)])


def consent_refusal(now: int, version: str, target: str = "local", started: str | None = None, opted_out: str | None = None, language: str | None = None) -> Column:
    """Why a consent row (consent_id, granted_at, expires_at, revoked_at, paused, version, purposes) doesn't allow a session."""
    active = F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    checks = [
        ("upload_disabled", F.lit(target == "disabled")), ("upload_gates_unmet", F.lit(target == "production")), ("no_consent", F.col("consent_id").isNull()), ("consent_expired_or_revoked", ~active),
        ("consent_paused", F.col("paused")), ("consent_version_outdated", F.col("version") != version), ("purpose_not_granted", ~F.array_contains("purposes", PURPOSE)),
    ]
    if started:
        checks.append(("session_before_consent", F.col(started) < F.col("granted_at")))
    if opted_out:
        checks.append(("session_opted_out", F.col(opted_out)))
    if language:
        checks.append(("language_not_validated", F.col(language) != "en"))
    return first_reason(checks)


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key its first row; how many came later is in ``duplicates``. Reduced before the shuffle, whatever the key."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    out = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r"), (F.count("*") - 1).alias("duplicates"))
    return out.select(*key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)), "duplicates")


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*key, *order)]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def absent(rows: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-if-absent: the rows whose key isn't known."""
    return rows.join(known.select(*key).distinct(), [*key], "left_anti")


def consent_history(grants: DataFrame, subject: str, granted: str) -> DataFrame:
    """A new consent revokes the one before: revoked_at is when the next begins."""
    return grants.withColumn("revoked_at", F.lead(granted).over(Window.partitionBy(subject).orderBy(granted, "consent_id")))


def trainable(samples: DataFrame, consents: DataFrame, now: int) -> DataFrame:
    active = consents.where((F.col("withdrawn_at").isNull()) & (F.col("expires_at") > now))
    return samples.join(active.select("tenant_id", "consent_id"), ["tenant_id", "consent_id"], "left_semi")


def orphans(objects: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    return objects.join(samples.select(key), key, "left_anti")


def time_split(rows: DataFrame, tenant: str, order: Sequence[str], fraction: float = 0.2, least: int = 30, place: str | None = None) -> DataFrame:
    """``held_out`` for the last rows of each tenant in time order; ``place`` names a column for a row's place, from 0.

    The rows' places are found without sorting a tenant in one task: a range split of the whole table,
    places within each part, and the counts of earlier parts.
    """
    from vellum.operators.storage import kept

    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written: the bounds of a range split are sampled, and both uses below must see the same parts.
    dealt = kept(rows.repartitionByRange(parts, tenant, *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", tenant).orderBy(*order)
    ranked = dealt.withColumn("__at", F.row_number().over(within))
    sizes = ranked.groupBy(tenant, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(tenant).orderBy("__part")
    sizes = sizes.select(tenant, "__part", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(tenant)).alias("__total"))
    joined = ranked.join(sizes, [tenant, "__part"])
    out = F.col("__before") + F.col("__at") > F.col("__total") - held_out_size(F.col("__total"), fraction, least)
    joined = joined if place is None else joined.withColumn(place, F.col("__before") + F.col("__at") - 1)
    return joined.withColumn("held_out", out).drop("__part", "__at", "__before", "__total")


def accepted(base: Column, candidate: Column, regression_base: Column, regression: Column, improvement: float, ceiling: float) -> Column:
    return (base - candidate >= F.lit(improvement)) & (regression - regression_base <= F.lit(ceiling))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all that the roots lead to, by semi-naive steps until none is new; roots only if they are reached. Cycles end."""
    from vellum.operators.storage import kept

    new = kept(edges.join(roots.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select(F.col("child").alias("node")).distinct())
    # Steps are put together like a binary counter's digits, so n steps are read as some log n tables and each row is written as often.
    parts: list[tuple[int, DataFrame]] = [(0, new)]
    reached = lambda: reduce(DataFrame.union, (p for _, p in parts))
    while not new.isEmpty():
        step = edges.join(new.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        new = kept(step.join(reached(), "node", "left_anti"))
        parts.append((0, new))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (rank, x), (_, y) = parts.pop(), parts.pop()
            parts.append((rank + 1, kept(x.union(y).coalesce(max(1, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))))))
    return kept(reached())


def deletion(samples: DataFrame, edges: DataFrame, requested: DataFrame, tenant: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """(samples that stay, nodes to revoke). A request only reaches samples of its own tenant."""
    gone = samples.join(requested, [tenant, "sample_id"], "left_semi")
    stay = samples.join(requested, [tenant, "sample_id"], "left_anti")
    return stay, descendants(edges, gone.select(F.col("sample_id").alias("node")))


def upload_outcome(now: int) -> Column:
    """What an upload attempt leads to, from columns refusal, cap, archive_present, acked, accepted, state, retriable, attempts."""
    from vellum.functions.numbers import retry_delay

    late = F.col("acked") & (F.col("state") == "deleted")
    delay = retry_delay(F.col("attempts"), F.col("retriable"))
    return (
        F.when(F.col("refusal").isNotNull(), "cancelled").when(F.col("cap").isNotNull(), "deferred").when(~F.col("archive_present"), "rejected")
        .when(late, "deletion_requested").when(F.col("acked") & F.col("accepted"), "acknowledged").when(F.col("acked"), "rejected").when(delay.isNotNull(), "retry").otherwise("gave_up")
    )


def over_cap(asks: DataFrame) -> DataFrame:
    """The requests (tenant_id, at, key, bytes, n, b, max_samples, max_bytes) that their tenant's caps refuse, read in order of (at, key).

    n and b are what the tenant had before. What is refused takes up nothing, so each answer hangs on those
    before it; a task keeps two numbers for the tenant that it reads.
    """
    parts = max(1, int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, n, b = None, 0, 0
        for frame in frames:
            refused = []
            for who, size, had_n, had_b, most_n, most_b in zip(*(frame[c] for c in ("tenant_id", "bytes", "n", "b", "max_samples", "max_bytes")), strict=True):
                if who != tenant:
                    tenant, n, b = who, had_n, had_b
                no = n >= most_n or b + size > most_b
                refused.append(no)
                if not no:
                    n, b = n + 1, b + size
            yield frame[refused]

    return asks.repartition(parts, "tenant_id").sortWithinPartitions("tenant_id", "at", "key").mapInPandas(fold, asks.schema)


def paused(consents: DataFrame, requests: DataFrame) -> DataFrame:
    """``consents`` after requests (consent_id, pause), one each, to pause or go on; those revoked stay as they are."""
    r = requests.select("consent_id", F.col("pause").alias("__pause"))
    return consents.join(r, "consent_id", "left").withColumn("paused", F.when(F.col("revoked_at").isNull(), F.coalesce("__pause", "paused")).otherwise(F.col("paused"))).drop("__pause")


def withdrawn(consents: DataFrame, jobs: DataFrame, samples: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consents, jobs, samples to delete) after withdrawals (tenant_id, consent_id): the first one's time stands, open jobs under the consent end, its samples go."""
    key = ["tenant_id", "consent_id"]
    asked = requests.select(*key).distinct().withColumn("__asked", F.lit(True))
    marked = consents.join(asked, key, "left").withColumn("withdrawn_at", F.when(F.col("__asked"), F.coalesce("withdrawn_at", F.lit(now))).otherwise(F.col("withdrawn_at"))).drop("__asked")
    open_ = F.coalesce("__asked", F.lit(False)) & ~F.col("state").isin(*TERMINAL)
    ended = jobs.join(asked, key, "left").withColumns({"reason": F.when(open_, "consent_withdrawn").otherwise(F.col("reason")), "state": F.when(open_, "deleted").otherwise(F.col("state"))}).drop("__asked")
    return marked, ended, samples.join(asked, key, "left_semi")


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, state, reason, finished_at): a job is finished once, by its first result (job_id, state, reason, at)."""
    first = first_wins(results.select("job_id", "at", F.col("state").alias("__s"), F.col("reason").alias("__r")), ["job_id"], ["at", "__s", "__r"]).drop("duplicates")
    free = F.col("finished_at").isNull() & F.col("at").isNotNull()
    take = lambda new, old: F.when(free, F.col(new)).otherwise(F.col(old)).alias(old)
    return jobs.join(first, "job_id", "left").select("job_id", take("__s", "state"), take("__r", "reason"), take("at", "finished_at"))


def installs(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, active, previous) after installs and rollbacks (kind, artifact) in order: a rollback goes back one step, and a second one before the next install leaves nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    put = F.col("kind") == "install"
    rows = events.withColumn("__n", F.sum(put.cast("int")).over(w))
    # Of each install, how many rollbacks follow before the next.
    each = rows.groupBy(key, "__n").agg(F.max(F.when(put, F.col("artifact"))).alias("artifact"), F.sum((~put).cast("int")).alias("__back")).where("__n > 0")
    # One rollback leaves what was active before, so what is active comes from the last install without exactly one.
    plain = F.when(F.col("__back") != 1, F.struct("__n", F.col("artifact").cast("string").alias("artifact"), "__back"))
    ends = each.groupBy(key).agg(F.max(F.struct("__n", "__back")).alias("l"), F.max(plain).alias("p"))
    before = each.join(ends.select(F.col(key).alias("__k"), F.col("l.__n").alias("__last")), F.col(key).eqNullSafe(F.col("__k"))).where("__n < __last").groupBy("__k").agg(F.max(plain).alias("q"))
    shown = lambda x: F.when(F.col(f"{x}.__back") == 0, F.col(f"{x}.artifact"))
    out = ends.join(before, F.col(key).eqNullSafe(F.col("__k")), "left")
    return out.select(key, shown("p").alias("active"), F.when(F.col("l.__back") == 0, shown("q")).alias("previous"))


def delivery_reason(installed: str, budget: int, form: str) -> Column:
    """Why a delivered model isn't taken, from columns signed (checked elsewhere), base, format, memory, accepted, sha256, version."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    return first_reason([
        ("bad_signature", bad(~F.col("signed"))), ("incompatible_base", bad(F.col("base") != installed)), ("unsupported_format", bad(F.col("format") != form)), ("exceeds_device_budget", bad(F.col("memory") > budget)),
        ("evaluation_not_accepted", bad(~F.col("accepted"))), ("malformed_manifest", bad((F.length("sha256") != 64) | ~F.col("version").rlike(r"\A[A-Za-z0-9-]{1,64}\z"))),
    ])


def lineage_added(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with new ones (node, kind, parents); a node or edge that is there stays as it is, of equal new nodes the least kind counts."""
    fresh = absent(new.groupBy("node").agg(F.min("kind").alias("kind")), nodes, ["node"])
    links = new.select(F.explode("parents").alias("parent"), F.col("node").alias("child")).distinct()
    return nodes.select("node", "kind").union(fresh), edges.select("parent", "child").union(absent(links, edges, ["parent", "child"]))


def routed(requests: DataFrame) -> DataFrame:
    """Deletion requests (scope, ...) with ``route`` and ``target``: all, a sample, a receipt, or unknown."""
    kind, rest = F.substring_index("scope", ":", 1), F.when(F.instr("scope", ":") > 0, F.expr("substring(scope, instr(scope, ':') + 1)"))
    known = kind.isin("sample", "receipt") & (rest != "")
    return requests.withColumns({"route": F.when(F.col("scope") == "everything", "everything").when(F.coalesce(known, F.lit(False)), kind).otherwise("unknown"), "target": F.when(F.coalesce(known, F.lit(False)), rest)})


def oldest_pending(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pending job that has waited longest, of all or for each key."""
    rest = [c for c in jobs.columns if c not in ("created_at", "job_id", *by)]
    picked = jobs.where("state = 'local_pending'").groupBy(*by).agg(F.min(F.struct("created_at", "job_id", *rest)).alias("j")).where("j IS NOT NULL")
    return picked.select(*by, "j.*")


def token_hash(token: Column, domain: str = "token") -> Column:
    """SHA-256 of the token after its domain and a NUL."""
    return F.sha2(F.concat(F.lit(domain), F.char(F.lit(0)), token), 256)


def authenticated(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests (token, ...) with the tenant that has the token's hash and isn't disabled."""
    known = tenants.where("NOT disabled").select("tenant_id", F.col("token_hash").alias("__hash"))
    return requests.join(known, token_hash(F.col("token")) == F.col("__hash")).drop("__hash", "token")


def admissions(requests: DataFrame, receipts: DataFrame, consents: DataFrame, tombstones: DataFrame, samples: DataFrame, limits: DataFrame, now: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(tenant_id, key, sample_id, accepted, reason, duplicate) for each request of a batch.

    ``requests``: tenant_id, key, at, declared_sha256, archive_sha256, bytes, package_reason, sample_id,
    consent_id. A key answered before (in ``receipts``: tenant_id, key, accepted, reason) gets that answer
    again; of equal keys in the batch the first counts, and of equal samples the first. ``limits`` has
    tenant_id, max_samples, max_bytes, held against what the tenant had before the batch and what was
    accepted earlier in it, in order of (at, key); a refused request takes up nothing. Tenants whose requests
    fit all together need no order; the others' are read once in order, a few numbers a row.
    """
    from vellum.functions.text import IDEMPOTENCY_KEY
    from vellum.operators.storage import kept

    flag = lambda df, key, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    active = consents.where(F.col("withdrawn_at").isNull() & (F.col("expires_at") > now))
    used = usage(samples, "tenant_id", "bytes").select("tenant_id", F.col("samples").alias("__n"), F.col("total").alias("__b"))
    old = receipts.select("tenant_id", "key", F.col("accepted").alias("__accepted"), F.col("reason").alias("__reason"), F.lit(True).alias("__old"))
    first = requests.groupBy("tenant_id", "key").agg(F.min("at").alias("__first"))
    rows = (
        requests.join(old, ["tenant_id", "key"], "left").join(first, ["tenant_id", "key"], "left").join(flag(active, ["tenant_id", "consent_id"], "__consent"), ["tenant_id", "consent_id"], "left")
        .join(flag(tombstones, ["sample_id"], "__gone"), "sample_id", "left").join(flag(samples, ["sample_id"], "__there"), "sample_id", "left").join(limits, "tenant_id", "left").join(used, "tenant_id", "left")
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    refusal = first_reason([
        ("invalid_idempotency_key", ~F.coalesce(F.col("key").rlike(IDEMPOTENCY_KEY), F.lit(False))), ("package_too_large", F.col("bytes") > most_bytes), ("declared_checksum_mismatch", F.coalesce(F.col("declared_sha256") != F.col("archive_sha256"), F.lit(True))),
    ])
    package = F.when(F.col("package_reason").isNotNull(), F.concat(F.lit("invalid_package:"), "package_reason"))
    stored = first_reason([
        ("consent_not_active", F.col("__consent").isNull()), ("sample_previously_deleted", F.col("__gone").isNotNull()), ("sample_id_conflict", F.col("__there").isNotNull()),
    ])
    rows = rows.withColumn("__why", F.coalesce(refusal, package, stored)).withColumn("__again", F.coalesce(F.col("at") != F.col("__first"), F.lit(False)))
    fresh = F.col("__why").isNull() & ~F.col("__again") & F.col("__old").isNull()
    mine = rows.where(fresh).groupBy("sample_id").agg(F.min(F.struct("at", "tenant_id", "key")).alias("__m")).select(F.col("sample_id").alias("__s"), "__m")
    rows = rows.join(mine, rows["sample_id"] == mine["__s"], "left")
    conflict = fresh & (F.struct("at", "tenant_id", "key") != F.col("__m"))
    rows = kept(rows.withColumn("__own", F.when(conflict, "sample_id_conflict").otherwise(F.col("__why"))).withColumn("__open", fresh & ~conflict).drop("__m", "__s"))
    asks = rows.where(F.col("__open") & F.col("max_samples").isNotNull()).select("tenant_id", "at", "key", F.col("bytes").cast("long").alias("bytes"), none("__n").cast("long").alias("n"), none("__b").cast("long").alias("b"), F.col("max_samples").cast("long").alias("max_samples"), F.col("max_bytes").cast("long").alias("max_bytes"))
    sums = asks.groupBy("tenant_id").agg((F.max("n") + F.count("*") > F.max("max_samples")).alias("__many"), (F.max("b") + F.sum("bytes") > F.max("max_bytes")).alias("__large"))
    tight = asks.join(sums.where("__many OR __large").select("tenant_id"), "tenant_id", "left_semi")
    over = over_cap(tight).select("tenant_id", "key", F.lit(True).alias("__over"))
    rows = rows.join(over, ["tenant_id", "key"], "left")
    own = F.when(F.col("__open") & F.col("__over"), "tenant_storage_cap_reached").otherwise(F.col("__own"))
    answers = rows.select("tenant_id", "key", "at", "sample_id", "__old", "__again", F.when(F.col("__old"), F.col("__reason")).otherwise(own).alias("reason"), F.when(F.col("__old"), F.col("__accepted")).otherwise(own.isNull()).alias("accepted"))
    heads = answers.where("NOT __again").select("tenant_id", "key", F.col("reason").alias("__r"), F.col("accepted").alias("__a"))
    out = answers.join(heads, ["tenant_id", "key"], "left")
    return out.select("tenant_id", "key", "at", "sample_id", F.when(F.col("__again"), F.col("__a")).otherwise(F.col("accepted")).alias("accepted"), F.when(F.col("__again"), F.col("__r")).otherwise(F.col("reason")).alias("reason"), (F.col("__again") | F.coalesce("__old", F.lit(False))).alias("duplicate"))


#: The scope that each kind of event needs.
EVENT_SCOPES = {
    "session.started": "status:read", "transcript.partial": "transcript:live", "transcript.final": "transcript:final", "session.stopped": "status:read", "session.cancelled": "status:read", "error": "status:read",
}


def permitted(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Events (kind, ...) that each client (client_id, scopes, wanted or null) may see: its scopes cover the kind, and it asked for it."""
    scopes = F.create_map(*(F.lit(x) for kv in EVENT_SCOPES.items() for x in kv))
    kinds = clients.select("client_id", F.explode(F.filter(F.map_keys(scopes), lambda k: F.array_contains("scopes", scopes[k]) & (F.col("wanted").isNull() | F.array_contains("wanted", k)))).alias("kind"))
    return events.join(kinds, "kind")


def pending_deletions(requests: DataFrame) -> DataFrame:
    """Requests for deletion that nothing has completed."""
    return requests.where("completed_at IS NULL")


def completed_deletions(requests: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """``requests`` with those of ``done`` (request_id) completed now; what wasn't sent before counts as sent now."""
    marked = requests.join(done.select("request_id").distinct().withColumn("__done", F.lit(True)), "request_id", "left")
    at = F.when(F.col("__done"), F.lit(now).cast("long"))
    return marked.withColumns({"completed_at": F.coalesce(at, "completed_at"), "sent_at": F.coalesce("sent_at", at)}).drop("__done")


def node_kinds(nodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(node, kind) of the nodes that the lineage knows."""
    return nodes.select("node").distinct().join(lineage.select("node", "kind"), "node")


def unexpired(rows: DataFrame, now: int) -> DataFrame:
    """What a cleanup leaves; rows without an expiry stay."""
    return rows.where(F.coalesce(F.col("expires_at") > now, F.lit(True)))


def cleanup_report(scopes: DataFrame, metadata: DataFrame, now: int) -> DataFrame:
    """One row (expired_scopes, expired_metadata): how many rows a cleanup takes."""
    both = scopes.select("expires_at", F.lit(1).alias("s")).unionAll(metadata.select("expires_at", F.lit(0).alias("s"))).where(F.col("expires_at") <= now)
    return both.agg(F.count_if(F.col("s") == 1).alias("expired_scopes"), F.count_if(F.col("s") == 0).alias("expired_metadata"))


def api_clients(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests (token, ...) with the client that has the token's hash and isn't revoked."""
    known = clients.where("revoked_at IS NULL").select("client_id", F.col("token_hash").alias("__hash"))
    return requests.join(known, token_hash(F.col("token")) == F.col("__hash")).drop("__hash", "token")


def last_used(clients: DataFrame, answered: DataFrame) -> DataFrame:
    """``clients`` with the time of their last answered request (client_id, at). Requests are reduced before the join: a client may have most of them."""
    last = answered.groupBy("client_id").agg(F.max("at").alias("__at"))
    return clients.join(last, "client_id", "left").withColumn("last_used_at", F.coalesce("__at", "last_used_at")).drop("__at")


def grant_refusal(consent_id: Column, purposes: Column) -> Column:
    """Why a server doesn't take a grant: another purpose, or an id of more than 128 bytes. No purpose at all is taken."""
    return F.when(F.exists(purposes, lambda p: ~p.eqNullSafe(PURPOSE)) | (F.octet_length(consent_id) > 128), "purpose_not_grantable")


def recordable(metadata_id: Column, state: Column, reason: Column) -> Column:
    """Whether metadata holds tokens alone and so no content. A null reason is none; a null id or state isn't recordable."""
    ok = lambda c, most: c.rlike(T.METADATA) & (F.length(c) <= most)
    return F.coalesce(ok(metadata_id, 128), F.lit(False)) & F.coalesce(ok(state, 64), F.lit(False)) & F.coalesce(ok(reason, 64), reason.isNull())


def outcome_record(outcome: Column, version: Column, reason: Column, evaluation: Column) -> Column:
    """A training outcome as JSON; a cancelled one has no more fields, an unknown one is null."""
    record = lambda *fields: F.to_json(F.struct(outcome.alias("outcome"), *fields), {"ignoreNullFields": "false"})
    full = evaluation.alias("evaluation")
    return F.when(outcome == "delivered", record(version.alias("model_version"), full)).when(outcome == "kept_base_model", record(reason.alias("reason"), full)).when(outcome == "cancelled", record())


def artifact_reason(content: Column, size: Column, sha256: Column) -> Column:
    """Whether a file (as ``binaryFile`` reads it) is what its specification says: the size first, then the digest."""
    return first_reason([("size_mismatch", F.octet_length(content) != size), ("checksum_mismatch", F.sha2(content, 256) != sha256)])


def pending(state: Column) -> Column:
    """Whether a job still has work to do."""
    return ~state.isin(*TERMINAL)


def live_delivery(deliveries: DataFrame, revoked: DataFrame) -> DataFrame:
    """(tenant_id, version, created_at): each tenant's latest delivery that isn't revoked (version); of equal times the greatest version."""
    live = deliveries.join(revoked.select("version").distinct(), "version", "left_anti")
    return last_wins(live.select("tenant_id", "created_at", "version"), ["tenant_id"], ["created_at", "version"]).select("tenant_id", "version", "created_at")


def consents_by_age(consents: DataFrame, tenant: str) -> DataFrame:
    """(tenant, consent_id, place, current): newest first; the newest that isn't revoked is the current one."""
    newest = Window.partitionBy(tenant).orderBy(F.col("granted_at").desc(), F.col("consent_id").desc())
    rows = consents.withColumn("place", F.row_number().over(newest).cast("long"))
    open_ = F.min(F.when(F.col("revoked_at").isNull(), F.col("place"))).over(Window.partitionBy(tenant))
    return rows.select(tenant, "consent_id", "place", F.coalesce(F.col("place") == open_, F.lit(False)).alias("current"))


def jobs_in(jobs: DataFrame, states: Sequence[str]) -> DataFrame:
    """Jobs in one of the states, oldest first; equal times by id."""
    return jobs.where(F.col("state").isin(*states)).orderBy("created_at", "job_id")


def rescheduled(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """``jobs`` with a new attempt's time (job_id, at) where they are still eligible; of several the latest counts. ``done`` tells which were."""
    new = asked.groupBy("job_id").agg(F.max("at").alias("__at"))
    ok = F.col("__at").isNotNull() & (F.col("state") == "eligible")
    return jobs.join(new, "job_id", "left").withColumns({"next_attempt_at": F.when(ok, F.col("__at")).otherwise(F.col("next_attempt_at")), "done": F.when(F.col("__at").isNotNull(), F.col("state") == "eligible")}).drop("__at")


def late_deletions(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(request_id, job_id, scope): what the server has to delete since its receipt (job_id, receipt_id, accepted) came after the job was deleted."""
    late = receipts.where("accepted").join(jobs.where("state = 'deleted'").select("job_id"), "job_id", "left_semi")
    scope = F.concat(F.lit("receipt:"), "receipt_id")
    return late.select(F.concat(F.lit("delete-"), "receipt_id").alias("request_id"), "job_id", scope.alias("scope")).dropDuplicates(["request_id"])


def ended_uploads(jobs: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, scopes to drop) after uploads were cancelled or refused (job_id, kind cancel or reject, reason): the package of each goes.

    A job that has ended stays as it is; a cancel counts before a refusal.
    """
    asked = ends.groupBy("job_id").agg(F.min(F.struct("kind", "reason")).alias("__e"))
    rows = jobs.join(asked, "job_id", "left").withColumn("__go", F.col("__e").isNotNull() & pending(F.col("state")))
    state = F.when(F.col("__go"), F.when(F.col("__e.kind") == "cancel", "deleted").otherwise("rejected")).otherwise(F.col("state"))
    reason = F.when(F.col("__go"), F.col("__e.reason")).otherwise(F.col("reason"))
    scopes = rows.where("__go").select(F.concat(F.lit("package:"), F.col("job_id").cast("string")).alias("scope"))
    return rows.withColumns({"state": state, "reason": reason}).drop("__e", "__go"), scopes


def final_events(transcripts: DataFrame) -> DataFrame:
    """``transcripts`` (session, seq, end_ms, text) with ``event``: the JSON that clients get once a transcript is final; what is null is left out."""
    event = F.struct(F.lit(1).alias("version"), F.lit("transcript.final").alias("kind"), "session", "seq", F.lit(0).cast("long").alias("start_ms"), "end_ms", "text", F.lit(True).alias("is_final"))
    return transcripts.withColumn("event", F.to_json(event))


def scopes_text(scopes: Column) -> Column:
    """Scopes as they are stored: a comma list."""
    return F.array_join(scopes, ",")


def clients_by_age(clients: DataFrame) -> DataFrame:
    """Clients (client_id, created_at, ...), oldest first; equal times by id."""
    return clients.orderBy("created_at", "client_id")


def sequence_gaps(rows: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """(key, after, missing): where numbers are missing in a sequence; repeated ones count once. A client that finds a gap asks anew."""
    w = Window.partitionBy(*key).orderBy(seq)
    each = rows.select(*key, seq).distinct().withColumn("__before", F.lag(seq).over(w))
    return each.where(F.col(seq) > F.col("__before") + 1).select(*key, F.col("__before").alias("after"), (F.col(seq) - F.col("__before") - 1).alias("missing"))


def span_reason(start: Column, stop: Column) -> Column:
    """Why a span of words can't be: no words, or turned round."""
    return first_reason([("span_missing", start.isNull() | stop.isNull()), ("span_inverted", stop < start), ("span_empty", stop == start)])


def deleted_tenant(samples: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(tenant_id, samples, artifacts): what goes when tenants are deleted with all they have."""
    a = samples.groupBy("tenant_id").agg(F.count("*").alias("samples"))
    b = deliveries.groupBy("tenant_id").agg(F.count("*").alias("artifacts"))
    return a.join(b, "tenant_id", "full_outer").na.fill(0, ["samples", "artifacts"])
