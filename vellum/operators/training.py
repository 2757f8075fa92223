"""A tenant's personalised training as joins: who has enough usable samples, how they are split, what came of each run and why.

What runs outside - the trainer, the quantizer, the measuring of word errors - comes as a table of runs;
this module decides. Tables: samples (tenant_id, sample_id, consent_id, received_at, readable), consents
(tenant_id, consent_id, version, purposes as a comma list, expires_at, withdrawn_at), jobs (tenant_id,
job_id), runs (job_id, cancelled, trained_status, model_present, quantizer_started, quantizer_status, header
of the quantized model, over_cap, regression_present, four word error rates, failure of measuring, peak_mib).

Defined cases: a job without a run is pending; a null status counts as not ended; a null rate can't be
measured (``measurement_failed``); repeated jobs count once; samples without a consent are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.numbers import held_out_size
from vellum.operators.control import PURPOSE, accepted, first_reason

#: The first four bytes of a model file as a little-endian number, the kind q5_1, what kinds are counted modulo.
MAGIC, Q5_1, KINDS = 0x67676D6C, 9, 1000


def little_endian(body: Column, at: int) -> Column:
    """The signed 32-bit number at a byte, null beyond the end."""
    part = lambda k: F.conv(F.hex(F.substring(body, at + k + 1, 1)), 16, 10).cast("long")
    value = part(0) + part(1) * 256 + part(2) * 65_536 + part(3) * 16_777_216
    return F.when(F.octet_length(body) >= at + 4, F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value))


def quantized(header: Column) -> Column:
    """Whether a model file's first 48 bytes are those of a q5_1 model."""
    whole = F.octet_length(header) >= 48
    return F.coalesce(whole & (little_endian(header, 0) == MAGIC) & (F.pmod(little_endian(header, 44), F.lit(KINDS)) == Q5_1), F.lit(False))


def usable_consents(consents: DataFrame, now: Column | int, version: str) -> DataFrame:
    """(tenant_id, consent_id) of consents of this version, for this purpose, neither expired nor withdrawn."""
    granted = F.array_contains(F.split(F.coalesce("purposes", F.lit("")), ","), PURPOSE)
    return consents.where((F.col("version") == version) & granted & (F.col("expires_at") > now) & F.col("withdrawn_at").isNull()).select("tenant_id", "consent_id").distinct()


def usable_samples(samples: DataFrame, consents: DataFrame, now: int, version: str) -> DataFrame:
    return samples.join(usable_consents(consents, now, version), ["tenant_id", "consent_id"], "left_semi")


def run_reason(improvement: float, ceiling: float, budget: int) -> tuple[Column, Column]:
    """(cancelled, why the base model stays) of a run, the stages in order: the first that fails gives the reason."""
    c = F.col
    rates = ("heldout_base", "heldout_candidate", "regression_base", "regression_candidate")
    unmeasured = c(rates[0]).isNull() | c(rates[1]).isNull() | c(rates[2]).isNull() | c(rates[3]).isNull()
    better = accepted(*(c(r) for r in (rates[0], rates[1], rates[2], rates[3])), improvement, ceiling)
    return F.coalesce(c("cancelled"), F.lit(False)), F.coalesce(
        first_reason([
            ("compute_cap_exceeded", c("over_cap") | c("trained_status").isNull()), ("trainer_failed", c("trained_status") != 0), ("trainer_produced_no_model", ~F.coalesce(c("model_present"), F.lit(False))),
            ("quantizer_unavailable", ~F.coalesce(c("quantizer_started"), F.lit(False))), ("compute_cap_exceeded", c("quantizer_status").isNull()), ("quantizer_failed", c("quantizer_status") != 0), ("quantizer_produced_invalid_model", ~quantized(c("header"))),
            ("regression_set_missing", ~F.coalesce(c("regression_present"), F.lit(False))),
        ]), c("failure"),
        first_reason([("measurement_failed", unmeasured), ("no_measured_improvement", ~better), ("exceeds_device_budget", F.coalesce(c("peak_mib"), F.lit(budget + 1)) > budget)]),
    )


def outcomes(jobs: DataFrame, samples: DataFrame, consents: DataFrame, runs: DataFrame, now: int, later: int, version: str, least_train: int = 50, least_held: int = 30, fraction: float = 0.2, improvement: float = 0.01, ceiling: float = 0.005, budget: int = 1024) -> DataFrame:
    """(tenant_id, job_id, state, reason, train, held_out): each job once.

    Consent is looked at before (``now``) and once more after training (``later``): with fewer usable samples
    then, the job is cancelled. Of the usable samples the last ``held_out`` by time are held out.
    """
    started = usable_samples(samples, consents, now, version).groupBy("tenant_id").agg(F.count("*").alias("n"), F.min(F.coalesce("readable", F.lit(False))).alias("readable"))
    ended = usable_samples(samples, consents, later, version).groupBy("tenant_id").agg(F.count("*").alias("n_later"))
    rows = jobs.select("tenant_id", "job_id").distinct().join(started, "tenant_id", "left").join(ended, "tenant_id", "left").join(runs.withColumn("__run", F.lit(True)), "job_id", "left")
    n, n_later = F.coalesce("n", F.lit(0)), F.coalesce("n_later", F.lit(0))
    held = held_out_size(n, fraction, least_held)
    enough = n >= least_train + least_held
    cancelled, kept = run_reason(improvement, ceiling, budget)
    early = first_reason([("insufficient_data", ~enough), ("stored_sample_unreadable", ~F.col("readable"))])
    changed = n_later < n
    state = (
        F.when(early.isNotNull(), "kept_base_model").when(F.col("__run").isNull(), "pending").when(cancelled, "cancelled").when(kept.isNotNull(), "kept_base_model").when(changed, "cancelled").otherwise("delivered")
    )
    reason = F.when(early.isNotNull(), early).when(F.col("__run").isNull() | cancelled, None).when(kept.isNotNull(), kept).when(changed, "consent_changed_during_training")
    return rows.select("tenant_id", "job_id", state.alias("state"), reason.alias("reason"), F.when(enough, n - held).otherwise(0).alias("train"), F.when(enough, held).otherwise(0).alias("held_out"))


def lineage(done: DataFrame, samples: DataFrame, consents: DataFrame, now: int, version: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, kind; edges: parent, child) that the outcomes add: samples to dataset to job, and build and delivery of what was delivered."""
    begun = done.where("train > 0").select("tenant_id", "job_id", "state", F.concat(F.lit("dataset-"), "job_id").alias("dataset"), F.concat(F.lit("build-"), "job_id").alias("build"), F.concat(F.lit("model-"), "job_id").alias("model"))
    out = begun.where("state = 'delivered'")
    pick = lambda rows, a, b: rows.select(F.col(a).alias("parent"), F.col(b).alias("child"))
    used = usable_samples(samples, consents, now, version).select("tenant_id", "sample_id").join(begun.select("tenant_id", "dataset"), "tenant_id")
    edges = pick(used, "sample_id", "dataset").union(pick(begun, "dataset", "job_id")).union(pick(out, "job_id", "build")).union(pick(out, "build", "model"))
    kinds = (("dataset", "dataset", begun), ("job", "job_id", begun), ("build", "build", out), ("delivery", "model", out))
    nodes = [rows.select(F.col(c).alias("node"), F.lit(k).alias("kind")) for k, c, rows in kinds]
    return nodes[0].union(nodes[1]).union(nodes[2]).union(nodes[3]), edges
