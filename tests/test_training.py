"""A tenant's training: every reason in its order, the split, and the lineage it adds."""

from vellum.operators import training

MODEL = bytes.fromhex("6C6D6767") + bytes(40) + (9 + 2000).to_bytes(4, "little")
RUN = {
    "job_id": "j", "cancelled": False, "trained_status": 0, "model_present": True, "quantizer_started": True, "quantizer_status": 0, "header": MODEL, "over_cap": False, "regression_present": True, "failure": None,
    "heldout_base": 0.4, "heldout_candidate": 0.3, "regression_base": 0.1, "regression_candidate": 0.1, "peak_mib": 100,
}
SCHEMA = "job_id string, cancelled boolean, trained_status int, model_present boolean, quantizer_started boolean, quantizer_status int, header binary, over_cap boolean, regression_present boolean, failure string, heldout_base double, heldout_candidate double, regression_base double, regression_candidate double, peak_mib int"
CASES = {
    "delivered": {}, "cancelled": {"cancelled": True, "trained_status": 1}, "cap": {"over_cap": True, "trained_status": 1}, "endless": {"trained_status": None}, "trainer": {"trained_status": 1, "model_present": False}, "no_model": {"model_present": False, "quantizer_started": False},
    "no_quantizer": {"quantizer_started": False, "quantizer_status": 1}, "quantizing": {"quantizer_status": None}, "quantizer": {"quantizer_status": 3, "header": b""}, "short": {"header": MODEL[:47]}, "kind": {"header": MODEL[:44] + (8).to_bytes(4, "little"), "regression_present": False}, "magic": {"header": bytes(44) + MODEL[44:]},
    "null_model": {"header": None}, "no_set": {"regression_present": False, "failure": "x"}, "worker": {"failure": "worker_died", "heldout_base": None}, "rates": {"regression_base": None}, "worse": {"heldout_candidate": 0.395, "peak_mib": 9999}, "regressed": {"regression_candidate": 0.11}, "memory": {"peak_mib": 1025}, "unmeasured_memory": {"peak_mib": None},
}
REASONS = {
    "cap": "compute_cap_exceeded", "endless": "compute_cap_exceeded", "trainer": "trainer_failed", "no_model": "trainer_produced_no_model", "no_quantizer": "quantizer_unavailable", "quantizing": "compute_cap_exceeded", "quantizer": "quantizer_failed", "short": "quantizer_produced_invalid_model",
    "kind": "quantizer_produced_invalid_model", "magic": "quantizer_produced_invalid_model", "null_model": "quantizer_produced_invalid_model", "no_set": "regression_set_missing", "worker": "worker_died", "rates": "measurement_failed", "worse": "no_measured_improvement", "regressed": "no_measured_improvement",
    "memory": "exceeds_device_budget", "unmeasured_memory": "exceeds_device_budget",
}


def test_outcomes(spark):
    tenants = [*CASES, "few", "unreadable", "changed", "waiting", "withdrawn", "version", "purpose", "expired"]
    samples = [(t, f"{t}{k}", "c" if t != "changed" or k else "d", k, t != "unreadable" or k != 3) for t in tenants for k in range(11 if t != "few" else 4)] + [("nobody", "x", None, 1, True)]
    consents = [(t, "c", "v1" if t == "version" else "v2", "other" if t == "purpose" else "other,customer_personalization", 5 if t == "expired" else 100, 7 if t == "withdrawn" else None) for t in tenants] + [("changed", "d", "v2", "customer_personalization", 15, None)]
    runs = [tuple((RUN | {"job_id": f"job-{t}"} | CASES.get(t, {})).values()) for t in tenants if t != "waiting"]
    jobs = [(t, f"job-{t}") for t in tenants] * 2 + [("empty", "job-empty")]
    s = spark.createDataFrame(samples, "tenant_id string, sample_id string, consent_id string, received_at long, readable boolean")
    c = spark.createDataFrame(consents, "tenant_id string, consent_id string, version string, purposes string, expires_at long, withdrawn_at long")
    done = training.outcomes(spark.createDataFrame(jobs, "tenant_id string, job_id string"), s, c, spark.createDataFrame(runs, SCHEMA), 10, 20, "v2", least_train=3, least_held=2).cache()
    got = {r["tenant_id"]: (r["state"], r["reason"], r["train"], r["held_out"]) for r in done.collect()}
    assert len(got) == done.count() == len(tenants) + 1
    for t in CASES:
        assert got[t] == ("delivered" if t == "delivered" else "cancelled" if t == "cancelled" else "kept_base_model", REASONS.get(t), 8, 3)
    assert got["changed"] == ("cancelled", "consent_changed_during_training", 8, 3) and got["waiting"] == ("pending", None, 8, 3)
    assert got["unreadable"][:2] == ("kept_base_model", "stored_sample_unreadable")
    assert all(got[t] == ("kept_base_model", "insufficient_data", 0, 0) for t in ("few", "withdrawn", "version", "purpose", "expired", "empty"))
    nodes, edges = training.lineage(done.where("tenant_id IN ('delivered', 'worse', 'few')"), s, c, 10, "v2")
    assert {tuple(r) for r in nodes.collect()} == {("dataset-job-delivered", "dataset"), ("dataset-job-worse", "dataset"), ("job-delivered", "job"), ("job-worse", "job"), ("build-job-delivered", "build"), ("model-job-delivered", "delivery")}
    assert {tuple(r) for r in edges.collect()} == {*((f"{t}{k}", f"dataset-job-{t}") for t in ("delivered", "worse") for k in range(11)), *((f"dataset-job-{t}", f"job-{t}") for t in ("delivered", "worse")), ("job-delivered", "build-job-delivered"), ("build-job-delivered", "model-job-delivered")}
