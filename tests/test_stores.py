"""Stored sessions as a source, several tables written as one, and another sample rate across chunks."""

import json
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import resample, splice
from vellum.sources import sessions
from vellum.streaming import ledger as ledgers

WORD = {"id": 0, "text": "hei", "display": "Hei,", "start": 0, "end": 9, "confidence": 0.5, "unreliable": False}


def session(name, samples=(1, -2, 32_767, -32_768), words=(WORD,)):
    return {"session_id": name, "started_at": 7, "language": "fi", "sample_rate": 16_000, "total_samples": 9, "asr_model": "m", "asr_model_revision": "r", "words": [dict(w) for w in words], "samples": list(samples)}


def test_round_trip_and_what_cannot_be_read(spark):
    spark.dataSource.register(sessions.StoredSessions)
    folder = tempfile.mkdtemp(prefix="spark-")
    whole = [session("a"), session("ä b/c", ()), session("many", range(-500, 500), [WORD, WORD | {"id": 4, "text": ""}])]
    frame = spark.createDataFrame([{"name": "", "valid": True} | s for s in whole], sessions.SCHEMA)
    frame.write.format("stored_sessions").mode("append").save(folder)
    frame.write.format("stored_sessions").mode("append").save(folder)  # again: nothing twice
    bad = {
        "odd": (json.dumps({k: v for k, v in session("odd").items() if k != "samples"}), b"abc"), "no_audio": (json.dumps({k: v for k, v in session("x").items() if k != "samples"}), None), "no_json": ("{", b""), "list": ("[]", b""),
        "turned": (json.dumps({k: v for k, v in session("t", words=[WORD | {"start": 10}]).items() if k != "samples"}), b""), "sure": (json.dumps({k: v for k, v in session("t", words=[WORD | {"confidence": 1.5}]).items() if k != "samples"}), b""),
        "same_id": (json.dumps({k: v for k, v in session("t", words=[WORD, WORD]).items() if k != "samples"}), b""), "true": (json.dumps({k: v for k, v in (session("t") | {"started_at": True}).items() if k != "samples"}), b""),
    }
    for name, (header, audio) in bad.items():
        open(f"{folder}/{name}.json", "w").write(header)
        if audio is not None:
            open(f"{folder}/{name}.pcm", "wb").write(audio)
    got = {r["name"]: r.asDict(recursive=True) for r in spark.read.format("stored_sessions").load(folder).collect()}
    assert len(got) == len(whole) + len(bad)
    for s in whole:
        r = got[s["session_id"].encode().hex()]
        assert r["valid"] and {k: r[k] for k in s} == s
    assert all(not got[n]["valid"] and all(v is None for k, v in got[n].items() if k not in ("name", "valid")) for n in bad)
    assert spark.read.format("stored_sessions").load(tempfile.mkdtemp(prefix="spark-")).count() == 0


def test_stream_goes_on_at_its_offset(spark):
    spark.dataSource.register(sessions.StoredSessions)
    folder, state, sink = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    for k in range(3):
        frame = spark.createDataFrame([{"name": "", "valid": True} | session(f"s{k}-{i}") for i in range(2)], sessions.SCHEMA)
        frame.write.format("stored_sessions").mode("append").save(folder)
        stream = spark.readStream.format("stored_sessions").load(folder).select("session_id", F.size("samples").alias("n"))
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(once=True).start()
        query.awaitTermination()
        assert sorted(r["session_id"] for r in spark.read.parquet(sink).collect()) == sorted(f"s{j}-{i}" for j in range(k + 1) for i in range(2))


def test_since(spark):
    row = spark.range(1).select(F.array(*map(F.lit, range(5))).alias("x")).select(*(resample.since(F.col("x"), n).alias(str(n)) for n in (-3, 0, 2, 5, 9)))
    assert [row.first()[str(n)] for n in (-3, 0, 2, 5, 9)] == [[0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [2, 3, 4], [], []]


@pytest.mark.parametrize(("source", "target"), [(48_000, 16_000), (44_100, 16_000), (8000, 16_000), (16_000, 16_000)])
def test_chunks_do_not_matter(spark, source, target):
    rng = random.Random(source)
    signal = [rng.randint(-32_768, 32_767) for _ in range(700)]
    weights = np.array(splice.low_pass_weights(source, target))
    padded = np.concatenate([np.zeros(62), signal])
    expected, count = [], 0
    for i in range(len(signal)):  # one sample at a time
        count += target
        while count >= source:
            x = float(padded[i : i + 63] @ weights)
            expected.append(signal[i] if source == target else int(np.clip(np.copysign(np.floor(abs(x) + 0.5), x), -32_768, 32_767)))
            count -= source
    for sizes in ([700], [1] * 50 + [650], [0, 63, 62, 1, 300, 0, 274]):
        at, rows = 0, []
        for k, n in enumerate(sizes):
            rows.append(("s", k, signal[at : at + n] or None))
            at += n
        frame = spark.createDataFrame([*rows, ("t", 1, [5, None]), (None, None, [1])], "session_id string, seq long, samples array<int>")
        got = [r for r in resample.resampled(frame, source, target).collect() if r["session_id"] == "s"]
        got.sort(key=lambda r: r["seq"])
        assert [x for r in got for x in r["samples"]] == expected
        assert [r["first"] for r in got] == [sum(sizes[:k]) * target // source for k in range(len(sizes))]


def test_chunks_of_a_stream(spark):
    signal = [(k * 7919) % 4001 - 2000 for k in range(400)]
    rows = [(s, k, signal[a : a + 50]) for k, a in enumerate(range(0, 400, 50)) for s in "ab"]
    schema = "session_id string, seq long, samples array<int>"
    source, state, sink = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    for k, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/p{k}")
        chunks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        resample.resampled_stream(chunks, 44_100, 16_000).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == sorted(map(tuple, resample.resampled(spark.createDataFrame(rows, schema), 44_100, 16_000).collect())) and len(got) == 16


REQUESTS = "tenant_id string, key string, at long, declared_sha256 string, archive_sha256 string, bytes long, package_reason string, sample_id string, consent_id string"


def request(k, tenant="t", **other):
    return tuple(({"tenant_id": tenant, "key": f"request-{k}", "at": k, "declared_sha256": "d", "archive_sha256": "d", "bytes": 10, "package_reason": None, "sample_id": f"sample-{k}", "consent_id": "c"} | other).values())


@pytest.fixture
def tables(spark):
    consents = spark.createDataFrame([("t", "c", None, 99)], "tenant_id string, consent_id string, withdrawn_at long, expires_at long")
    limits = spark.createDataFrame([("t", 4, 1000)], "tenant_id string, max_samples long, max_bytes long")
    return ledgers.Ledger(spark, tempfile.mkdtemp(prefix="spark-")), consents, limits


def state(ledger):
    return {name: sorted(map(tuple, ledger.table(name).collect()), key=repr) for name in ledgers.TABLES}


def test_a_batch_is_put_down_once_and_whole(spark, tables):
    ledger, consents, limits = tables
    first = spark.createDataFrame([request(1), request(2), request(2, at=3), request(4, declared_sha256="e"), request(5, consent_id="x")], REQUESTS)
    assert ledgers.admitted(ledger, 0, first, consents, limits, 10) == {"samples": 2, "receipts": 4, "nodes": 2}
    after = state(ledger)
    assert [r[:2] for r in after["samples"]] == [("t", "sample-1"), ("t", "sample-2")]
    assert {(r[1], r[3], r[4]) for r in after["receipts"]} == {("request-1", True, None), ("request-2", True, None), ("request-4", False, "declared_checksum_mismatch"), ("request-5", False, "consent_not_active")}
    # Played again, with other rows even: nothing changes and the counts are those of the first time.
    assert ledgers.admitted(ledger, 0, spark.createDataFrame([request(9)], REQUESTS), consents, limits, 11) == {"samples": 2, "receipts": 4, "nodes": 2}
    assert state(ledger) == after
    # A key answered in an earlier batch adds nothing; the caps count what is there.
    second = spark.createDataFrame([request(1), request(6), request(7), request(8)], REQUESTS)
    assert ledgers.admitted(ledger, 1, second, consents, limits, 12) == {"samples": 2, "receipts": 3, "nodes": 2}
    assert ("request-8", "tenant_storage_cap_reached") in {(r[1], r[4]) for r in state(ledger)["receipts"]}


def test_a_failure_between_tables_leaves_nothing(spark, tables):
    ledger, consents, limits = tables
    ledgers.admitted(ledger, 0, spark.createDataFrame([request(1)], REQUESTS), consents, limits, 10)
    before = state(ledger)
    good = spark.createDataFrame([("t", "sample-2", "c", "d", 1, 1)], ledgers.TABLES["samples"])
    broken = spark.range(1).select(F.lit("n").alias("node"), F.raise_error(F.lit("lost")).cast("string").alias("kind"), F.lit(1).cast("long").alias("created_at"))
    with pytest.raises(Exception, match="lost"):
        ledger.put(1, {"samples": good, "nodes": broken})
    assert state(ledger) == before
    assert ledger.put(1, {"samples": good, "nodes": broken.withColumn("kind", F.lit("sample"))}) == {"samples": 1, "nodes": 1}
    assert len(ledger.table("samples").collect()) == 2


def test_deletion_counts(spark, tables):
    ledger, consents, limits = tables
    ledgers.admitted(ledger, 0, spark.createDataFrame([request(k) for k in (1, 2, 3)], REQUESTS), consents, limits, 10)
    edges = spark.createDataFrame([("sample-1", "set"), ("sample-2", "set"), ("set", "job"), ("job", "model"), ("sample-3", "other")], "parent string, child string")
    kinds = spark.createDataFrame([("set", "dataset"), ("job", "job"), ("model", "delivery"), ("other", "dataset")], "node string, kind string")
    asked = spark.createDataFrame([("t", "sample-1"), ("t", "sample-1"), ("u", "sample-2"), ("t", "nothing"), ("t", None)], "tenant_id string, sample_id string")
    assert ledgers.deleted(ledger, 5, asked, edges, kinds, 20) == {"samples": 1, "artifacts": 1, "replayed": 0}
    assert {r[0] for r in state(ledger)["revoked"]} == {"sample-1", "set", "job", "model"}
    assert {r[:2] for r in state(ledger)["tombstones"]} == {("t", "sample-1"), ("u", "sample-2"), ("t", "nothing")}
    assert ledgers.deleted(ledger, 5, asked, edges, kinds, 21) == {"samples": 1, "artifacts": 1, "replayed": 1}
    again = spark.createDataFrame([("t", "sample-1"), ("t", "sample-2")], "tenant_id string, sample_id string")
    assert ledgers.deleted(ledger, 6, again, edges, kinds, 22) == {"samples": 1, "artifacts": 0, "replayed": 0}  # revoked once
    # A deleted sample does not come back.
    assert ledgers.admitted(ledger, 7, spark.createDataFrame([request(20, sample_id="sample-1")], REQUESTS), consents, limits, 23)["samples"] == 0


def test_stream_of_requests(spark, tables):
    ledger, consents, limits = tables
    source, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    for k, part in enumerate(([request(1), request(2)], [request(2), request(3)], [request(1)])):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(f"{source}/p{k}")
        stream = spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").parquet(source)
        ledgers.admission_stream(ledger, stream, consents, limits, lambda: 10, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["sample_id"] for r in ledger.table("samples").collect()) == ["sample-1", "sample-2", "sample-3"]
    assert ledger.table("receipts").count() == 3


def test_training_folders(spark):
    from vellum.sources.clip_files import ClipFiles, split_clips

    spark.dataSource.register(ClipFiles)
    samples = spark.createDataFrame([("t", f"s{k:02}", k) for k in range(10)] + [("u", "x", 1)], "tenant_id string, sample_id string, received_at long")
    clips = spark.createDataFrame([(f"s{k:02}", i) for k in range(10) for i in range(k % 3)] + [("x", 0), ("gone", 0)], "sample_id string, clip_ix long")
    named = {(r["tenant_id"], r["sample_id"], r["clip_ix"]): (r["split"], r["name"]) for r in split_clips(samples, clips, 0.25, 2).collect()}
    assert named == {("t", f"s{k:02}", i): ("heldout" if k >= 7 else "train", f"{k:06}-{i:03}") for k in range(10) for i in range(k % 3)} | {("u", "x", 0): ("heldout", "000000-000")}
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [("train", "000001-000", [1, -2, 32_767], "yksi"), ("train", "000002-000", None, None), ("heldout", "000007-000", list(range(100)), "ä\nb")]
    frame = spark.createDataFrame(rows, "split string, name string, samples array<int>, text string")
    for _ in range(2):
        frame.write.format("clip_files").mode("append").save(folder)
    import pathlib
    import wave

    assert sorted(str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.*")) == sorted(f"{s}/{n}.{x}" for s, n, *_ in rows for x in ("wav", "txt"))
    with wave.open(f"{folder}/heldout/000007-000.wav") as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()) == (16_000, 1, 2, 100) and f.readframes(100) == np.arange(100, dtype="<i2").tobytes()
    assert open(f"{folder}/heldout/000007-000.txt", encoding="utf-8").read() == "ä\nb"
    with pytest.raises(Exception, match="not a safe name"):
        frame.withColumn("name", F.lit("../x")).write.format("clip_files").mode("append").save(folder)


def test_lineage_of_many_steps(spark):
    from vellum.operators import control

    edges = [(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n3"), ("other", "n5x")]
    got = control.descendants(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("n0",), ("n0",)], "node string"))
    assert sorted(r["node"] for r in got.collect()) == sorted(f"n{k}" for k in range(1, 71))
