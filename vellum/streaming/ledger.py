"""Several tables written as one: all of a batch's rows are seen together, once, however often it is tried.

A batch's rows go to folders of their own; a manifest, written last, names them. Readers look at what
manifests name and at nothing else, so a batch that broke off between two tables leaves nothing that counts,
and one that is played again finds its manifest and changes nothing. Everything is read and written by
Spark, so any store will do whose rename of one file is atomic. One writer at a time, as a stream is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import control

MANIFEST = "batch long, tables array<struct<name:string,folder:string,n:bigint>>"
#: The tables of admitted samples.
TABLES = {
    "samples": "tenant_id string, sample_id string, consent_id string, sha256 string, bytes long, received_at long", "receipts": "tenant_id string, key string, sample_id string, accepted boolean, reason string, received_at long",
    "nodes": "node string, kind string, created_at long", "tombstones": "tenant_id string, sample_id string, deleted_at long", "revoked": "node string, kind string, revoked_at long",
}


class Ledger:
    """Tables under a folder. ``schemas`` give their columns by name."""

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str] = TABLES):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), dict(schemas)

    def manifests(self) -> list:
        """What is visible: small, a row for each batch."""
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("ignoreMissingFiles", "true")
        try:
            return rows.json(f"{self.folder}/manifests").where("batch IS NOT NULL").collect()
        except Exception as e:  # no batch yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def table(self, name: str) -> DataFrame:
        """All visible rows."""
        folders = [f"{self.folder}/{t['folder']}" for m in self.manifests() for t in m["tables"] if t["name"] == name]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[name])

    def put(self, batch: int, tables: Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]]) -> dict[str, int]:
        """Rows added to each table by a batch; of one that is there already, what it added then."""
        done = next((m for m in self.manifests() if m["batch"] == batch), None)
        if done is not None:
            return {t["name"]: t["n"] for t in done["tables"]}
        listed = []
        for name, rows in (tables() if callable(tables) else tables).items():
            folder = f"{name}/batch={batch}-{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            rows.select(*columns).write.parquet(f"{self.folder}/{folder}")
            listed.append((name, folder, self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{folder}").count()))
        self.spark.createDataFrame([(batch, listed)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/{batch}")
        return {name: n for name, _, n in listed}


def admitted(ledger: Ledger, batch: int, requests: DataFrame, consents: DataFrame, limits: DataFrame, now: int) -> dict[str, int]:
    """Requests (see ``control.admissions``) answered, with sample, receipt and lineage node put down together.

    A key answered before, in an earlier batch or earlier in this one, adds nothing: its first answer stands.
    """

    def made() -> dict[str, DataFrame]:
        samples, tombstones = ledger.table("samples"), ledger.table("tombstones")
        live = samples.join(tombstones, ["tenant_id", "sample_id"], "left_anti")
        answers = control.admissions(requests, ledger.table("receipts"), consents, tombstones, live, limits, now)
        first = answers.where("NOT duplicate").dropDuplicates(["tenant_id", "key"])
        new = first.where("accepted").join(requests.select("tenant_id", "key", "at", "consent_id", "archive_sha256", "bytes"), ["tenant_id", "key", "at"]).dropDuplicates(["tenant_id", "key"])
        at = F.lit(now).cast("long")
        return {
            "samples": new.select("tenant_id", "sample_id", "consent_id", F.col("archive_sha256").alias("sha256"), F.col("bytes").cast("long").alias("bytes"), at.alias("received_at")),
            "receipts": first.select("tenant_id", "key", F.when(F.col("accepted"), F.col("sample_id")).alias("sample_id"), "accepted", "reason", at.alias("received_at")),
            "nodes": new.select(F.col("sample_id").alias("node"), F.lit("sample").alias("kind"), at.alias("created_at")),
        }

    return ledger.put(batch, made)


def deleted(ledger: Ledger, batch: int, requested: DataFrame, edges: DataFrame, kinds: DataFrame, now: int) -> dict[str, int]:
    """Samples (tenant_id, sample_id) deleted with all that came of them: tombstones and revoked nodes, and how many samples and deliveries that were.

    A tombstone is put down for every sample that is asked for; only the tenant's own count and lead on.
    """
    asked = requested.select("tenant_id", "sample_id").where("sample_id IS NOT NULL").distinct()

    def made() -> dict[str, DataFrame]:
        old = ledger.table("tombstones")
        live = ledger.table("samples").join(old, ["tenant_id", "sample_id"], "left_anti")
        gone = live.join(asked, ["tenant_id", "sample_id"], "left_semi").select("tenant_id", "sample_id")
        reached = control.descendants(edges, gone.select(F.col("sample_id").alias("node"))).join(kinds, "node", "left").select("node", "kind")
        all_nodes = gone.select(F.col("sample_id").alias("node"), F.lit("sample").alias("kind")).union(reached).dropDuplicates(["node"])
        fresh = all_nodes.join(ledger.table("revoked").select("node"), "node", "left_anti")
        at = F.lit(now).cast("long")
        return {"tombstones": asked.join(old, ["tenant_id", "sample_id"], "left_anti").select("tenant_id", "sample_id", at.alias("deleted_at")), "revoked": fresh.select("node", "kind", at.alias("revoked_at"))}

    before = {m["batch"] for m in ledger.manifests()}
    ledger.put(batch, made)
    manifest = next(m for m in ledger.manifests() if m["batch"] == batch)
    folder = next(t["folder"] for t in manifest["tables"] if t["name"] == "revoked")
    kinds_now = {r["kind"]: r["count"] for r in ledger.spark.read.schema(TABLES["revoked"]).parquet(f"{ledger.folder}/{folder}").groupBy("kind").count().collect()}
    return {"samples": kinds_now.get("sample", 0), "artifacts": kinds_now.get("delivery", 0), "replayed": int(batch in before)}


def admission_stream(ledger: Ledger, requests: DataFrame, consents: DataFrame, limits: DataFrame, now: Callable[[], int], checkpoint: str):
    """A writer of a stream of requests into the ledger; start it with a trigger."""
    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: admitted(ledger, batch, rows, consents, limits, now()) and None)
