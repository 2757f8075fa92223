"""Training folders: ``<split>/<name>.wav`` beside ``<name>.txt``, written from a table of clips.

``spark.dataSource.register(ClipFiles)``, then ``df.write.format("clip_files").mode("append").save(folder)`` with
columns split, name, samples (16 kHz, mono) and text. A pair's text is written last, so a clip without it
is not whole. A row that runs again writes the same files; names must be safe entries. ``split_clips`` makes
the table: the last clips in time are held out, a name is its sample's place and the clip's.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from vellum.functions import text as T
from vellum.functions.numbers import RATE
from vellum.operators import control
from vellum.sources.sessions import _store

SCHEMA = "split string, name string, samples array<int>, text string"


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """The 44 bytes of a PCM16 mono header and the samples."""
    body = np.asarray(samples, dtype="<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body)) + body


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, inner = _store(self.path)
        for row in rows:
            for part in (row["split"], row["name"]):
                if not re.fullmatch(T.SAFE_ENTRY[2:-2], part or "") or ".." in part:
                    raise ValueError(f"not a safe name: {part!r}")
            folder = f"{inner}/{row['split']}"
            store.create_dir(folder, recursive=True)
            for suffix, body in (("wav", wav(row["samples"] or [])), ("txt", (row["text"] or "").encode())):
                with store.open_output_stream(f"{folder}/{row['name']}.{suffix}") as f:
                    f.write(body)
        return WriterCommitMessage()


class ClipFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("clip files are only added")
        return _Writer(self.options["path"])


def split_clips(samples: DataFrame, clips: DataFrame, fraction: float = 0.2, least: int = 30) -> DataFrame:
    """(tenant_id, split, name, sample_id, clip_ix) of clips (sample_id, clip_ix) of samples (tenant_id, sample_id, received_at)."""
    dealt = control.time_split(samples.select("tenant_id", "sample_id", "received_at"), "tenant_id", ["received_at", "sample_id"], fraction, least, place="n")
    placed = dealt.select("tenant_id", "sample_id", F.col("n").cast("int").alias("n"), F.when(F.col("held_out"), "heldout").otherwise("train").alias("split"))
    name = F.format_string("%06d-%03d", F.col("n"), F.col("clip_ix").cast("int"))
    return clips.select("sample_id", "clip_ix").join(placed, "sample_id").select("tenant_id", "split", name.alias("name"), "sample_id", "clip_ix")
