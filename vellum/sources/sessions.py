"""Stored sessions as a data source: a JSON header and little-endian 16-bit audio for each, read as a table or a stream.

``spark.dataSource.register(StoredSessions)``, then ``spark.read.format("stored_sessions").load(folder)``,
``spark.readStream...`` and ``df.write.format("stored_sessions").mode("append").save(folder)``. A session is
``<name>.json`` and ``<name>.pcm`` beside it; names are hex of the session's id. The header is written last, so a
session is there as a whole or not at all. Folders may be in any store that Arrow's file systems reach.

A stream reads what came since its offset: the time and name of the last header. A file that comes later
with an older time isn't seen by a stream that has passed it.

A session that can't be read - a header of another form, a word with turned times or a confidence outside 0 to
1, audio of an odd number of bytes or none - is a row with its name, ``valid`` false and nulls.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

WORDS = "array<struct<id:bigint,text:string,display:string,start:bigint,end:bigint,confidence:double,unreliable:boolean>>"
SCHEMA = f"name string, valid boolean, session_id string, started_at bigint, language string, sample_rate bigint, total_samples bigint, asr_model string, asr_model_revision string, words {WORDS}, samples array<smallint>"
HEADER = {"session_id": str, "started_at": int, "language": str, "sample_rate": int, "total_samples": int, "asr_model": str, "asr_model_revision": str}
WORD = {"id": int, "text": str, "display": str, "start": int, "end": int, "confidence": float, "unreliable": bool}
_WORD = pa.struct([("id", pa.int64()), ("text", pa.string()), ("display", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64()), ("unreliable", pa.bool_())])
_KINDS = {str: pa.string(), int: pa.int64()}
ARROW = pa.schema([("name", pa.string()), ("valid", pa.bool_()), *((k, _KINDS[t]) for k, t in HEADER.items()), ("words", pa.list_(_WORD)), ("samples", pa.list_(pa.int16()))])
FILES_AT_ONCE = 64


def _of(kind: type, x: object) -> bool:
    if kind is float:
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    return isinstance(x, kind) and (kind is bool or not isinstance(x, bool))


def encode(session: dict) -> tuple[bytes, bytes]:
    """(header, audio) of a session: the header's fields, its words, and samples."""
    head = {k: session[k] for k in HEADER} | {"words": [{k: w[k] for k in WORD} for w in session["words"] or []]}
    return json.dumps(head, ensure_ascii=False).encode(), np.asarray(session["samples"] if session["samples"] is not None else [], dtype="<i2").tobytes()


def decode(header: bytes, audio: bytes | None) -> dict | None:
    """The session, or None where it can't be read. Unknown fields are left out."""
    try:
        head = json.loads(header)
    except ValueError:
        return None
    if not isinstance(head, dict) or audio is None or len(audio) % 2 or not all(_of(t, head.get(k)) for k, t in HEADER.items()) or not isinstance(head.get("words"), list):
        return None
    last = -1
    for w in head["words"]:
        if not isinstance(w, dict) or not all(_of(t, w.get(k)) for k, t in WORD.items()):
            return None
        if not 0 <= w["start"] <= w["end"] or not 0 <= w["confidence"] <= 1 or w["id"] <= last:
            return None
        last = w["id"]
    if head["sample_rate"] <= 0 or head["total_samples"] < 0:
        return None
    words = [{k: float(w[k]) if t is float else w[k] for k, t in WORD.items()} for w in head["words"]]
    return {k: head[k] for k in HEADER} | {"words": words, "samples": np.frombuffer(audio, dtype="<i2")}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, inner.rstrip("/")


def _headers(path: str) -> list[tuple[int, str]]:
    """(time in ns, name) of the sessions of a folder, in order."""
    store, inner = _store(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((x.mtime_ns or 0, x.base_name.removesuffix(".json")) for x in found if x.type == fs.FileType.File and x.extension == "json")


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _split(names: list[str]) -> list[Files]:
    return [Files(names[k : k + FILES_AT_ONCE]) for k in range(0, len(names), FILES_AT_ONCE)]


def _read(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch for each session: no more than one is held."""
    store, inner = _store(path)

    def body(name: str) -> bytes | None:
        try:
            with store.open_input_stream(f"{inner}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    for name in names:
        header = body(f"{name}.json")
        found = decode(header, body(f"{name}.pcm")) if header is not None else None
        row = {"name": name, "valid": found is not None} | (found or dict.fromkeys([*HEADER, "words", "samples"]))
        yield pa.RecordBatch.from_pylist([row], schema=ARROW)


class _Table(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return _split([n for _, n in _headers(self.path)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition.names)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        found = _headers(self.path)
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return _split([x[1] for x in _headers(self.path) if low < x <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition.names)


class _Writer(DataSourceWriter):
    """Names depend on the id alone, so a task that runs again writes the same files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        for row in rows:
            session = row.asDict(recursive=True)
            header, audio = encode(session)
            name = session["session_id"].encode().hex()
            for suffix, body in (("pcm", audio), ("json", header)):
                with store.open_output_stream(f"{inner}/{name}.{suffix}") as f:
                    f.write(body)
        return WriterCommitMessage()


class StoredSessions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_sessions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Table(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("stored sessions are only added")
        return _Writer(self.options["path"])
