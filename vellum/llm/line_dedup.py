"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

A first pass over the texts fills the filters: each task marks the bits of its documents' distinct
lines and sends the set ones by slices; merging a slice, bits that are marked again become "twice".
Only lines that the "twice" filter knows - suspected repeats - are shuffled,
as 128-bit digests with their document, to be counted exactly and to choose the document that keeps
them. The filters have ``2**log2_bits`` bits, enough for some hundred million different lines; no task
holds more than a slice of them, and the "twice" filter travels as a list of its set bits or as bits,
128 MiB at most. On an input too large for them
they fill up and more lines are suspected, which costs shuffled digests but never a wrong result.

Defined cases: a null or empty text is one empty line, which is never a repeat, as is any line of
under ``min_chars`` code points. Rows with the same doc_id count as one document and are treated
alike. A null doc_id counts as the smallest document. Other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_arrow, materialize, shuffle_parts
from .text import U, mix

SLICE_BITS = 20
KEY, PART, DROPS = "__vellum_key", "__vellum_part", "__vellum_drops"
NO_ID = -(1 << 63)
#: The filter's size. It travels as the list of its set bits while that is shorter than 128 MiB, the size of all its bits.
LOG2_BITS = 30
#: A task marks so many lines before it lets them go.
MOST_MARKED = 500_000
WHITE = b" \t\n\x0b\x0c\r"


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None for a key that is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        yield batch, [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    out = {line_digest(x, min_chars) for x in text.split(b"\n")}
    out.discard(None)
    return out


def _positions(digests: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each digest (rows of two 64-bit halves)."""
    a = mix(digests[:, 0])
    return (a >> U(64 - log2_bits)).astype(np.int64), (mix(a ^ digests[:, 1]) >> U(64 - log2_bits)).astype(np.int64)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=U).reshape(-1, 2)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, log2_bits: int) -> tuple[bool, np.ndarray]:
    """The "twice" filter over all documents: (True, its set bits in order), or (False, all bits packed) where that is shorter."""
    bits = min(SLICE_BITS, log2_bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def release() -> pa.RecordBatch:
            halves = np.concatenate(held)
            _, first, count = np.unique(halves[:, 0], return_index=True, return_counts=True)
            rows = {}
            for name, some in (("once", first), ("twice", first[count > 1])):
                if not len(some):  # no line twice
                    continue
                at = np.unique(np.concatenate(_positions(halves[some], log2_bits)))
                part, cut = np.unique(at >> bits, return_index=True)
                for k, x in zip(part.tolist(), np.split((at & ((1 << bits) - 1)).astype(np.int32), cut[1:]), strict=True):
                    rows.setdefault(k, {})[name] = x.tobytes()
            columns = [pa.array([r.get(n, b"") for r in rows.values()], pa.binary()) for n in ("once", "twice")]
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *columns], ["slice", "once", "twice"])

        for _, texts in _texts(batches, text_col):
            found = [d for x in texts for d in _digests(x, min_chars)]
            if found:
                held.append(_halves(found))
                size += len(found)
            if size > MOST_MARKED:  # what comes after counts as another task's
                yield release()
                held, size = [], 0
        if held:
            yield release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], ["slice", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != at:
                    if at is not None:
                        yield done()
                    at, once, twice = row["slice"], np.zeros(1 << bits, dtype=bool), np.zeros(1 << bits, dtype=bool)
                a, b = (np.frombuffer(row[x], dtype=np.int32) for x in ("once", "twice"))
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        if at is not None:
            yield done()

    marked = docs.select(text_col).mapInArrow(mark, "slice int, once binary, twice binary")
    merged = marked.repartition(min(1 << (log2_bits - bits), shuffle_parts(docs.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    slices = {row["slice"]: row["twice"] for row in merged.collect()}  # all slices together have the filter's fixed size at most
    unpacked = lambda k: np.frombuffer(zlib.decompress(slices[k]), dtype=np.uint8)
    if 32 * sum(int(np.bitwise_count(unpacked(k)).sum()) for k in slices) < 1 << log2_bits:
        places = [np.flatnonzero(np.unpackbits(unpacked(k), count=1 << bits)).astype(np.int32) + np.int32(k << bits) for k in sorted(slices)]
        return True, np.concatenate([np.zeros(0, np.int32), *places])
    out = np.zeros((1 << log2_bits) // 8, dtype=np.uint8)
    size = (1 << bits) // 8
    for k in slices:
        out[k * size : (k + 1) * size] = unpacked(k)
    return False, out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents are known by their id; rows without one, which are one document, by their texts, so that they aren't dealt together."""
    return docs.withColumns({KEY: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), PART: F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(0)})


def repeats(rows: DataFrame, min_docs: int = 3, min_chars: int = 20, log2_bits: int = LOG2_BITS) -> DataFrame:
    """(keys of the document, digests of the lines that it loses), for keyed documents that lose lines."""
    spark = rows.sparkSession
    bounded_arrow(spark)
    known = spark.sparkContext.broadcast(twice_filter(rows, "text", min_chars, log2_bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, twice = known.value

        def seen(p: np.ndarray) -> np.ndarray:
            if listed:
                return twice[np.minimum(np.searchsorted(twice, p), len(twice) - 1)] == p if len(twice) else np.zeros(len(p), dtype=bool)
            return (twice[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1

        for batch, texts in _texts(batches, "text"):
            sets = [list(_digests(x, min_chars)) for x in texts]
            halves = _halves([d for s in sets for d in s])
            sizes = [len(s) for s in sets]
            p, q = _positions(halves, log2_bits)
            at = np.flatnonzero(seen(p) & seen(q))
            if len(at):
                signed = halves.view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(x).to_numpy(), sizes)[at]) for x in (KEY, PART)), pa.array(signed[at, 0]), pa.array(signed[at, 1])], [KEY, PART, "a", "b"])

    suspects = materialize(rows.select(KEY, PART, "text").mapInArrow(suspect, f"{KEY} long, {PART} long, a long, b long").distinct(), "suspects")
    # Written, so that the join below reads two plain shuffles and a very common line can be split.
    nameless = F.col(KEY) == NO_ID
    times = F.count_if(~nameless) + F.max(nameless.cast("int"))
    counted = materialize(suspects.groupBy("a", "b").agg(times.alias("n"), F.max(KEY).alias("keeps")).where(F.col("n") >= min_docs), "counted")
    lost = suspects.join(counted, ["a", "b"]).where(F.col(KEY) != F.col("keeps"))
    return lost.groupBy(KEY, PART).agg(F.collect_list(F.struct("a", "b")).alias(DROPS))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    lost = repeats(keyed.select(KEY, PART, F.col(text_col).alias("text")), **options)
    return keyed.join(lost, [KEY, PART], "left")


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, min_chars: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, int]]]]:
    """For each row: the text left, its lines before, the lines dropped."""
    for batch, texts in _texts(batches, text_col):
        out = []
        for text, drops in zip(texts, batch.column(DROPS).to_pylist(), strict=True):
            lines = text.split(b"\n")
            if not drops:
                out.append((text, len(lines), 0))
                continue
            gone = {np.array([x["a"], x["b"]], dtype=np.int64).tobytes() for x in drops}
            stay = [x for x in lines if line_digest(x, min_chars) not in gone]
            out.append((b"\n".join(stay), len(lines), len(lines) - len(stay)))
        yield batch, out


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = LOG2_BITS) -> DataFrame:
    """``docs`` with repeated lines cut from the texts; an untouched null text stays null."""
    joined = _with_drops(docs, id_col, text_col, min_docs=min_docs, min_chars=min_chars, log2_bits=log2_bits)
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _cut(batches, text_col, min_chars):
            nulls = batch.column(text_col).is_null().to_pylist()
            texts = pa.array([None if void else t for (t, _, _), void in zip(rows, nulls, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts.cast(pa.string()) if n == text_col else batch.column(n) for n in names], names)

    return joined.mapInArrow(apply, docs.schema)


def digest(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, log2_bits: int = LOG2_BITS) -> DataFrame:
    """Per document: its lines, the lines dropped and the SHA-256 of the text left."""
    joined = _with_drops(docs.select("doc_id", "text"), "doc_id", "text", min_docs=min_docs, min_chars=min_chars, log2_bits=log2_bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _cut(batches, "text", min_chars):
            shas = [hashlib.sha256(t).hexdigest() for t, _, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int64()), pa.array(shas, pa.string())], out.names)

    out = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())))])
    return joined.mapInArrow(apply, out)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeps FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeps <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeps IS NULL OR keeps = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY doc_id
"""
