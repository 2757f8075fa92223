"""Removal of long repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes. Strings are
sorted into buckets without sorting all suffixes at once:

1. Texts that occur twice or more are one text from here on; if long enough they go as a whole.
2. Each string (by its start) belongs to an anchor, the q-gram of least hash within it; equal strings
   have equal anchors at equal offsets, so buckets of anchors are the initial q-gram buckets. Strings
   of an anchor that occurs once are unique and leave.
3. The strings of the others meet by anchor, with the bytes that they span. Starting from the bucket
   identifiers of their first bytes, buckets are refined by the identifiers at later offsets: a
   string's identifier for h bytes and that of the offset h further name its bucket for 2h bytes, the
   refined identifiers are used for the next step, and strings alone in their bucket leave.

An anchor with more than ``most`` occurrences is not refined in one task but by rounds of aggregates over
all (``unique_by_rows``). Identifiers have 64 bits and only compare strings of one anchor at one offset.

Defined cases: a null or empty text has nothing to remove. A null doc_id is a document like any
other; a repeated row is a copy of the first and both go (if long enough). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_arrow, materialize, shuffle_parts
from .text import EXACT, U, chunks, mix, powers

SHIFT = 16
#: Strings of whole anchors are sorted together up to so many bytes.
RUN_BYTES = 1 << 20
#: The bits of a position in a buffer; a hash is ordered by the others, whatever the buffer.
POSITION = U((1 << 32) - 1)
EMPTY = hashlib.sha256(b"").hexdigest()


class Grams:
    """Hashes of byte strings of a buffer, by start and length."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(EXACT[data] * self.up[: len(data)], out=self.prefix[1:])

    def all(self, n: int) -> np.ndarray:
        """The hash of the n bytes from every start on."""
        m = len(self.prefix) - n
        return mix((self.prefix[n:] - self.prefix[:m]) * self.down[:m]) if m > 0 else np.zeros(0, dtype=U)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    blocks = np.concatenate([v, np.full(-len(v) % w, np.iinfo(U).max, dtype=U)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, position in it, hash, first and last start of its strings, as distances back) of each anchor."""
    hashes = Grams(data).all(gram)
    least = sliding_least(hashes & ~POSITION | np.arange(len(hashes), dtype=U), length - gram + 1)  # equal hashes: the first, in equal strings at equal places
    at = (least & POSITION).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= offsets[doc + 1])
    at, doc = at[starts], doc[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    p = at[first]
    return doc[first], p - offsets[doc[first]], hashes[p], p - starts[first], p - starts[last]


def refine(data: np.ndarray, bases: np.ndarray, counts: np.ndarray, salts: np.ndarray, back: np.ndarray, length: int) -> np.ndarray:
    """Which strings (``counts[i]`` consecutive starts from ``bases[i]`` on, ``back[i]`` before their anchor) occur twice."""
    total = int(counts.sum())
    step = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    where = np.repeat(bases.astype(np.int32), counts) + step
    salt = mix(np.repeat(salts, counts) + (np.repeat(back.astype(np.int32), counts) - step).astype(U))
    del step
    out, active = np.zeros(total, dtype=bool), np.arange(total, dtype=np.int32)
    h = max(1, length >> 3)
    pointer = Grams(data).all(h)
    while len(active):
        keys = mix(pointer[where[active]] + salt[active])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        shared = np.zeros(len(active), dtype=bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        active = active[shared]
        if h == length:
            out[active] = True
            break
        later = min(h, length - h)
        pointer = mix(pointer[: len(pointer) - later] * U(0x9E3779B97F4A7C15) + pointer[later:])
        h += later
    return out


def unique_by_rows(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, b, lo, hi): which starts of anchors with any number of occurrences occur once.

    The starts of an occurrence, by their distance to the anchor, are one range at first. Ranges with
    equal bytes are repeated as a whole. Of the others those are cut by blocks of distances, finer from
    round to round, whose block's core - the bytes that all strings of the block span - occurs again; the
    rest is unique. Of repeated ranges one goes on as a witness where others are still open. So a passage
    costs a row an occurrence, and its edges a few, not a row for each string; no group is gathered.
    """
    state = found.select("hash", "a", "b", "p", (F.col("p") - F.col("hi")).alias("near"), (F.col("p") - F.col("lo")).alias("far"), "body", F.lit(1).alias("weight"))
    block, unique = 1 << 2 * -(-max(1, (length - gram).bit_length()) // 2), []
    cut = state.withColumns({"block": F.lit(0).cast("long"), "core": F.lit(0).cast("long")})
    while True:
        one = F.max(F.struct("a", "b", "p", "body")).alias("one")
        wholes = materialize(cut.withColumn("whole", F.xxhash64("body")).groupBy("hash", "block", "core", "near", "far", "whole").agg(F.sum("weight").alias("times"), one), "wholes")
        cores = materialize(wholes.groupBy("hash", "block", "core").agg(F.sum("times").alias("total"), F.count_if(F.col("times") == 1).alias("open")).where("open > 0 AND total > 1"), "cores")
        last = block == 1  # a block of one string: its core is the string
        alone = wholes.where("times = 1")
        alone = alone if last else alone.join(cores.select("hash", "block", "core"), ["hash", "block", "core"], "left_anti")
        unique.append(alone.select("one.a", "one.b", (F.col("one.p") - F.col("far")).alias("lo"), (F.col("one.p") - F.col("near")).alias("hi")))
        if last:
            break
        # The open ones, and one of each repeated whole.
        left = wholes.join(cores, ["hash", "block", "core"])
        state = materialize(left.select("hash", "one.a", "one.b", "one.p", "near", "far", "one.body", F.least("times", F.lit(2)).cast("int").alias("weight")), "state")
        if state.isEmpty():
            break
        block //= 4
        at = F.col("block") * block
        pieces = state.withColumn("block", F.explode(F.sequence(F.floor(F.col("near") / block), F.floor(F.col("far") / block))))
        low, high = F.greatest("near", at), F.least("far", at + (block - 1))
        cut = pieces.select(
            "hash", "a", "b", "p", low.alias("near"), high.alias("far"), F.substring("body", (F.col("far") - high + 1).cast("int"), (high - low + length).cast("int")).alias("body"), "weight", "block",
            F.xxhash64(F.substring("body", (F.col("far") - at + 1).cast("int"), F.lit(max(0, length - block + 1)))).alias("core"),
        )
    return reduce(DataFrame.union, unique)


def less(ranges: list[tuple[int, int]], but: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (first, last) ranges, of which no two overlap, without those of ``but``, each of which lies in one."""
    out, but = [], sorted(but)
    k = 0
    for lo, hi in sorted(ranges):
        while k < len(but) and but[k][0] <= hi:
            if but[k][0] > lo:
                out.append((lo, but[k][0] - 1))
            lo, k = but[k][1] + 1, k + 1
        if lo <= hi:
            out.append((lo, hi))
    return out


def removed_spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by strings whose starts are in the given (first, last) ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def spans(docs: DataFrame, length: int = 400, gram: int | None = None, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with text key, distinct texts, texts with ranges of starts: repeated ones, and unique ones to take out of them)."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    gram = gram or max(1, length * 8 // 25)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("owner"), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            doc, p, hashes, lo, hi = anchors(data, offsets, length, gram)
            cut = np.searchsorted(doc, np.arange(len(offsets)))
            ends = pa.array(cut.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes.view(np.int64), p, (lo << SHIFT | hi).astype(np.int64))]
            raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("owner", "a", "b")), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), *lists],
                ["owner", "a", "b", "n_bytes", "sha", "hash", "p", "back"],
            )

    described = rows.mapInArrow(describe, "owner long, a long, b long, n_bytes long, sha string, hash array<long>, p array<long>, back array<long>")
    texts = materialize(
        described.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("owner").alias("owner"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"), F.first(F.struct("hash", "p", "back")).alias("at")), "texts"
    )
    found = texts.select("a", "b", "owner", F.explode(F.arrays_zip("at.hash", "at.p", "at.back")).alias("x")).select("a", "b", "owner", "x.hash", "x.p", "x.back")
    common = materialize(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "common")
    suspects = found.join(common, "hash").groupBy("a", "b", "owner").agg(F.collect_list(F.struct("hash", "n", "p", "back")).alias("anchors"))
    held = materialize(rows.select("a", "b", "owner", "text").join(suspects, ["a", "b", "owner"]).dropDuplicates(["a", "b", "owner"]).select("a", "b", "text", "anchors"), "suspects")  # a repeated row counts once

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lists = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("anchors")
            ends, flat = lists.offsets.to_numpy(), lists.values
            fields = {k: flat.field(k).to_numpy() for k in ("hash", "n", "p", "back")}
            at = slice(int(ends[0]), int(ends[-1]))
            which = np.repeat(np.arange(len(raw)), np.diff(ends))
            p, back = fields["p"][at], fields["back"][at]
            lo, hi = p - (back >> SHIFT), p - (back & ((1 << SHIFT) - 1))
            a, b = (batch.column(x).to_numpy()[which] for x in "ab")
            for k in range(0, len(which), 5000):
                part = slice(k, k + 5000)
                bodies = [raw[i][x : y + length] for i, x, y in zip(which[part].tolist(), lo[part].tolist(), hi[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (fields["hash"][at], fields["n"][at], a, b, lo, hi, p)), pa.array(bodies, pa.binary())], ["hash", "n", "a", "b", "lo", "hi", "p", "body"])

    def strings(wanted: Callable[[Column], Column]) -> DataFrame:
        chosen = held.withColumn("anchors", F.filter("anchors", lambda x: wanted(x["n"]))).where(F.size("anchors") > 0)
        return chosen.mapInArrow(extract, "hash long, n long, a long, b long, lo long, hi long, p long, body binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            bodies = table["body"].combine_chunks().cast(pa.large_binary())
            bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
            ends = np.frombuffer(bodies.buffers()[1], dtype=np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
            data = np.frombuffer(bodies.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
            a, b, lo, hi, p, keys = (table[x].to_numpy() for x in ("a", "b", "lo", "hi", "p", "hash"))
            counts = hi - lo + 1
            twice = refine(data, ends[:-1] - ends[0], counts, keys.view(U), p - lo, length)
            owner = np.repeat(np.arange(len(lo)), counts)
            starts = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            owner, starts = owner[twice], starts[twice]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(owner))[: len(first)] - 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[owner[first]], b[owner[first]], starts[first], starts[last])], ["a", "b", "lo", "hi"])

        for batch in batches:  # ordered by anchor: a run ends where the anchor changes
            keys = batch.column("hash").to_numpy()
            at = 0
            for cut in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
                if size > RUN_BYTES and held and held[-1].column("hash")[-1].as_py() != int(keys[at]):
                    yield run(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(at, cut - at))
                size += int(pc.sum(pc.binary_length(held[-1].column("body"))).as_py())
                at = cut
        if held:
            yield run(pa.Table.from_batches(held))

    parts = shuffle_parts(spark)
    usual = strings(lambda n: n <= most).repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(sort, "a long, b long, lo long, hi long")
    hot = strings(lambda n: n > most)
    rest = hot.select("a", "b", "lo", "hi", F.lit(True).alias("twice")).union(unique_by_rows(hot, length, gram).withColumn("twice", F.lit(False)))
    ranges = usual.withColumn("twice", F.lit(True)).union(rest).groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi", "twice")).alias("ranges"))
    return rows, texts, held.select("a", "b", "text").join(ranges, ["a", "b"])


def digest(docs: DataFrame, length: int = 400, gram: int | None = None, most: int = 2000) -> DataFrame:
    """Per document: its bytes, those removed, in how many runs, and the SHA-256 of the rest."""
    rows, texts, found = spans(docs, length, gram, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                gone = removed_spans(less([(x["lo"], x["hi"]) for x in ranges if x["twice"]], [(x["lo"], x["hi"]) for x in ranges if not x["twice"]]), length)
                edges = [0, *(x for s in gone for x in s), len(raw)]
                left = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
            removed, n, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["a", "b", "removed", "runs", "left"])

    cuts = materialize(found.mapInArrow(cut, "a long, b long, removed long, runs long, left string").join(texts.select("a", "b", "copies", "n_bytes", "sha"), ["a", "b"], "right"), "cuts")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.select("doc_id", "a", "b").join(cuts, ["a", "b"]).select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )
