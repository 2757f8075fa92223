"""Packing by patterns: repeat counts of few-document length patterns fitted to the histogram.

Documents become token ids (the tokenizer's, then one end id); longer ones than a sequence are cut.
The pieces' lengths make a histogram of at most ``size`` bins, all that the driver sees. Patterns of
a few lengths that nearly fill a sequence get repeat counts by non-negative least squares, rounded
down so that no length is used too often; what is left is packed best fit first, whole groups of
equal sequences at a time. A piece finds its place from its rank among the pieces of its length: its
rank within its task plus the pieces of that length in earlier tasks. No piece is compared with
another, and a length that a third of the pieces have costs no more than others.

White space separates words before the vocabulary's merges apply, so each word is encoded once per
worker process and looked up afterwards. Where the tokenizer also lower-cases and parts letters from
marks, pieces of words between ASCII letters and marks are looked up, in lower case. Both are tried
out on sample texts when the tokenizer is read; one that fails has every text encoded whole.

Defined cases: a null or empty text is the end id alone. A null doc_id is kept as null. Repeated rows
are packed each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_arrow, materialize
from .text import EXACT, LOWER, HashIndex, Words, chunks, mix

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"


#: Letters and digits on one side, marks on the other: where words may be parted. Apostrophes lead endings, "<", "|" and ">" stand in special tokens.
LETTER, MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LETTER[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
MARK[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = True
SAMPLES = ("Plain words, (some) IN capitals; don't -- x=1.5", "  \t wide\n\nspace\u00a0and \u00e9t\u00e9, e\u0301te\u0301. na\u00efve!?", "a_b <|x|> c++ 3,000.00% \u2014,\u2014 I'LL we're", "\u0130 \u1e9e \u4e2d\u6587\u3002abc/def")


class WordEncoder:
    """Token ids of whole texts, by looking up the ids of their words, or pieces; at most ``most`` are remembered."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = bool(self.tokenizer.get_added_tokens_decoder())
        wanted = [x.ids for x in self.tokenizer.encode_batch(list(SAMPLES), add_special_tokens=False)]
        raw = [x.encode() for x in SAMPLES]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        for self.by in ("pieces", "words", "texts"):
            self.forget()
            ids, at = self.encode(data, offsets)
            if [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted:
                break

    def forget(self) -> None:
        self.index, self.starts, self.lengths, self.ids, self.used = HashIndex(), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in words], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        new = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * (self.used + len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        self.index.put(keys, np.arange(len(keys)) + len(self.starts))
        self.starts = np.concatenate([self.starts, (self.used + np.cumsum(lengths) - lengths).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(new)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a buffer's documents and where each document's begin."""
        raw = data.tobytes()
        if self.by == "texts":
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        if len(self.starts) > self.most:
            self.forget()
        # Where a special token may stand, words count as they are written.
        fold = self.by == "pieces" and not (self.special and b"<|" in raw)
        w = Words(data, offsets, LOWER if fold else EXACT, parted(data) if fold else None)
        keys = w.hash if fold else mix(w.hash)
        row = self.index.get(keys)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            self.learn(fresh, [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            row = self.index.get(keys)
        lengths = self.lengths[row]
        ends = np.cumsum(lengths, dtype=np.int64)
        ids = self.ids[np.repeat(self.starts[row] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[w.bounds]


def parted(data: np.ndarray) -> np.ndarray:
    """The places, after the first, at which an ASCII letter or digit meets a mark."""
    letter, mark = LETTER[data], MARK[data]
    return np.flatnonzero((letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])) + 1


@cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process, whatever the number of its tasks."""
    return WordEncoder(path)


@dataclass
class Plan:
    """Per length l, slots from first[l] to first[l + 1]: ranks from rank[j] on sit in sequences base[j] + i at offset[j]."""

    first: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank, length))
        slot = np.zeros(len(order), dtype=np.int64)
        l, r = length[order], rank[order]
        for a, b in zip(*_runs(l), strict=True):
            lo, hi = self.first[l[a]], self.first[l[a] + 1]
            slot[order[a:b]] = lo + np.searchsorted(self.rank[lo:hi], r[a:b], "right") - 1
        return self.base[slot] + rank - self.rank[slot], self.offset[slot]


def _runs(ordered: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(ordered)) + 1
    if not len(ordered):
        return [], []
    return [0, *cut.tolist()], [*cut.tolist(), len(ordered)]


def few_document_patterns(lengths: np.ndarray, size: int, most: int = 4, waste: float = 0.01) -> list[tuple[int, ...]]:
    """Patterns of 1 to ``most`` of the given lengths that leave at most ``waste`` of a sequence empty.

    From each length, the rest is filled by the longest that fits or by two to ``most - 1`` near-equal parts.
    """
    have = np.sort(lengths)
    out: set[tuple[int, ...]] = set()
    for l in have.tolist():
        for parts in range(most):
            pattern, room = [l], size - l
            for left in range(parts, 0, -1):
                k = bisect_right(have, room // left) - 1
                if room <= 0 or k < 0:
                    break
                pattern.append(int(have[k]))
                room -= pattern[-1]
            if room <= waste * size:
                out.add(tuple(sorted(pattern, reverse=True)))
    return sorted(out, reverse=True)


def repeat_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|, by multiplicative steps; A has the patterns as columns."""
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([l for p in patterns for l in p])
    target = np.bincount(column, histogram[row], minlength=len(patterns))
    x = np.full(len(patterns), 1.0)
    for _ in range(steps):
        fitted = np.bincount(row, x[column], minlength=len(histogram))
        x *= target / np.maximum(np.bincount(column, fitted[row], minlength=len(patterns)), 1e-12)
    return x


def pack(histogram: np.ndarray, size: int) -> Plan:
    """A plan that places every piece counted in ``histogram`` (index: length)."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[list[tuple[int, int]], int]] = []  # lengths with their copies; sequences
    patterns = few_document_patterns(np.flatnonzero(left), size)
    for pattern, x in zip(patterns, repeat_counts(patterns, left.astype(float)), strict=True):
        lengths, copies = np.unique(pattern, return_counts=True)
        times = int(min(x, (left[lengths] // copies).min()))
        if times > 0:
            left[lengths] -= times * copies
            chosen.append(([(int(l), int(c)) for l, c in zip(lengths[::-1], copies[::-1], strict=True)], times))
    have = np.flatnonzero(left).tolist()
    while have:
        room, used, k = size, [], len(have)
        while room and (k := min(k, bisect_right(have, room))):
            l = have[k - 1]
            copies = min(room // l, int(left[l]))
            used.append((l, copies))
            room, k = room - l * copies, k - 1
        times = min(int(left[l]) // c for l, c in used)
        for l, c in used:
            left[l] -= times * c
            if not left[l]:
                have.remove(l)
        chosen.append((used, times))
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for used, times in chosen:
        at = 0
        for l, copies in used:
            for _ in range(copies):
                slots.setdefault(l, []).append((times, base, at))
                at += l
        base += times
    first, rank, bases, offsets = np.zeros(size + 2, np.int64), [], [], []
    for l in range(size + 1):
        n = 0
        for times, b, at in slots.get(l, ()):
            rank.append(n), bases.append(b), offsets.append(at)
            n += times
        first[l + 1] = len(rank)
    return Plan(first, np.array(rank, np.int64), np.array(bases, np.int64), np.array(offsets, np.int64), base)


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, with the task that made each and its rank among that task's pieces of its length."""
    bounded_arrow(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = encoder(tokenizer), TaskContext.get().partitionId()
        counter, end = [0] * (size + 1), np.array([end_id], dtype="<u4").tobytes()
        for batch, data, offsets in chunks(batches):
            ids, at = known.encode(data, offsets)
            ids, rows = ids.astype("<u4"), []
            for doc, (a, b) in zip(batch.column("doc_id").to_pylist(), zip(at[:-1].tolist(), at[1:].tolist(), strict=True), strict=True):
                for k, start in enumerate(range(0, b - a + 1, size)):
                    stop = min(start + size, b - a + 1)
                    crc = zlib.crc32(ids[a + start : min(a + stop, b)].tobytes())
                    if stop > b - a:
                        crc = zlib.crc32(end, crc)
                    rows.append((doc, k, start, stop - start, crc, counter[stop - start]))
                    counter[stop - start] += 1
            doc, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array([task] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "within", "task"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{PIECES}, within long, task int")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut = materialize(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    tally = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tally = materialize(tally.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "tally")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(pack(histogram, size))  # slots of at most ``size`` lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = cut.join(tally.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, SCHEMA)
