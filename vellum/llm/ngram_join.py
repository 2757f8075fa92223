"""N-gram Jaccard join by PartEnum signatures.

Sets are banded by size so that linked sets lie in the same or neighbouring bands. Within a band
(with the one below) the similarity bounds the number of differing shingles by k. The shingle domain
is cut into parts by hash; two sets with at most k differences agree on one part, or - where k is
small - on one of the enumerated subsets of a part's sub-parts. Each set sends a signature for every
part or subset, so each linked pair shares one. A part that holds none of a set's shingles sends no
signature: with ``spare`` further parts a set with at most ``spare`` empty ones still agrees with
its partners on a filled part, and a set with more sends the signatures of a second cut as well
(and so on), on which such pairs agree.

Documents with equal sets are one node. Signatures travel as packed arrays by slices of their range;
a task keeps one node per signature and reports the others, so a signature that very many documents
share needs no more memory. Every reported node is checked exactly against the node with which it
shares most signatures. Signatures that then still join several components are looked at again, twice
against one node each, then pairs between components (pruned by sizes and parity sketches, which
bound the difference from below, in the join itself; a pair is passed on at the least signature that
it shares, not at each). No pair
within one component is ever formed, and no link between different components is lost.

Defined cases: a text without words has an empty set and links with nothing; a text of fewer words
than a shingle is one shingle. A null doc_id gets a null component and links nothing. Rows that
repeat a doc_id keep their own row; other columns of ``documents`` are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import bounded_arrow, materialize, shuffle_parts
from .text import LOWER, U, Words, chunks, grams, mix

#: Signatures that a task sorts together.
PAIRS_SEGMENT = 1 << 18
#: Documents whose signatures, some hundreds each, go into one slice.
SLICE_DOCUMENTS = 1 << 12
#: Of a node's signatures, so many tell at which one a pair is compared.
LEAST_SIGNATURES = 16
SALT_ROWS = 256


class Bands:
    """Size bands for a similarity of ``percent`` / 100 and the cut of the domain for each."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * 100 // percent + 1)

    def of(self, n: int) -> int:
        return bisect_left(self.lows, n + 1) - 1

    @cache
    def cut(self, band: int) -> tuple[int, int, int, int]:
        """(parts, sub-parts, sub-parts left out, spare parts) for pairs of this band and the one below; parts 0: no pairs."""
        most, least = self.lows[band] * 100 // self.percent, self.lows[max(0, band - 1)]
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return 0, 1, 0, 0
        if k <= 3:
            return 1, k + 3, k, 0
        if k < 15:
            return -(-(k + 1) // 3), 5, 2, 0
        spare = 0
        while True:
            parts = k + 1 + spare
            empty = parts * math.exp(-least / parts)
            if spare >= empty + 1.65 * math.sqrt(empty) or spare > k:  # for low similarities no number is enough; further cuts do the rest
                return parts, 1, 0, spare
            spare += 1


@cache
def subsets(sub: int, out: int) -> np.ndarray:
    """Rows: which sub-parts stay."""
    return np.array([[j not in gone for j in range(sub)] for gone in combinations(range(sub), out)], dtype=U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a buffer."""
    w = Words(data, offsets, LOWER)
    g = grams(w.hash, n)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            short = U(b - a)
            with np.errstate(over="ignore"):
                for x in w.hash[a:b]:
                    short = mix(short * U(0x9E3779B97F4A7C15) + x)
            out.append(np.array([short], dtype=U))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit name of each set, as signed integers."""
    sums = [np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U) if len(s) else U(0) for s in sets]
    return mix(np.array(sums, dtype=U) + np.array([len(s) for s in sets], dtype=U)).view(np.int64)


def signatures(sets: list[np.ndarray], bands: Bands, levels: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) for all signatures of the sets."""
    who, sigs = [], []
    sizes = [len(s) for s in sets]
    jobs: dict[tuple, list[tuple[int, int]]] = {}
    for i, n in enumerate(sizes):
        if n:
            b = bands.of(n)
            for band in (b, b + 1):
                parts, sub, out, spare = bands.cut(band)
                if parts:
                    jobs.setdefault((0, sub, out), []).append((i, band))
    while jobs:
        (level, sub, out), todo = jobs.popitem()
        which = [i for i, _ in todo]
        cuts = [bands.cut(band) for _, band in todo]
        parts = np.array([c[0] for c in cuts])
        cells = parts * sub
        base = np.cumsum(cells) - cells
        flat, count = np.concatenate([sets[i] for i in which]), [sizes[i] for i in which]
        h = mix(flat + U((level + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        at = np.repeat(base, count) + ((h >> U(32)) % np.repeat(cells, count).astype(U)).astype(np.int64)
        total, filled = np.zeros(int(cells.sum()), dtype=U), np.bincount(at, minlength=int(cells.sum()))
        np.add.at(total, at, mix(flat ^ U(0x2545F4914F6CDD1D)))
        stay = subsets(sub, out)
        shown = (total.reshape(-1, sub) @ stay.T).ravel() if sub > 1 else total
        full = ((filled > 0).astype(U).reshape(-1, sub) @ stay.T).ravel() > 0 if sub > 1 else filled > 0
        each = parts * len(stay)
        owner = np.repeat(np.arange(len(todo)), each)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        band = np.array([b for _, b in todo], dtype=U)
        name = mix(band[owner] << U(40) | place.astype(U) | U(level) << U(56))
        empty = each - np.bincount(owner[full], minlength=len(todo))
        if level == levels:
            full[:] = True
        who.append(np.array(which)[owner[full]])
        sigs.append(mix(shown[full] ^ name[full]))
        for j in np.flatnonzero(empty > np.array([c[3] for c in cuts])) if level < levels else ():
            jobs.setdefault((level + 1, sub, out), []).append(todo[j])
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(who), np.concatenate(sigs)


def sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Parities of the shingles per bit, as 64-bit integers: two sketches differ in at most as many bits as the sets in shingles."""
    k = max(8, 2 * len(shingles) * (100 - percent) // (100 + percent))
    bits = 1 << max(8, (8 * k).bit_length())
    return np.packbits((np.bincount((shingles >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(bool)).view(np.int64)


def near(na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    """False only for sets that cannot be similar enough, by their sizes and sketches; where one sketch is twice as long, its halves are laid over each other."""
    over = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    half = lambda s: over(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")))
    few = lambda a, b: F.aggregate(over(a, b), F.lit(0), lambda t, x: t + F.bit_count(x)) * (100 + percent) <= (na + nb) * (100 - percent)
    a, b = F.size(sa), F.size(sb)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & F.when(a == b, few(sa, sb)).when(a == 2 * b, few(half(sa), sb)).when(2 * a == b, few(sa, half(sb))).otherwise(True)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    short, long = sorted((a, b), key=len)
    common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _shared(rows: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """(sig, rep, node): nodes that share a signature with the node ``rep``; ``n`` documents, by which slices are sized."""
    slices = max(4 * shuffle_parts(rows.sparkSession), n // SLICE_DOCUMENTS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for _, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, words)
            names = nodes_of(sets)
            _, first = np.unique(names, return_index=True)
            who, sigs = signatures([sets[i] for i in first], bands)
            order = np.argsort(sigs)
            sigs, held = sigs[order], names[first][who[order]]
            part = ((sigs >> U(32)) * U(slices) >> U(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(slices + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()) for x in (sigs, held))], ["slice", "sigs", "nodes"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        known, owner = np.zeros(0, U), np.zeros(0, np.int64)

        def fold():
            nonlocal known, owner, held, size
            sigs, nodes = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held, size = [], 0
            order = np.argsort(sigs, kind="stable")
            sigs, nodes = sigs[order], nodes[order]
            fresh, first = np.unique(sigs, return_index=True)
            rep = nodes[first]
            if len(known):
                j = np.minimum(np.searchsorted(known, fresh), len(known) - 1)
                old = known[j] == fresh
                rep = np.where(old, owner[j], rep)
                new = ~old
            else:
                new = np.ones(len(fresh), dtype=bool)
            reps = np.repeat(rep, np.diff(np.append(first, len(sigs))))
            other = reps != nodes
            merged = np.argsort(np.concatenate([known, fresh[new]]), kind="stable")
            known, owner = np.concatenate([known, fresh[new]])[merged], np.concatenate([owner, rep[new]])[merged]
            return pa.RecordBatch.from_arrays([pa.array(sigs[other].view(np.int64)), pa.array(reps[other]), pa.array(nodes[other])], ["sig", "rep", "node"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != at or size > PAIRS_SEGMENT:
                    if held:
                        yield fold()
                    if row["slice"] != at:
                        at, known, owner = row["slice"], np.zeros(0, U), np.zeros(0, np.int64)
                held.append((np.frombuffer(row["sigs"], dtype=U), np.frombuffer(row["nodes"], dtype=np.int64)))
                size += len(held[-1][0])
        if held:
            yield fold()

    sent = rows.select("text").mapInArrow(emit, "slice int, sigs binary, nodes binary")
    return sent.repartition(shuffle_parts(rows.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(match, "sig long, rep long, node long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. Rows of a hub ``a`` are split by salts of bounded size."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    members = salted.join(sets, salted["b"] == sets["node"]).select("a", "salt", F.lit(1).alias("side"), "b", "shingles")
    hubs = sizes.join(sets, sizes["a"] == sets["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("b"), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            out = []
            for a, salt, side, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = np.frombuffer(raw, dtype=U)
                if side == 0:
                    at, hub = (a, salt), shingles
                elif at == (a, salt) and linked(hub, shingles, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return members.union(hubs).repartition(shuffle_parts(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(check, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` once further links have merged components; a node without a label is its own."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    merged = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    ends = labels.union(new.select("node", F.col("node").alias("label")))
    return ends.join(merged.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))


def _least_signatures(sig: str) -> Column:
    """The least of the signatures of a group, which are those of one document, in order."""
    return F.slice(F.array_sort(F.collect_set(sig)), 1, LEAST_SIGNATURES)


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (doc_id, text, ...) without their text, with n_shingles, node and class; rows with a null doc_id are no links."""
    bounded_arrow(rows.sparkSession)
    own = [c for c in rows.columns if c != "text"]
    known = rows.where("doc_id IS NOT NULL")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes_of(sets)), pa.array([sketch(s, percent) for s in sets], pa.list_(pa.int64()))],
                [*own, "n_shingles", "node", "sketch"],
            )

    described = materialize(rows.mapInArrow(describe, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own) + ", n_shingles long, node long, sketch array<long>"), "sets")
    shared = materialize(_shared(known, words, percent, described.count()), "shared")
    nodes = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    met = shared.select("node").union(shared.select("rep")).distinct()
    nodes = materialize(nodes.join(met, "node"), "nodes")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, words)
            names = nodes_of(sets)
            mine = np.flatnonzero(names == batch.column("expected").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["node", "shingles"])

    wanted = nodes.select("doc_id", F.col("node").alias("expected"))
    sets = materialize(known.join(wanted, "doc_id").mapInArrow(shingles, "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    def possible(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(near(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)).select("a", "b")

    # Each node against the one with which it shares most signatures.
    ties = shared.groupBy("node", "rep").agg(F.count("*").alias("n"))
    first = ties.groupBy("node").agg(F.max_by("rep", F.struct("n", "rep")).alias("a")).select("a", F.col("node").alias("b"))
    links = materialize(_verified(materialize(possible(first), "pairs"), sets, percent), "links")
    labels = components(links)

    # What still joins several components. First the nodes of a signature against one of them, twice, so
    # that large classes in pieces come together; then all pairs that sizes and sketches leave possible.
    members = shared.select("sig", "node").union(shared.select("sig", "rep")).distinct()
    for turn in range(3):
        rows = members.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        several = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
        rows = materialize(rows.join(several, "sig"), "buckets")
        members = rows.select("sig", "node")
        lists = members.groupBy("node").agg(_least_signatures("sig").alias("least"))
        rows = materialize(rows.join(nodes.select("node", "n", "sketch").join(lists, "node"), "node"), "sketched")
        columns = ("node", "label", "n", "sketch", "least")
        a = rows.select("sig", *(F.col(c).alias(f"{c}_a") for c in columns))
        b = rows if turn == 2 else rows.groupBy("sig").agg(F.min_by(F.struct(*columns), F.xxhash64("node", F.lit(turn))).alias("r")).select("sig", "r.*")
        b = b.select(F.col("sig").alias("sig_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
        once = F.col("node_a") < F.col("node_b") if turn == 2 else F.lit(True)
        possible_ = (F.col("label_a") != F.col("label_b")) & once & near(*(F.col(f"{c}_{x}") for c in ("n", "sketch") for x in "ab"), percent)
        if turn == 2:
            possible_ &= ~F.exists(F.array_intersect("least_a", "least_b"), lambda x: x < F.col("sig"))  # else the pair meets at that signature
        met = a.join(b, (a["sig"] == b["sig_b"]) & possible_).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        more = materialize(_verified(materialize(met, "pairs"), sets, percent), "links")
        if not more.isEmpty():
            labels = materialize(_joined(labels, more), "labels")

    return described.drop("sketch").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    joined = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    joined = materialize(joined, "classes")
    # Written, so that the join below reads two plain shuffles and a very large class can be split.
    smallest = materialize(joined.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("smallest")), "smallest")
    return joined.join(smallest, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id"))).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, then node; of a null one only where the class has no other.

    A row is known by its doc_id and its text's hash, which also stands for a null doc_id. Rows without words stay.
    """
    names = ["__vellum_named", "__vellum_key", "__vellum_digest"]
    key, digest = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    named = docs.withColumns(dict(zip(names, (key.isNotNull(), F.coalesce(key, digest), digest), strict=True)))
    rows = named.select(F.col("__vellum_key").alias("doc_id"), F.col(text_col).alias("text"), F.col("__vellum_named").alias("named"), F.col("__vellum_digest").alias("digest"))
    members = _grouped(rows, words, percent).where("n_shingles > 0").groupBy("class", "named", "doc_id", "node", "digest").agg(F.count("*").alias("times"))
    members = materialize(members.withColumn("place", F.struct((~F.col("named")).alias("late"), "doc_id", "node", "digest")), "members")
    first = materialize(members.groupBy("class").agg(F.min("place").alias("first")), "first")
    stays = F.col("place") == F.col("first")
    verdicts = members.join(first, "class").where(~stays | (F.col("times") > 1)).select(*(F.col(c).alias(n) for n, c in zip(names, ("named", "doc_id", "digest"), strict=True)), stays.alias("__vellum_stays"))
    verdicts = materialize(verdicts, "verdicts")
    repeated = named.join(verdicts.where("__vellum_stays").select(names), names, "left_semi").dropDuplicates(names)
    return named.join(verdicts.select(names), names, "left_anti").union(repeated).select(docs.columns)
