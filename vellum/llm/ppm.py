"""LM scoring by prediction by partial matching over bytes.

A text is modelled as its lower-cased words, one space between them, then an end symbol, so a score is
the probability of the token sequence. Contexts are up to ``ORDER`` symbols. A symbol not seen in a
context escapes (method D: each distinct symbol gives up half a count) to the next shorter one, where the symbols of the longer context are excluded; below the empty context all symbols not
yet excluded are equally likely. As every shorter context has seen what a longer one has, the
excluded set is always the last context's, and one denominator per context says it all.

Counting covers all training texts: tasks count their (context, symbol) grams, Spark sums them. No
gram is left out: the probability of each distinct gram of the documents, learned or only met in held-out
ones, is found once by joins with the tables of grams and contexts. Those that occur most (at most ``nodes``, down to a
threshold) travel with the tasks; rarer ones are added by a join. Likewise token counts down to a
threshold (at most ``tokens``) travel for the unigram baseline, and rarer tokens are counted by a
join, so both scores are exact whatever the thresholds.

Defined cases: a null or empty text is the end symbol alone. A null doc_id counts as the empty string
for the split. Repeated rows are scored each on its own, and learned from as often as they occur.
With nothing to learn from, all symbols are equally likely. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_arrow, materialize
from .text import LOWER, HashIndex, U, Words, chunks, mix

ORDER, BITS, SYMBOLS = 5, 9, 257
SPACE_SYMBOL, END = 33, 0
#: The end token among word hashes.
END_TOKEN = np.uint64(0x1D8E4E27C47D124F)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def symbols(data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Key of ORDER + 1 symbols for every symbol of every document, in order, and the documents' bounds in it."""
    docs, per_doc = len(offsets) - 1, np.diff(w.bounds)
    size = w.end - w.start
    empty = per_doc == 0
    before = np.cumsum(empty) - empty
    shift = ORDER * np.arange(1, docs + 1) + before
    own = w.owner()
    word_at = np.cumsum(size) - size + np.arange(len(size)) + shift[own]
    total = int(size.sum()) + len(size) + int(empty.sum()) + ORDER * docs
    out = np.zeros(total, dtype=np.int64)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + shift[own], size)
    out[at] = FOLD[data[w.inside]].astype(np.int64) + 1
    last = np.zeros(len(size), dtype=bool)
    last[w.bounds[1:][~empty] - 1] = True
    out[(word_at + size)[~last]] = SPACE_SYMBOL
    ends = np.zeros(docs, dtype=np.int64)
    ends[~empty] = (word_at + size)[last]
    inside = np.concatenate([[0], np.cumsum(size)])[w.bounds]
    ends[empty] = (inside[:-1] + w.bounds[:-1] + shift)[empty]
    keys = out.copy()
    for k in range(1, ORDER + 1):
        keys[k:] |= out[:-k] << (BITS * k)
    starts = np.concatenate([[0], ends[:-1] + 1])
    real = np.ones(total, dtype=bool)
    real[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return keys[real], np.concatenate([[0], np.cumsum(ends - starts + 1 - ORDER)])


def _tallied(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, or sums of weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Tally:
    """Counts of keys, merged now and then, let go when there are too many."""

    def __init__(self, merge: int = 1_000_000, most: int = 3_000_000):
        self.parts, self.size, self.merge, self.most = [], 0, merge, most

    def add(self, keys: np.ndarray) -> bool:
        """True when it is time to let the counts go."""
        self.parts.append(_tallied(keys))
        self.size += len(self.parts[-1][0])
        if self.size > self.merge and len(self.parts) > 1:
            self.parts = [self.result()]
            self.size = len(self.parts[0][0])
            self.merge = 2 * self.size
        return self.size > self.most

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return _tallied(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n): tokens (kind 0, by word hash) and grams (kind 1) over all texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Tally(), Tally()]

        def release(kind: int) -> pa.RecordBatch:
            keys, n = held[kind].result()
            held[kind] = Tally()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for _, data, offsets in chunks(batches):
            w = Words(data, offsets, LOWER)
            tokens = np.concatenate([w.hash, np.full(len(offsets) - 1, END_TOKEN)])
            for kind, keys in enumerate((tokens, symbols(data, offsets, w)[0])):
                if held[kind].add(keys):
                    yield release(kind)
        for kind in (0, 1):
            if held[kind].parts:
                yield release(kind)

    return texts.mapInArrow(tally, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _level(count: Column) -> Column:
    """Four levels to each doubling of a count."""
    return F.floor(4 * F.log2(count)).cast("int")


def _threshold(table: DataFrame, by: Column, most: int) -> int:
    """The least level that at most ``most`` rows reach."""
    bins = {r["b"]: r["n"] for r in table.groupBy(_level(by).alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 252 rows
    total, b = 0, max(bins, default=0) + 1
    while b > 0 and total + bins.get(b - 1, 0) <= most:
        b -= 1
        total += bins.get(b, 0)
    return b


def _named(gram: np.ndarray, order: np.ndarray | int) -> np.ndarray:
    """The 64-bit name of a gram, or context, of an order."""
    return mix(gram.astype(U) ^ mix(np.asarray(order, dtype=U) + U(101)))


def _low(n: int) -> np.int64:
    """A mask of the last n symbols."""
    return np.int64((1 << BITS * n) - 1)


def _finder(names: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Where each key is among the names, or -1; needs no more than their sorted copy."""
    arranged = np.argsort(names)
    ordered = names[arranged]

    def find(keys: np.ndarray) -> np.ndarray:
        if not len(ordered):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
        return np.where(ordered[at] == keys, arranged[at], -1)

    return find


class Trie:
    """The contexts and grams of a small model, as arrays (see ``log10``): in memory what ``probabilities`` finds by joins."""

    def __init__(self, order: np.ndarray, gram: np.ndarray, count: np.ndarray):
        arranged = np.lexsort((gram, order))
        order, gram, count = order[arranged], gram[arranged], count[arranged].astype(float)
        self.grams = _named(gram, order)
        context = gram >> BITS
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (order[1:] != order[:-1])])) if len(gram) else np.zeros(0, np.int64)
        self.contexts = _named(context[first], order[first])
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
        n, d = np.bincount(which, count, minlength=len(first)), np.bincount(which, minlength=len(first)).astype(float)
        self.empty = SYMBOLS - float(d[0]) if len(d) and order[0] == 0 else float(SYMBOLS)
        # The context one symbol shorter, and what the symbols seen here count there.
        masks = np.array([_low(n) for n in range(ORDER + 1)])
        up = order > 0
        there = np.zeros(len(gram))
        there[up] = count[_finder(self.grams)(_named(gram[up] & masks[order[up]], order[up] - 1))]
        o = order[first]
        deep = np.flatnonzero(o > 0)
        parent = _finder(self.contexts)(_named(context[first][deep] & masks[o[deep] - 1], o[deep] - 1))
        fresh, rest = np.full(len(first), self.empty), np.full(len(first), self.empty)
        excluded = np.bincount(which, there, minlength=len(first))
        fresh[deep] = d[parent] - d[deep]
        rest[deep] = n[parent] - excluded[deep] + fresh[deep]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.seen = np.log10(count / (n + d)[which]).astype(np.float32)  # a symbol in the longest known context
            self.counted = np.log10(count).astype(np.float32)
            self.escape = np.log10(d / (n + d)).astype(np.float32)  # leaving the longest known context
            self.rest = np.where(rest > 0, np.log10(rest), 0).astype(np.float32)  # the denominator one symbol shorter, without the symbols seen here
            self.escape_again = np.where(fresh > 0, np.log10(fresh / rest), np.where(rest > 0, -np.inf, 0)).astype(np.float32)

    def ready(self) -> None:
        """Builds the lookup tables, in the task."""
        self.of_gram, self.of_context = HashIndex(), HashIndex()
        self.of_gram.put(self.grams, np.arange(len(self.grams)))
        self.of_context.put(self.contexts, np.arange(len(self.contexts)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each key after the others."""
        out = np.zeros(len(keys))
        hit = self.of_gram.get(_named(keys, ORDER))
        out[hit >= 0] = self.seen[hit[hit >= 0]]
        open_ = np.flatnonzero(hit < 0)
        left = np.full(len(open_), -1)  # the context left last
        for order in range(ORDER, -1, -1):
            if not len(open_):
                break
            k = keys[open_]
            gram = k & _low(order + 1)
            context = self.of_context.get(_named(gram >> BITS, order))
            found = self.of_gram.get(_named(gram, order))
            known, again = context >= 0, left >= 0
            done = found >= 0
            out[open_[done & ~again]] += self.seen[found[done & ~again]]
            out[open_[done & again]] += self.counted[found[done & again]] - self.rest[left[done & again]]
            go = known & ~done
            out[open_[go & ~again]] += self.escape[context[go & ~again]]
            out[open_[go & again]] += self.escape_again[left[go & again]]
            left = np.where(go, context, left)[~done]
            open_ = open_[~done]
        out[open_] -= np.log10(self.empty)
        return out


def _masked(gram: Column, n: Column) -> Column:
    """The last n symbols of a gram, where n is a column."""
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (n * BITS).cast("int")) - 1)


def _levels(grams: DataFrame) -> DataFrame:
    """(order, gram, n): the grams (key, n) of all orders."""
    levels = None
    for order in range(ORDER + 1):
        cut = grams.select(F.lit(order).alias("order"), F.col("key").bitwiseAND((1 << BITS * (order + 1)) - 1).alias("gram"), "n")
        levels = cut if levels is None else levels.union(cut)
    return levels.groupBy("order", "gram").agg(F.sum("n").alias("n"))


def _contexts(levels: DataFrame) -> DataFrame:
    """(order, context, total, distinct, again, rest): what leaving a context, and the one before it, costs.

    ``rest`` is the denominator one symbol shorter without the symbols seen here, ``again`` the log10 of the
    share of it that escapes once more.
    """
    below = levels.select((F.col("order") + 1).alias("order"), F.col("gram").alias("suffix"), (2 * F.col("n") - 1).alias("there"))
    own = levels.withColumn("suffix", _masked(F.col("gram"), F.col("order"))).join(below, ["order", "suffix"], "left")
    totals = own.groupBy("order", F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("there").alias("excluded"))
    totals = materialize(totals, "totals")
    parent = totals.select((F.col("order") + 1).alias("order"), F.col("context").alias("parent"), F.col("total").alias("n"), F.col("distinct").alias("d"))
    deep = totals.where("order > 0").withColumn("parent", _masked(F.col("context"), F.col("order") - 1)).join(parent, ["order", "parent"])
    fresh = F.col("d") - F.col("distinct")
    deep = deep.withColumn("rest", 2 * F.col("n") - F.col("d") - F.col("excluded") + fresh)
    again = F.when(fresh > 0, F.log10(fresh / F.col("rest"))).otherwise(0.0)
    columns = ["order", "context", "total", "distinct", "again", "rest"]
    return deep.withColumn("again", again).select(columns).union(totals.where("order = 0").withColumns({"again": F.lit(0.0), "rest": F.lit(None).cast("long")}).select(columns))


def probabilities(learned: DataFrame, met: DataFrame) -> DataFrame:
    """(key, times, log10): each distinct gram of ``learned`` and ``met`` (key, n), how often it occurs and its probability by ``learned``."""
    both = learned.select("key", "n", F.col("n").alias("times")).union(met.select("key", F.lit(0).cast("long"), "n"))
    every = materialize(both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "keys")
    levels = materialize(_levels(learned), "levels")
    contexts = materialize(_contexts(levels), "contexts")
    whole = contexts.where(F.col("order") == ORDER).select("context", "total")
    seen = every.where("n > 0").withColumn("context", F.shiftright("key", BITS)).join(whole, "context")
    seen = seen.select("key", "times", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("log10"))

    # Grams never learned: their shorter forms against the tables. Orders 0 and 1 have at most SYMBOLS squared grams, so they are broadcast and no row of theirs is dealt by a hot context.
    cut = every.where("n = 0").select("key", "times", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order"))
    cut = cut.withColumn("gram", _masked(F.col("key"), F.col("order") + 1)).withColumn("context", F.shiftright("gram", BITS))
    parts = []
    for short in (True, False):
        some, small = F.col("order") <= 1 if short else F.col("order") > 1, F.broadcast if short else (lambda x: x)
        parts.append(cut.where(some).join(small(levels.where(some)), ["order", "gram"], "left").join(small(contexts.where(some)), ["order", "context"], "left").select("key", "times", "order", "n", "total", "distinct", "again", "rest"))
    found, left = F.col("n").isNotNull(), F.col("n").isNull() & F.col("total").isNotNull()  # orders that know the symbol; longer ones that know the context only
    at = F.col("order")
    folded = parts[0].union(parts[1]).groupBy("key").agg(
        F.first("times").alias("times"), F.max_by("n", F.when(found, at)).alias("n"), F.max_by("total", F.when(found, at)).alias("total"), F.max(F.when(at == 0, F.col("distinct"))).alias("symbols"),
        F.max_by(F.log10(F.col("distinct") / (2 * F.col("total"))), F.when(left, at)).alias("escape"), F.sum(F.when(left, F.col("again"))).alias("again"),
        F.min_by("again", F.when(left, at)).alias("last"), F.min_by("rest", F.when(left, at)).alias("rest"),
    )
    end = F.when(F.col("n").isNull(), -F.log10(SYMBOLS - F.coalesce("symbols", F.lit(0)))).when(F.col("escape").isNull(), F.log10((2 * F.col("n") - 1) / (2 * F.col("total")))).otherwise(F.log10((2 * F.col("n") - 1) / F.col("rest")))
    way = F.coalesce(F.col("escape") + F.col("again") - F.col("last"), F.lit(0.0))
    return materialize(seen.union(folded.select("key", "times", (way + end).alias("log10"))), "probabilities")


def score_documents(docs: DataFrame, nodes: int = 1_500_000, tokens: int = 400_000, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Per document: the split, token counts, the unigram baseline and the model's score."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    named = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (named % folds == fold).alias("held_out"))
    table = materialize(counts(rows.where(~F.col("held_out")).select("text")), "counts")
    words = table.where("kind = 0")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    least = _threshold(words, F.col("n"), tokens)
    common = words.where(_level(F.col("n")) >= least).select("key", "n").toArrow()  # at most ``tokens`` rows
    met = materialize(counts(rows.where("held_out").select("text")).where("kind = 1").select("key", "n"), "met")
    known = probabilities(table.where("kind = 1").select("key", "n"), met)
    often = _threshold(known, F.col("times"), nodes)
    frequent = known.where(_level(F.col("times")) >= often).select("key", "log10").toArrow()  # at most ``nodes`` rows
    order = np.argsort(frequent["key"].to_numpy())
    # In order, and a key greater than all grams behind: tasks search in it and build no table.
    frequent = np.append(frequent["key"].to_numpy()[order], np.int64(1) << np.int64(62)), np.append(frequent["log10"].to_numpy()[order], 0.0)
    model = spark.sparkContext.broadcast((*frequent, common["key"].to_numpy().astype(np.int64).view(U), common["n"].to_numpy().astype(np.int64)))
    base = np.log10(total + distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol_keys, symbol_logs, keys, n = model.value
        index = HashIndex()
        index.put(keys, np.arange(len(keys)))
        logs = np.append(np.log10(n + 1.0), 0.0)
        for batch, data, offsets in chunks(batches):
            w = Words(data, offsets, LOWER)
            keyed, bounds = symbols(data, offsets, w)
            hit = np.searchsorted(symbol_keys, keyed)
            absent = symbol_keys[hit] != keyed
            hit[absent] = len(symbol_keys) - 1
            sums = np.concatenate([[0], np.cumsum(symbol_logs[hit])])
            del hit
            rare_grams = np.split(keyed[absent], np.concatenate([[0], np.cumsum(absent)])[bounds[1:-1]])
            at = index.get(np.append(w.hash, END_TOKEN))
            known = np.concatenate([[0], np.cumsum(at[:-1] >= 0)])
            part = np.concatenate([[0], np.cumsum(logs[at[:-1]])])
            n_tokens = np.diff(w.bounds) + 1
            rare = [np.zeros(0, np.int64)] * len(n_tokens)
            if distinct > len(keys):
                unknown = at[:-1] < 0
                rare = np.split(w.hash[unknown].view(np.int64), np.concatenate([[0], np.cumsum(unknown)])[w.bounds[1:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens.astype(np.int64)), pa.array(np.diff(known[w.bounds]) + int(at[-1] >= 0)),
                    pa.array(np.diff(part[w.bounds]) + logs[at[-1]] - n_tokens * base), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(rare, pa.list_(pa.int64())),
                    pa.array(rare_grams, pa.list_(pa.int64())),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "rare_grams"],
            )

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, rare_grams array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    uncommon = words.where(_level(F.col("n")) < least).select("key", "n")
    found = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")).join(uncommon, "key")
    more = found.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    unlikely = known.where(_level(F.col("times")) < often).select("key", "log10")
    further = scored.select("row", F.explode("rare_grams").alias("key")).join(unlikely, "key").groupBy("row").agg(F.sum("log10").alias("further"))
    return scored.join(more, "row", "left").join(further, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("further", F.lit(0.0))).alias("score"),
    )
