"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key.

A shard is some hundred thousand consecutive words of a task. Its word ids are sorted into a suffix
array by prefix doubling (ranks of one word, of two, of four, of the longest phrase), the LCP array
tells how many words neighbours share, and each LCP interval of at least m words is one phrase of m
words with its count in the shard. Counts of shards are added by key.

Only phrases that can be frequent are counted. A phrase occurs at most as often as any phrase within
it, so passes over the texts go from short to long: words, pairs of frequent words, triples of frequent
pairs, then everything whose triples are frequent. Between passes travels a bit filter of what was
frequent, of at most 2^``log2_bits`` bits: it never misses a frequent phrase, and what it lets through
by chance only costs a row, since the last pass adds counts of whole word-id keys and compares them with
the threshold. With more frequent phrases than bits it prunes less and the result is the same.

Word ids are 64-bit hashes of the lower-cased bytes. The table of all distinct words shows whether two
words of a language share an id; if so, everything is counted again under another hash.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each
time; a table without frequent phrases gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_arrow, materialize
from .text import U, Words, byte_values, chunks, folded, grams, mix

#: Bytes that end a piece: .,;:!? and line ends. Blanks and tabs part words.
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
SHARD_WORDS = 1 << 19
LOG2_BITS = 27
TEXT_BYTES = 1 << 20
#: Rows of phrases that a task holds to add up over its shards.
HELD_ROWS = 1 << 19


class Shard:
    """Words of some texts: hash, language code, and how many words follow without a break, at most ``depth``."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, ends: np.ndarray, names: list[str]):
        """``ends``: whether a piece ends after the word. ``names``: the languages by code."""
        self.hash, self.code, self.ends, self.names = hashes, codes, ends, names
        self.salt = mix(np.array([hash_name(x) for x in names], dtype=U))[codes] if len(names) else np.zeros(0, dtype=U)

    def key(self, m: int) -> np.ndarray:
        """A 64-bit name of the m words from each position on, by language; for filters and pruning only."""
        return mix(grams(self.hash, m) + self.salt[: max(0, len(self.hash) - m + 1)])

    def runs(self, depth: int, words: "Filter | None", pairs: "Filter | None", triples: "Filter | None") -> np.ndarray:
        """The most words that a countable phrase from each position on can have: rare words count nothing, breaks and rare pairs end it, and so do rare triples."""
        n = len(self.hash)
        good = words.has(self.key(1)) if words else np.ones(n, dtype=bool)
        joined = np.zeros(n, dtype=bool)  # to the next word
        joined[:-1] = ~self.ends[:-1] & good[:-1] & good[1:]
        if pairs:
            joined[:-1] &= pairs.has(self.key(2))
        run = good.astype(np.int8)
        if not triples:
            for _ in range(depth - 1):
                run[:-1] = np.where(joined[:-1], np.minimum(run[1:] + 1, depth), run[:-1])
            return run
        run[joined] = 2
        both = np.zeros(n, dtype=bool)
        both[:-2] = joined[:-2] & joined[1:-1] & triples.has(self.key(3))
        for _ in range(depth - 2):
            run[:-1] = np.where(both[:-1], np.minimum(run[1:] + 1, depth), run[:-1])
        return run


def hash_name(name: str) -> int:
    """A number for a language's name, alike in all tasks."""
    return int.from_bytes(name.encode()[:7], "little") * 1_000_003 % (1 << 63) + sum((k + 1) * b for k, b in enumerate(name.encode()))


class Filter:
    """A bit for each 64-bit key by its leading bits."""

    def __init__(self, log2_bits: int, slots: np.ndarray, bits: np.ndarray):
        self.shift = U(64 - log2_bits)
        self.words = np.zeros(1 << (log2_bits - 6), dtype=U)
        self.words[slots] = bits.view(U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.words[at >> U(6)] >> (at & U(63))) & U(1) == U(1)


def build_filter(keys: DataFrame, log2_bits: int) -> Filter:
    """Of a table with the column ``key``: sixteen bits a key, at most 2^``log2_bits``. The driver gets its words, not the keys."""
    bits = min(log2_bits, max(12, (16 * keys.count()).bit_length()))
    at = F.expr(f"shiftrightunsigned(key, {64 - bits})")
    words = keys.select(F.shiftright(at, 6).alias("slot"), at.alias("at")).groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    return Filter(bits, words["slot"].to_numpy(), words["bits"].to_numpy())


def suffix_array(hashes: np.ndarray, codes: np.ndarray, run: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their first ``depth`` words, LCP with the one before), for positions with a run."""
    n = len(hashes)
    word = np.unique(hashes, return_inverse=True)[1] * np.int64(int(codes.max(initial=0)) + 1) + codes
    one = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
    rank, h = np.where(run > 0, one, 0), 1
    while h < depth:
        step = min(h, depth - h)  # an overlap where the depth is no power of two
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = np.where(run[: n - step] > step, rank[step:], 0)
        pair = rank * np.int64(int(rank.max(initial=0)) + 1) + later
        rank, h = np.unique(pair, return_inverse=True)[1].astype(np.int64), h + step
    order = np.flatnonzero(run > 0)
    order = order[np.argsort(rank[order], kind="stable")]
    lcp, alive = np.zeros(len(order), dtype=np.int8), np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(depth):
        a, b = np.minimum(order[:-1] + k, n - 1), np.minimum(order[1:] + k, n - 1)
        alive &= (run[order[:-1]] > k) & (run[order[1:]] > k) & (one[a] == one[b])
        lcp[1:] += alive
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, run: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, count) of each phrase of m words: the LCP intervals of at least m."""
    first = np.flatnonzero(lcp < m)
    count = np.diff(np.append(first, len(order)))
    long = run[order[first]] >= m
    return order[first[long]], count[long]


def shards(batches: Iterator[pa.RecordBatch], values: np.ndarray, most: int = SHARD_WORDS) -> Iterator[Shard]:
    """Shards of about ``most`` words over batches of (lang, text)."""
    held, names, size = [], {}, 0

    def release() -> Shard:
        hashes, codes, ends = (np.concatenate([x[k] for x in held]) for k in range(3))
        return Shard(hashes, codes, ends, list(names))  # codes are the task's, alike in all its shards

    for batch, data, offsets in chunks(batches, limit=TEXT_BYTES):
        words = word_table(data, offsets, values)
        langs = batch.column("lang").to_pylist()
        codes = np.array([names.setdefault(x, len(names)) for x in langs], dtype=np.int64)
        held.append((words.hash, codes[words.owner()], piece_ends(words, data)))
        size += len(words.hash)
        if size >= most:
            yield release()
            held, size = [], 0
    if size:
        yield release()


def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows of (key columns ..., count) of several tables, the counts of equal keys added."""
    *keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort(keys[::-1])
    keys, n = [x[order] for x in keys], n[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    first = np.flatnonzero(new)
    return [*(x[first] for x in keys), np.add.reduceat(n, first) if len(n) else n]


def word_table(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> Words:
    return Words(np.where(PIECE_END[data], np.uint8(10), data), offsets, values)


def piece_ends(words: Words, data: np.ndarray) -> np.ndarray:
    """Whether a piece or text ends between each word and the next."""
    seen = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(PIECE_END[data], out=seen[1:])
    out = np.ones(len(words.start), dtype=bool)
    out[:-1] = seen[words.start[1:]] > seen[words.end[:-1]]
    last = words.bounds[1:] - 1
    out[last[last >= 0]] = True
    return out


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased byte spans as one column."""
    size = end - start
    to = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=to[1:])
    at = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    out = data[at]
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to.tobytes()), pa.py_buffer(out.tobytes()))


def word_counts(docs: DataFrame, values: np.ndarray) -> DataFrame:
    """(lang, word, id, key, n) over (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, limit=TEXT_BYTES):
            words = word_table(data, offsets, values)
            if not len(words.hash):
                continue
            langs = batch.column("lang").to_pylist()
            names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            codes = np.array([names[x] for x in langs], dtype=np.int64)[words.owner()]
            distinct, which = np.unique(words.hash, return_inverse=True)
            _, first, n = np.unique(which * np.int64(len(names)) + codes, return_index=True, return_counts=True)
            shard = Shard(words.hash[first], codes[first], np.ones(len(first), dtype=bool), list(names))
            lang = pa.DictionaryArray.from_arrays(pa.array(codes[first].astype(np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
            columns = [lang, _strings(data, words.start[first], words.end[first]), pa.array(shard.hash.view(np.int64)), pa.array(shard.key(1).view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "id", "key", "n"])

    return docs.mapInArrow(count, "lang string, word string, id long, key long, n long").groupBy("lang", "word", "id", "key").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, log2_bits: int = LOG2_BITS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words: lang, word, id, n; phrases: lang, ids, n) - all words, and the phrases of 2 to ``longest`` words found ``least`` times or more."""
    bounded_arrow(docs.sparkSession)
    seed = 1
    while True:
        values = folded(byte_values(seed))
        words = materialize(word_counts(docs, values), "words")
        if words.groupBy("lang", "id").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words share an id: take another hash
    spark = docs.sparkSession
    filters: list[Filter] = [build_filter(words.where(F.col("n") >= least), log2_bits)]
    for m in range(2, min(3, longest - 1) + 1):
        passed = spark.sparkContext.broadcast(filters)

        def count(batches: Iterator[pa.RecordBatch], m: int = m, passed=passed) -> Iterator[pa.RecordBatch]:
            frequent = [*passed.value, None, None]
            for shard in shards(batches, values, shard_words):
                run = shard.runs(m, frequent[0], frequent[1], None)
                at, n = intervals(*suffix_array(shard.hash, shard.code, run, m), run, m)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.key(m)[at].view(np.int64)), pa.array(n)], ["key", "n"])

        kept = materialize(docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "frequent")
        filters = [*filters, build_filter(kept, log2_bits)]
    passed = spark.sparkContext.broadcast(filters)
    ids = [f"w{k}" for k in range(longest)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, names = [*passed.value, None, None], []
        held: dict[int, list[list[np.ndarray]]] = {m: [] for m in range(2, longest + 1)}
        size = 0

        def release() -> Iterator[pa.RecordBatch]:
            for m, parts in held.items():
                if parts:
                    code, *keys, n = added(parts)
                    lang = pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                    columns = [pa.array(x.view(np.int64)) for x in keys] + [pa.nulls(len(n), pa.int64())] * (longest - m)
                    yield pa.RecordBatch.from_arrays([lang, *columns, pa.array(n)], ["lang", *ids, "n"])
                parts.clear()

        for shard in shards(batches, values, shard_words):
            names = shard.names
            run = shard.runs(longest, *frequent[:3])
            order, lcp = suffix_array(shard.hash, shard.code, run, longest)
            for m, parts in held.items():
                at, n = intervals(order, lcp, run, m)
                parts.append([shard.code[at], *(shard.hash[at + k] for k in range(m)), n])
                size += len(at)
            if size > HELD_ROWS:  # equal phrases of the task's shards become one row
                held = {m: [added(parts)] for m, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD_ROWS // 2:
                    yield from release()
                    size = 0
        yield from release()

    found = docs.mapInArrow(gather, f"lang string, {', '.join(f'{x} long' for x in ids)}, n long").groupBy("lang", *ids).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrases = materialize(found.select("lang", F.filter(F.array(*ids), lambda x: x.isNotNull()).alias("ids"), "n"), "phrases")
    return words.select("lang", "word", "id", "n"), phrases


def scored(words: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """(lang, ids, a, l, r, n, score): each phrase by its weakest cut, without those that a longer one as frequent holds."""
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = phrases.select("lang", "ids", F.col("n").alias("f")).union(words.where(F.col("n") >= least).select("lang", F.array("id").alias("ids"), F.col("n").alias("f")))
    # A longer phrase that is as frequent has one word more or holds one that is and has: so one word more is enough.
    inner = F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)")))
    within = phrases.where(F.size("ids") > 2).select("lang", inner.alias("ids"), F.col("n").alias("f")).groupBy("lang", "ids").agg(F.max("f").alias("f"))
    kept = phrases.withColumnRenamed("n", "a").join(within, ["lang", "ids"], "left").where("f IS NULL OR f < a").select("lang", "ids", "a")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).select("*", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("ids").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("ids").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(n, "lang")
    score = F.expr("CAST((CAST(a AS decimal(16,0)) * CAST(1000 * CAST(n AS decimal(16,0)) AS decimal(20,0))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0))) AS long)")
    return cuts.select("lang", "ids", "a", "n", "k", "l", "r", score.alias("score")).groupBy("lang", "ids").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text", log2_bits: int = LOG2_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, phrases = phrase_counts(docs, least, longest, log2_bits, shard_words)
    best = "PARTITION BY lang ORDER BY score DESC, a DESC"
    # Ties of the last place are kept until the words are there to order them.
    near = materialize(scored(words, phrases, least).withColumn("place", F.expr(f"rank() OVER ({best})")).where(F.col("place") <= top).drop("place"), "best")
    spelled = near.select("lang", "ids", F.posexplode("ids").alias("k", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = near.join(spelled, ["lang", "ids"])
    return named.withColumn("rank", F.expr(f"row_number() OVER ({best}, phrase)").cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(words) - m + 2), lambda i: words[i:i + m - 1])))) AS x FROM w WHERE len(words) > 0),
f AS (SELECT lang, x, count(*) AS a FROM g GROUP BY lang, x),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE len(x) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(x) > 1 AND a >= 100),
inside AS (SELECT DISTINCT s.lang, s.x FROM c AS s JOIN c AS b ON s.lang = b.lang AND len(b.x) > len(s.x) AND 100 * b.a >= 100 * s.a AND contains(' ' || array_to_string(b.x, ' ') || ' ', ' ' || array_to_string(s.x, ' ') || ' ')),
cut AS (
  SELECT c.lang, c.x, c.a, k, l.a AS l, r.a AS r, n.n, (1000 * c.a::HUGEINT * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(x))) AS k FROM c WHERE (lang, x) NOT IN (SELECT (lang, x) FROM inside)) AS c JOIN f AS l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN f AS r ON r.lang = c.lang AND r.x = c.x[k + 1:] JOIN n ON n.lang = c.lang
),
least AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(x, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
