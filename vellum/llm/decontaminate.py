"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are hashed, and each k-gram is named by the hash of its words. Of every window of w
consecutive k-grams the one of least hash is kept, the last of equal ones, so two texts that share a
span of k + w - 1 words keep a common k-gram there, and about 2 in w + 1 k-grams are kept. Kept k-grams of documents
that occur among the benchmark's kept ones are extended: each span of k + w - 1 words around one is
compared with the spans of the benchmark's items. With k + w - 1 = ``span`` every shared span of that
length is found. Items of fewer words than a span are looked up whole, at positions of their first
word.

The benchmark's tables are broadcast in blocks of at most ``block`` rows, one pass over the documents
per block; documents are not shuffled. Rows are known by doc_id and the hash of the text.

Defined cases: a null or empty text has no words and no hits; an item without words hits nothing. A
null doc_id is a document like any other. Repeated rows each keep their row. Without items nothing is
hit. Other columns of ``docs`` pass through ``clean_documents`` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z count as letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 7
ID, TEXT_HASH = "__vellum_id", "__vellum_hash"


def word_hashes(text: Column) -> Column:
    """The hash of each lower-cased word."""

    def folded(w: Column) -> Column:  # lower() folds more than A-Z, but not in ASCII words
        return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), ""), lambda w: F.xxhash64(folded(w)))


def _at(h: Column, i: Column | int, n: int) -> Column:
    """Hash of the n words from position i on."""
    return F.xxhash64(*(F.get(h, i + k) for k in range(n)))


def gram_hashes(h: Column) -> Column:
    """The hash of each k-gram, made once for each position."""
    return F.transform(F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - (GRAM - 1))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, GRAM))))


def _kept(g: Column, i: Column, x: Column, span: int) -> Column:
    """Whether some window of k-grams has its least hash at position i, where it is x; of equal ones the last."""
    w = span - GRAM + 1
    last = F.size(g) - w

    def leads(a: int) -> Column:  # the window that begins a k-grams before
        others = [x <= F.get(g, i + d) if d < 0 else x < F.get(g, i + d) for d in range(-a, w - a) if d]
        return reduce(lambda p, q: p & q, others, (i >= a) & (i - a <= last))

    return F.coalesce(reduce(lambda p, q: p | q, (leads(a) for a in range(w))), F.lit(False))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({ID: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), TEXT_HASH: F.xxhash64(F.col(text_col))})


def _blocks(table: DataFrame, by: str, rows: int, block: int) -> list[DataFrame]:
    n = -(-rows // block)
    return [table if n == 1 else table.where(F.pmod(F.xxhash64(F.lit("block"), by), F.lit(n)) == k) for k in range(n)]


def item_windows(benchmark: DataFrame, span: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of every item: item_id, start, length, first (hash of the first word), window (hash)."""
    h = F.col("h")
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), word_hashes(F.col(text_col)).alias("h")).where(F.size(h) > 0)
    long = items.where(F.size(h) >= span).select("item_id", "h", F.posexplode(h).alias("start", "first")).where(F.col("start") <= F.size(h) - span)
    short = items.where(F.size(h) < span)
    return long.select("item_id", "start", F.lit(span).alias("length"), "first", _at(h, F.col("start"), span).alias("window")).union(
        short.select("item_id", F.lit(0), F.size(h), F.get(h, F.lit(0)), F.xxhash64(h))
    )


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 10, block: int = 1_000_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(occurrences of item windows in keyed documents: key, start, length, window; the windows' items: length, window, item_id)."""
    h, g, i = F.col("h"), F.col("g"), F.col("i")
    windows = materialize(item_windows(benchmark, span, item_id, item_text), "windows")
    items = windows.select("length", "window", "item_id").distinct()
    long, short = windows.where(F.col("length") == span), windows.where(F.col("length") < span)
    bodies = benchmark.select(word_hashes(F.col(item_text)).alias("h")).where(F.size(h) >= span).select(gram_hashes(h).alias("g")).select("g", F.posexplode(g).alias("i", "print"))
    prints = materialize(bodies.where(_kept(g, i, F.col("print"), span)).select("print").distinct(), "prints")
    texts = docs.select(ID, TEXT_HASH, word_hashes(F.col(text_col)).alias("h"))

    found = []
    # The generator names both arrays, so that each is made once for a text and not once for each of its positions.
    both = F.when(F.size(h) >= span, g)
    places = texts.where(F.size(h) >= span).withColumn("g", gram_hashes(h)).select(ID, TEXT_HASH, "h", "g", F.posexplode(both).alias("i", "print"))
    kept = places.where(_kept(g, i, F.col("print"), span)).drop("g")
    for part in _blocks(prints, "print", prints.count(), block):
        met = kept.join(F.broadcast(part), "print").select(ID, TEXT_HASH, "h", F.explode(F.sequence(F.greatest(F.lit(0), i - (span - GRAM)), F.least(i, F.size(h) - span))).alias("start"))
        found.append(met.select(ID, TEXT_HASH, "start", F.lit(span).alias("length"), _at(h, F.col("start"), span).alias("window")))
    heads = short.select(F.col("first").alias("x"), "length", "window").distinct()
    n_heads = heads.count()
    for part in _blocks(heads, "x", n_heads, block) if n_heads else ():
        whole = F.xxhash64(F.slice(h, i + 1, F.col("length")))
        words = texts.where(F.size(h) > 0).select(ID, TEXT_HASH, "h", F.posexplode(h).alias("i", "x"))
        sizes = words.join(F.broadcast(part.select("x", "length").distinct()), "x").where(i + F.col("length") <= F.size(h))
        found.append(sizes.select(ID, TEXT_HASH, i.alias("start"), "length", whole.alias("window")))
    if not found:
        return docs.select(ID, TEXT_HASH, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("window")).where(F.lit(False)), items
    # Written before the check, so that a window which very many documents hold can be split in the join.
    spans = materialize(reduce(DataFrame.union, found).distinct(), "spans")
    return spans.join(materialize(windows.select("length", "window").distinct(), "known"), ["length", "window"], "left_semi"), items


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: its words, the hit ones, the items found with a digest of their list, and the verdict."""
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    found, of = hits(rows, benchmark, span, item_id=item_id, item_text=item_text)
    found = materialize(found, "hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["reach"], x["start"]))).alias("n"), F.greatest(s["reach"], x["stop"]).alias("reach")),
    )["n"]
    words = found.groupBy(ID, TEXT_HASH).agg(covered.cast("long").alias("n_hit"))
    names = F.array_sort(F.collect_set("item_id"))
    # A window that a document repeats meets its items once.
    items = found.select(ID, TEXT_HASH, "length", "window").distinct().join(of, ["length", "window"]).select(ID, TEXT_HASH, "item_id").distinct().groupBy(ID, TEXT_HASH).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return (
        rows.select("doc_id", ID, TEXT_HASH, n_words.alias("n_words")).join(words, [ID, TEXT_HASH], "left").join(items, [ID, TEXT_HASH], "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit."""
    rows = keyed(docs, id_col, text_col)
    found = hits(rows, benchmark, span, text_col=text_col, item_id=item_id, item_text=item_text)[0].select(ID, TEXT_HASH).distinct()
    return rows.join(materialize(found, "contaminated"), [ID, TEXT_HASH], "left_anti").drop(ID, TEXT_HASH)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), met AS (
  SELECT doc_id, dw.m, s, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
