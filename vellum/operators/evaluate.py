"""Evaluation: recall tallies with confidence intervals, over-redaction, word error rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.numbers import wilson


def phrase_position(tokens, phrase):
    """First position of a phrase among tokens, closing marks aside; null if it isn't there."""
    strip = lambda x: F.regexp_replace(x, r"[,.?!]+$", "")
    a, b = F.transform(tokens, strip), F.transform(phrase, strip)
    where = F.filter(F.sequence(F.lit(0), F.size(a) - F.size(b)), lambda i: F.slice(a, i + 1, F.size(b)) == b)
    return F.when(F.size(a) >= F.size(b), F.get(where, F.lit(0)))


def caught(cases: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, suite, category, phrase, position, caught): whether all words of each phrase were removed.

    ``removed`` has (session_id, word_id); a phrase that isn't in its text has no position and isn't caught.
    """
    phrases = cases.select("id", "suite", T.words(F.col("text")).alias("tokens"), F.posexplode("sensitive").alias("nr", "s"))
    phrases = phrases.select("id", "suite", "nr", F.col("s.category").alias("category"), F.col("s.phrase").alias("phrase"), F.size(T.words(F.col("s.phrase"))).alias("size"), phrase_position(F.col("tokens"), T.words(F.col("s.phrase"))).alias("position"))
    words = phrases.where("position IS NOT NULL").select("id", "nr", "size", F.explode(F.sequence(F.col("position").cast("long"), (F.col("position") + F.col("size") - 1).cast("long"))).alias("word_id"))
    gone = removed.select(F.col("session_id").alias("id"), "word_id").distinct()
    whole = words.join(gone, ["id", "word_id"], "left_semi").groupBy("id", "nr").agg(F.count("*").alias("n"))
    return phrases.join(whole, ["id", "nr"], "left").select("id", "suite", "category", "phrase", "position", (F.coalesce("n", F.lit(0)) == F.col("size")).alias("caught"))


def tallies(rows: DataFrame, by: Sequence[str], hit: str) -> DataFrame:
    """(dimension, value, caught, total, recall, low, high), one pass over all grouping sets."""
    grouped = rows.groupingSets([[c] for c in by], *by).agg(F.sum(F.col(hit).cast("long")).alias("caught"), F.count("*").alias("total"), F.grouping_id().alias("g"))
    last = len(by) - 1
    dimension = F.coalesce(*(F.when(F.col("g").bitwiseAND(1 << (last - k)) == 0, F.lit(c)) for k, c in enumerate(by)))
    low, high = wilson(F.col("caught"), F.col("total"))
    return grouped.select(dimension.alias("dimension"), F.coalesce(*(F.col(c).cast("string") for c in by)).alias("value"), "caught", "total", (F.col("caught") / F.greatest("total", F.lit(1))).alias("recall"), low.alias("low"), high.alias("high"))


def over_redaction(sessions: DataFrame) -> DataFrame:
    """(words, removed, fraction, refused) of benign sessions (n_words, n_removed, refused)."""
    words, gone = F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_removed"), F.lit(0))
    return sessions.agg(words.alias("words"), gone.alias("removed"), (gone / F.greatest(words, F.lit(1))).alias("fraction"), F.coalesce(F.sum(F.col("refused").cast("long")), F.lit(0)).alias("refused"))


def report(tallied: DataFrame, benign: DataFrame) -> DataFrame:
    """One row, one JSON document: the tallies by dimension and value, and the benign sessions."""
    rows = tallied.agg(F.array_sort(F.collect_list(F.struct("dimension", "value", "caught", "total", "recall", "low", "high"))).alias("tallies"))
    one = F.lit(1).alias("one")
    return rows.select("tallies", one).join(benign.select(*benign.columns, one), "one").select(F.to_json(F.struct("tallies", F.struct(*benign.columns).alias("benign"))).alias("report"))


def word_errors(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with edits and n_reference, over words in spoken form; of a pair with more than a million distinct words both are null."""
    # As columns of their own, so that they are worked out once and not for each word.
    rows = pairs.withColumns({"__a": T.spoken_words(F.col(reference)), "__b": T.spoken_words(F.col(hypothesis))})
    rows = rows.withColumn("__both", F.array_distinct(F.concat("__a", "__b")))
    return rows.withColumns({"edits": T.word_distance(F.col("__a"), F.col("__b"), F.col("__both")), "n_reference": F.size("__a")}).withColumn("n_reference", F.when(F.col("edits").isNotNull(), F.col("n_reference"))).drop("__a", "__b", "__both")


def word_error_rate(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", by: Sequence[str] = ()) -> DataFrame:
    """Edits over reference words, of all pairs together that can be measured; null without reference words."""
    rows = word_errors(pairs, reference, hypothesis)
    edits, n = F.coalesce(F.sum("edits"), F.lit(0)), F.coalesce(F.sum("n_reference"), F.lit(0))
    return rows.groupBy(*by).agg(edits.alias("edits"), n.alias("n_reference"), (edits / F.nullif(n, F.lit(0))).alias("wer"))
