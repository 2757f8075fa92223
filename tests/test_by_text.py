"""Removal of texts as one row each: against the operators on rows of words, against SQL on odd texts, and without words in a shuffle or a file."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum import plans
from vellum.functions import text as T
from vellum.operators import by_text, intervals, removal
from vellum.sources import transcripts as source

QUERIES, SQL = plans.queries(), plans.oracle_sql()
REMOVALS = ("removal_plan", "removed_words", "retained_words_by_language", "retained_clips", "training_copies")


def test_as_the_operators_on_rows_say(spark):
    draw = random.Random(7)
    texts = [(i, " ".join(draw.choice(("a", "b.", "c", "dd", "e?", "f", "g", "h!")) for _ in range(draw.choice((1, 2, 3, 9, 40))))) for i in range(120)]
    spans = [(i, a := draw.randrange(len(t.split())), min(len(t.split()), a + draw.randrange(0, 4))) for i, t in texts for _ in range(draw.choice((0, 0, 1, 3)))]
    doubtful = [(i, draw.randrange(len(t.split()))) for i, t in texts if i % 5 == 0]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    listed = [(i, [{"start": a, "stop": b} for k, a, b in spans if k == i], [w for k, w in doubtful if k == i]) for i, _ in texts]
    found = docs.join(spark.createDataFrame(listed, "doc_id long, spans array<struct<start:long,stop:long>>, doubtful array<long>"), "doc_id").withColumn("display", T.words(F.col("text")))
    got = by_text.planned(found.select("doc_id", F.size("display").alias("n_words"), by_text.stops(F.col("display")).alias("stops"), "spans", "doubtful")).collect()

    unsure = spark.createDataFrame(doubtful, "session_id long, word_id long").distinct().withColumn("unsure", F.lit(True))
    words = removal.with_sentences(source.timed_words(docs)).join(unsure, ["session_id", "word_id"], "left").withColumn("confidence", F.when(F.col("unsure"), 0.1).otherwise(0.9).cast("float")).drop("unsure").localCheckpoint()
    bounds = source.session_ends(words)
    dropped = removal.touched_sentences(words, spark.createDataFrame(spans, "session_id long, start long, stop long")).union(removal.unusable_sentences(words)).distinct().localCheckpoint()
    marked = removal.removed_words(words, dropped, bounds).localCheckpoint()
    cuts = removal.removed_intervals(marked, dropped, bounds).localCheckpoint()
    clips = removal.clips(marked, intervals.complement(cuts, bounds, ["session_id"]))
    assert {r["doc_id"]: r["n_removed"] for r in got} == {r[0]: r[1] for r in marked.groupBy("session_id").agg(F.count_if("removed")).collect()}
    assert sorted((r["doc_id"], *c) for r in got for c in r["cuts"]) == sorted(tuple(r) for r in cuts.select("session_id", "start", "end").collect())
    assert sorted((r["doc_id"], c["start"], c["end"], c["words"]) for r in got for c in r["clips"]) == sorted(tuple(r) for r in clips.select("session_id", "start", "end", "word_count").collect())


def test_cuts_that_meet_and_words_far_apart():
    """Times that the rule never makes: gaps within a sentence on both sides of the padding, cuts that abut, one at either end."""
    import numpy as np

    start = np.array([100, 1500, 7000, 20_000, 28_000])
    end = start + 1000
    removed, s, e = by_text.cut(start, end, np.array([0, 1, 1, 2, 3]), np.array([True, False, True, True]), 29_500, 4000)
    assert removed.tolist() == [True, True, False, True, True]
    assert (s.tolist(), e.tolist()) == ([0, 16_000], [6500, 29_500])


ODD = (
    (1, "en", None), (2, "en", ""), (3, "en", " 　\n "), (4, "en", "one word."), (None, "en", "mail a@example.com to me. And this is kept for long enough."), (5, None, "fine words that stay here for a while"),
    (6, "en", "mail a@example.com to me. And this is kept for long enough, ten words or so. 10.0.0.1"), (7, "en", "And this is kept for long enough, ten words or so. " * 60), (8, "en", "And this is kept for long enough, ten words or so. " * 60),
    (-31, "en", "negative ids have doubtful words too. " * 300), (1 << 55, "en", "large ids as well. " * 300), (9, "fi", "x. " * 50 + "y@example.org. " * 50),
)


@pytest.mark.parametrize("name", REMOVALS)
def test_odd_texts_against_sql(spark, tmp_path, name):
    """A text without an id has no clips, one without words no row; large and negative ids have their doubtful words."""
    rows = [r for r in ODD if r[0] is not None or name != "training_copies"]  # without an id there is no training copy
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(found, key=repr)


@pytest.mark.parametrize("name", [f"{p}{n}" for n in REMOVALS[:-1] for p in ("", "full_")])
def test_no_word_is_shuffled_or_stored(spark, small, name):
    """A session's cuts come from its own row: no window, no step in a file, and no exchange but of counts by id or language."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "step-" not in plan
    assert ("Exchange" in plan) == ("words" in name)
    assert not any("display" in line or "text" in line for line in plan.splitlines() if "Exchange" in line)


def test_training_copies_meet_by_their_id(spark, small):
    """No exchange deals sessions by their content, of which many may have the same or none; only counted ones are."""
    QUERIES["training_copies"](spark, small).createOrReplaceTempView("copies")
    plan = spark.table("copies")._jdf.queryExecution().executedPlan().toString()
    assert "[content_hash" not in "".join(line for line in plan.splitlines() if "Join" in line)
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), (" \u3000\n\u0085",), (" .",), ("\u2007x",)], "t string").select(T.any_word(F.col("t"))).collect()] == [False, False, False, True, True]
