"""Texts of megabytes through every operator on documents."""

import random

import pytest

from tests.llm import brute
from vellum.llm import collocations, decontaminate, line_dedup, ngram_join, pattern_packing, ppm, quality_rules, source_mixing, suffix_dedup
from vellum.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(4000)] + ["Über", "日本語", "the", "of"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(12_000)]
    first = "\n".join(lines)
    second = "\n".join([*lines[:11_900], *(f"other line {k} of its own {rng.random()}" for k in range(100))])
    table = [(1, first), (2, second), (3, "x" * 2_000_000), (4, "short one"), (5, None)]
    assert len(first.encode()) > 1 << 20
    return table, spark.createDataFrame(table, "doc_id long, text string").cache(), lines


def test_long_texts(spark, long):
    table, docs, lines = long
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    counts = {r["doc_id"]: r for r in quality_rules.score_documents(docs, labels).collect()}
    for i, t in table:
        assert tuple(counts[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == tuple(brute.quality_counts(t))
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs, 4, 85).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.digest(docs, min_docs=2).collect()} == {(i, n, d) for i, n, d, _ in brute.lines(table, 2)}
    items = spark.createDataFrame([(7, " ".join(" ".join(lines[6000:6003]).split()[:12]))], "item_id long, text string")
    hit = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(docs, items).collect()}
    assert hit == {1: True, 2: True, 3: False, 4: False, 5: False}
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(docs).collect()}
    shared = len("\n".join(lines[:11_900]).encode()) + 1  # and the line feed after it
    assert cut[3] == (2_000_000, 2_000_000) and abs(cut[1][1] - shared) < 20 and abs(cut[2][1] - shared) < 20 and cut[4][1] == cut[5][1] == 0


def test_long_texts_by_tokens(spark, long):
    table, docs, _ = long
    scores = {r["doc_id"]: r for r in ppm.score_documents(docs).collect()}
    assert all(scores[i]["n_tokens"] == len((t or "").split()) + 1 and scores[i]["score"] < 0 for i, t in table)
    pieces = pattern_packing.pack_documents(docs.where("doc_id <> 3"), tokenizer_path()).collect()
    assert all(r["length"] == 4096 for r in pieces if r["doc_id"] == 1 and r["start"] + 4096 <= max(x["start"] for x in pieces if x["doc_id"] == 1))
    mixed = source_mixing.mix(docs.selectExpr("*", "'s' AS source")).collect()
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) < 1
    found = collocations.mine(docs.selectExpr("*", "'en' AS lang"), least=40).collect()
    assert all(r["a"] >= 40 and len(r["phrase"].split(" ")) >= 2 for r in found)
