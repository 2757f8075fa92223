"""Operators on documents against brute force, on awkward tables and on the small test table."""

import bisect
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.tables import PASSAGE, collected, documents, ordered, rows, small_documents
from vellum.llm import decontaminate, line_dedup, ngram_join, pattern_packing, ppm, quality_rules, queries, suffix_dedup
from vellum.llm.queries import tokenizer_path


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def case(request, spark, small):
    table = {"awkward": rows, "small": lambda: small_documents(spark, small), "empty": list}[request.param]()
    docs = documents(spark, table).cache()
    yield request.param, table, docs
    docs.unpersist()


def labels(spark, table, every=2):
    return spark.createDataFrame([(i, int(len(t or "") % 3 > 0), 0, "z") for i, t in table if i is not None and i % every == 0], "doc_id long, quality int, toxic int, score string")


def test_quality_counts(spark, case):
    _, table, docs = case
    out = quality_rules.score_documents(docs, labels(spark, table))
    assert collected(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == ordered([(i, *brute.quality_counts(t)) for i, t in table])
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    kept = quality_rules.filter_documents(docs, labels(spark, table))
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id") == collected(out.where("kept"), "doc_id")


def test_quality_without_labels(spark, case):
    kind, table, docs = case
    for some in () if kind == "small" else (labels(spark, table).where("false"), labels(spark, table).withColumn("quality", F.lit(None).cast("int")), labels(spark, table).withColumn("quality", F.lit(1))):
        out = quality_rules.score_documents(docs, some)
        assert all(r["kept"] != r["base_failed"] for r in out.collect())


def test_ngram_join(spark, case):
    kind, table, docs = case
    for words, percent in ((4, 85), (3, 50))[: 2 if kind == "awkward" else 1]:
        out = ngram_join.classes(docs, words, percent)
        assert collected(out, "doc_id", "n_shingles", "component_id") == ordered(brute.classes(table, words, percent))
    if kind == "small":
        return
    kept = ngram_join.keep_one(docs)
    expected = {r[0] for r in brute.classes(table, 5, 80) if r[0] == r[2]}
    assert {r["doc_id"] for r in kept.collect()} == expected
    assert kept.columns == docs.columns


def test_one_row_of_each_class_stays(spark):
    """Rows as multisets: a repeated smallest id, an id with two texts, copies with null ids."""
    a, b, c, d, e, f = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcdef")
    near = lambda t: t + " more"
    table = [(5, a), (7, near(a)), (3, b), (5, b), (None, c), (None, c), (9, c), (None, d), (None, near(d)), (None, d), (20, e), (20, e), (21, near(e)), (30, f), (30, ""), (None, ""), (None, ""), (None, None)]
    kept = collected(ngram_join.keep_one(documents(spark, table)), "doc_id", "text")
    either = [r for r in kept if r in ((None, d), (None, near(d)))]
    assert len(either) == 1
    assert kept == ordered([(5, a), (3, b), (9, c), (20, e), (30, f), (30, ""), (None, ""), (None, ""), (None, None), *either])


def test_line_dedup(spark, case):
    _, table, docs = case
    expected = brute.lines(table)
    assert collected(line_dedup.digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered([(i, n, d, brute.sha(t)) for i, n, d, t in expected])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert ordered([(r["doc_id"], r["text"] or "") for r in out.select("doc_id", "text").collect()]) == ordered([(i, t) for i, _, _, t in expected])


def test_line_dedup_with_full_filters(spark):
    table = rows()
    docs = documents(spark, table)
    assert collected(line_dedup.digest(docs, log2_bits=6), "doc_id", "n_dropped") == ordered([(i, d) for i, _, d, _ in brute.lines(table)])


def items(spark, table):
    texts = [t for _, t in table if t]
    some = [" ".join(t.split()[2:18]) for t in texts[:12]] + ["one", "nowhere to be found", "", None, "one TWO", PASSAGE, "--- !!", "same same same same same same same same same same same same"]
    return [(f"item-{k}", t) for k, t in enumerate(some)] + [("item-again", "one")]


def test_decontamination(spark, case):
    _, table, docs = case
    bench = items(spark, table)
    expected = brute.contamination(table, bench)
    frame = spark.createDataFrame(bench, "item_id string, text string")
    for block in (7,) if len(table) < 150 else ():
        rows_ = decontaminate.keyed(docs.select("doc_id", "text"), "doc_id", "text")
        hit = {r[decontaminate.ID] for r in decontaminate.hits(rows_, frame.limit(6), block=block)[0].select(decontaminate.ID).distinct().collect()}
        assert hit == {-(1 << 63) if i is None else i for i, _, n, *_ in brute.contamination(table, [tuple(r) for r in frame.limit(6).collect()]) if n}
    assert collected(decontaminate.contamination(docs, frame), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == ordered(expected)
    clean = decontaminate.clean_documents(docs, frame)
    assert clean.columns == docs.columns
    assert collected(clean, "doc_id") == ordered([(r[0],) for r in expected if not r[-1]])
    assert decontaminate.clean_documents(docs, frame.where("false")).count() == len(table)


def test_unigram_baseline(spark, case):
    kind, table, docs = case
    for tokens in (400_000, 3)[: 2 if kind == "awkward" else 1]:
        out = ppm.score_documents(docs, tokens=tokens)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
        got, expected = collected(out, *names), ordered(brute.unigram(table))
        assert [r[:-1] for r in got] == [r[:-1] for r in expected]
        assert all(math.isclose(a[-1], b[-1], rel_tol=1e-9) for a, b in zip(got, expected, strict=True))


def test_ppm_scores(spark):
    table = [(k, t and t[:300]) for k, (_, t) in enumerate(rows()) if k % 4 == 0] + [(900, None), (901, "")]
    model = brute.Ppm([t for i, t in table if not brute.held_out(i)], ppm.ORDER)
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(documents(spark, table)).collect()}
    for i, t in table:
        assert math.isclose(got[i], model.score(t), rel_tol=1e-4), i


def test_ppm_scores_keep_every_context(spark):
    """The number of grams that travel with the tasks changes nothing; nor does having nothing to learn from."""
    table = [(k, t and t[:300]) for k, (_, t) in enumerate(rows()) if k % 4 == 0] + [(900, None), (901, "")]
    for some in (table, [(i, t) for i, t in table if brute.held_out(i)]):
        model = brute.Ppm([t for i, t in some if not brute.held_out(i)], ppm.ORDER)
        got = {r["doc_id"]: r["score"] for r in ppm.score_documents(documents(spark, some), nodes=40).collect()}
        for i, t in some:
            assert math.isclose(got[i], model.score(t), rel_tol=1e-9), i


def test_ppm_is_a_distribution():
    """Probabilities of all next symbols sum to one, also where the trie has been cut."""
    rng = np.random.default_rng(3)
    text = rng.choice([1, 2, 3, 4, 9], 400).tolist() + [0]
    counts: dict = {}
    for cut in (0, 5):
        for i in range(len(text)):
            for n in range(ppm.ORDER + 1):
                c = ([0] * ppm.ORDER + text)[i : i + ppm.ORDER][ppm.ORDER - n :]
                counts.setdefault((n, *c), {}).setdefault(text[i], 0)
                counts[(n, *c)][text[i]] += 1
        kept = [(c[0], sum(s << 9 * k for k, s in enumerate([x, *c[:0:-1]])), 2 * k - 1) for c, d in counts.items() if c[0] <= 1 or sum(d.values()) >= cut for x, k in d.items()]
        trie = ppm.Trie(*(np.array(x, dtype=np.int64) for x in zip(*kept, strict=True)))
        trie.ready()
        for context in ([1, 2, 3, 4, 9], [0, 0, 0, 0, 0], [7, 7, 7, 7, 7], [9, 9, 1, 1, 2]):
            base = sum(s << 9 * (k + 1) for k, s in enumerate(context[::-1]))
            assert math.isclose((10 ** trie.log10(base + np.arange(257))).sum(), 1, rel_tol=1e-4)


def test_suffix_dedup(spark, case):
    kind, table, docs = case
    for length, most in ((400, 8000), (24, 3), (24, 1), (7, 1)) if kind == "awkward" else ((400, 8000), (400, 1)):
        got = collected(suffix_dedup.digest(docs, length, most=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        expected = [(i, n, r, s, brute.sha(left)) for (i, _), (n, r, s, left) in zip(table, brute.repeated_bytes([t for _, t in table], length), strict=True)]
        assert got == ordered(expected)


def expected_pieces(table, size=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for (i, _), e in zip(table, tokenizer.encode_batch([t or "" for _, t in table], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], dtype="<u4")
        out += [(i, k // size, k, min(size, len(ids) - k), zlib.crc32(ids[k : k + size].tobytes())) for k in range(0, len(ids), size)]
    return out


def test_packing(spark, case):
    kind, table, docs = case
    for size in (4096, 64)[: 2 if kind == "awkward" else 1]:
        out = pattern_packing.pack_documents(docs, tokenizer_path(), size)
        got = [tuple(r) for r in out.collect()]
        assert ordered([r[:5] for r in got]) == ordered(expected_pieces(table, size))
        held: dict = {}
        for r in got:
            held.setdefault(r[5], []).append((r[6], r[3]))
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        assert len(held) <= 1.03 * best_fit_decreasing([r[3] for r in got], size) + 1


def best_fit_decreasing(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, n)
        left = (room.pop(k) if k < len(room) else size) - n
        bisect.insort(room, left)
    return len(room)


def test_registered_queries_name_their_contracts():
    assert [x.split("_")[0] for x in queries.queries()] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_winnowing_keeps_the_least_gram_of_every_window(spark):
    """By hand over gram hashes: the last of equal ones, and about two in five."""
    span, k = 10, decontaminate.GRAM
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, n) % 50) for n in (5, 9, 10, 11, 400, 4000)] + ["the the " * 40]
    h, g = F.col("h"), F.col("g")
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", decontaminate.word_hashes(F.col("text")).alias("h")).select("n", decontaminate.gram_hashes(h).alias("g"))
    grams = {r["n"]: r["g"] for r in rows.collect()}
    kept = rows.select("n", "g", F.posexplode(g).alias("i", "x")).where(decontaminate._kept(g, F.col("i"), F.col("x"), span)).select("n", "i").collect()
    w = span - k + 1
    for n, values in grams.items():
        assert len(values) == max(0, len(texts[n].split()) - k + 1)
        expected = {max(range(a, a + w), key=lambda j: (-values[j], j)) for a in range(len(values) - w + 1)}
        assert {r["i"] for r in kept if r["n"] == n} == expected
    share = sum(r["n"] == 5 for r in kept) / len(grams[5])
    assert 0.3 < share < 0.5
