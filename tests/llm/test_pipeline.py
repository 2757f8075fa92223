"""The pipeline's stages one after the other against brute force, on the small documents."""

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.tables import documents, rows, small_documents
from tests.llm.test_documents import expected_pieces


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, small, stages):
    start = dict(small_documents(spark, small))
    quality, lines, near, clean, packed = stages
    kept = texts(quality)
    assert kept.items() <= start.items()
    assert not any(brute.quality_counts(t)[-1] for t in kept.values())
    after = texts(lines)
    assert after == {i: t for i, _, _, t in brute.lines(list(kept.items()))}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    once = texts(near)
    assert once == {i: after[i] for i, _, c in brute.classes(list(after.items()), 5, 80) if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = texts(clean)
    assert left == {r[0]: once[r[0]] for r in brute.contamination(list(once.items()), items) if not r[-1]}
    assert sorted(tuple(r)[:5] for r in packed.collect()) == sorted(expected_pieces(list(left.items()), 4096))
    for df in stages[:4]:
        assert df.columns == spark.read.parquet(f"{small}/documents.parquet").columns


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "pattern_packing"]


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_awkward_and_empty_tables(spark, tmp_path, kind):
    """Null ids, texts and columns, repeated rows, clashing names: every stage passes on whole rows, and packing places what it gets."""
    table = rows() if kind == "awkward" else []
    docs = documents(spark, table).select("doc_id", "text", "lang", "source", "n_chars", "node")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(len(t or "") % 3 > 0), 0) for i, t in table if i is not None and i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "passage3x3 passage4x4 passage5x5 passage6x6 passage7x7 passage8x8 passage9x9 passage10x10 passage11x11 passage12x12"), (None, None), (2, "")] if table else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, last = docs, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "pattern_packing":
            last = after
            break
        assert after.columns == docs.columns
        if name not in ("line_dedup",):  # rows go or stay as they are
            assert after.exceptAll(before).count() == 0
        else:
            assert after.count() == before.count()
        before = after
    left = [(r["doc_id"], r["text"]) for r in before.collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in last.collect()), key=key) == sorted(expected_pieces(left, 4096), key=key)
    assert bool(left) == bool(table)
