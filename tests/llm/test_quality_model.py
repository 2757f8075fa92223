"""The boosted trees: monotone, and better than chance on labels that were held out."""

import numpy as np

from vellum.llm import quality_rules
from vellum.llm.text import chunks


def test_scores_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.4, 600) > 0).astype(float)
    trees = quality_rules.fit(x, y, [1, -1, 0, 0], rounds=30)
    grid = np.linspace(0, 1, 40)
    for row in x[:25]:
        for k, sign in ((0, 1), (1, -1)):
            moved = np.tile(row, (40, 1))
            moved[:, k] = grid
            assert (sign * np.diff(trees.score(moved)) >= -1e-12).all()
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.8


def test_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    trees = quality_rules.fit(x, (x[:, 2] > 0.4).astype(float), [0, 0, 0], rounds=10)
    for row, score in zip(x[:40], trees.score(x[:40]), strict=True):
        total = 0.0
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(total - score) < 1e-9


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality").toPandas()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": docs["text"].tolist()})
    x = np.vstack([quality_rules.statistics(data, offsets)["features"] for _, data, offsets in chunks(iter([batch]))])
    y = docs["quality"].to_numpy(float)
    test = docs["doc_id"].to_numpy() % 3 == 0
    trees = quality_rules.fit(x[~test], y[~test], [s for _, s in quality_rules.FEATURES])
    good, bad = trees.score(x[test & (y == 1)]), trees.score(x[test & (y == 0)])
    if len(good) and len(bad):
        assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() > 0.7


def test_the_sample_keeps_its_bound(spark, monkeypatch):
    """An id repeated thousands of times, with one text or many, takes one place; ids without a document take none."""
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda x, y, signs: seen.append((len(x), sorted(y))))
    rows = [(1, "same text")] * 5000 + [(2, f"other text {k}") for k in range(5000)] + [(3, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (7, 1), (8, 0), (None, 1), (3, None)], "doc_id long, quality int")
    quality_rules.fit_labelled(docs, labels)
    quality_rules.fit_labelled(docs, labels.where("doc_id < 3"), max_labelled=2)
    quality_rules.fit_labelled(docs, labels.where("doc_id IN (1, 2)"), max_labelled=1)  # one kind of label: no model
    assert seen == [(3, [0.0, 1.0, 1.0]), (2, [0.0, 1.0])]
