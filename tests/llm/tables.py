"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score string, hash string, start int, n long"
PASSAGE = " ".join(f"passage{k % 37}x{k}" for k in range(90))


def rows(seed: int = 7) -> list[tuple]:
    """(doc_id, text)"""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["The", "the", "Über", "straße", "日本", "a", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [f"Shared line number {k} that many documents hold" for k in range(5)]
    out: list[tuple] = [(1, None), (2, ""), (3, "   \n\t\n "), (4, "one"), (5, "One two"), (None, prose(40)), (None, None)]
    for k in range(10, 40):
        out.append((k, "\n".join([prose(rng.randint(5, 60)), rng.choice(lines), f"\t{rng.choice(lines).upper()} ", prose(12)])))
    base = prose(120).split(" ")
    for k in range(40, 60):  # near copies, in a chain
        base[rng.randrange(len(base))] = f"new{k}"
        out.append((k, " ".join(base)))
    out += [(60, prose(5)), (61, out[-1][1]), (62, f"{prose(20)}\n{PASSAGE} {prose(20)}"), (63, f"{PASSAGE.upper()}"), (64, f"{prose(9)} {PASSAGE} {PASSAGE}")]
    out += [(65, (prose(8) + " ") * 6), (66, "# * $ % & | < > " * 9), (67, "x" * 3000), (68, "x" * 900 + " y"), (69, prose(4000)), (70, "one two"), (71, "ONE\rtwo three\x00four")]
    out += [(72, out[30][1]), out[30], out[12]]
    rng.shuffle(out)
    return out


def documents(spark: SparkSession, table: list[tuple], parts: int = 3) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", 0, 5) for i, t in table], SCHEMA).repartition(parts)


def collected(df: DataFrame, *columns: str) -> list[tuple]:
    return ordered([tuple(r[c] for c in columns) for r in df.select(*columns).collect()])


def ordered(table: list[tuple]) -> list[tuple]:
    return sorted(table, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def small_documents(spark: SparkSession, folder: str) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
