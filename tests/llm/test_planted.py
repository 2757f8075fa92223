"""Passages of over 50 words planted across documents: operator 6 goes by their bytes, not by their words."""

import random

import pytest

from tests.llm import brute
from tests.llm.tables import collected, documents, ordered
from vellum.llm import suffix_dedup


@pytest.fixture(scope="module")
def planted():
    """(table, ids by the planted passage's bytes); 0: nothing planted."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    prose = lambda n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    table, ids = [], {}
    for size in (0, 330, 399, 400, 401, 900):
        passage = prose(150)[: size - 1] + "." if size else ""
        assert not size or len(passage.split()) > 50
        for k in range(5):  # other letters beside the passage, so that no more than it is shared
            i = size * 10 + k
            table.append((i, f"{prose(rng.randint(20, 400))} {letters[k]}{passage}{letters[k + 9]} {prose(rng.randint(20, 400))}"))
            ids.setdefault(size, []).append(i)
    rng.shuffle(table)
    return table, ids


def test_suffix_dedup_planted(spark, planted):
    table, ids = planted
    raw = dict(table)
    for most in (8000, 2):
        out = suffix_dedup.digest(documents(spark, table), most=most)
        expected = [(i, n, r, s, brute.sha(left)) for (i, _), (n, r, s, left) in zip(table, brute.repeated_bytes([t for _, t in table], 400), strict=True)]
        assert collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(expected)
        got = {r["doc_id"]: r for r in out.collect()}
        for size, some in ids.items():
            assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in some] == [(size, 1) if size >= 400 else (0, 0)] * len(some)
            assert [got[i]["n_bytes"] for i in some] == [len(raw[i].encode()) for i in some]  # the size of the input, whatever goes
