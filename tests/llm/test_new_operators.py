"""Collocations, turn repair and source mixing against brute force, on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import collected, ordered, rows
from vellum.llm import collocations, source_mixing, turn_repair
from vellum.llm.collocations import Filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(table, least, longest, top):
    """table: (lang, text)."""
    counts, total = {}, Counter()
    for lang, text in table:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    x = (lang or "und", tuple(words[i : i + m]))
                    counts[x] = counts.get(x, 0) + 1
    good = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, x), a in good.items():
        inside = lambda y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
        if any(g == lang and len(y) > len(x) and 100 * b >= 100 * a and inside(y) for (g, y), b in good.items()):
            continue
        score, k = min((1000 * a * total[lang] // (counts[lang, x[:k]] * counts[lang, x[k:]]), k) for k in range(1, len(x)))
        out.append((lang, -score, -a, " ".join(x).encode(), " ".join(x), a, counts[lang, x[:k]], counts[lang, x[k:]], total[lang], score))
    ranked = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        ranked += [(lang, i, *r[4:]) for i, r in enumerate(group, 1) if i <= top]
    return ranked


def texts(n=300, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "is", "big", "Über", "straße", "日本", "x.y", "z"]
    fixed = ["new york city is", "of the", "一 二 三 四 五 六", "a a a a"]
    out = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", "", ",", "\n", "!"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return out + [("en", None), ("en", ""), ("en", " \t.,"), (None, None), ("fr", "only once here")]


@pytest.mark.parametrize(("least", "longest", "top", "bits", "shard"), [(20, 5, 2000, 27, 1 << 20), (5, 5, 7, 12, 100), (3, 2, 50, 12, 40), (9, 3, 50, 27, 300)])
def test_collocations(spark, least, longest, top, bits, shard):
    table = texts()
    frame = spark.createDataFrame([(t, lang, 1, "w", 2) for lang, t in table], "text string, lang string, n int, word string, id int").repartition(3)
    got = collocations.mine(frame, least, longest, top, log2_bits=bits, shard_words=shard)
    assert sorted(map(tuple, got.collect())) == sorted(phrases(table, least, longest, top))
    assert collocations.mine(frame.where("false")).count() == 0


def test_collocations_with_a_hash_that_collides(spark, monkeypatch):
    """Where two words share an id everything is counted again under another hash."""
    real, seeds = collocations.byte_values, []

    def poor(seed):
        seeds.append(seed)
        return real(seed) * 0 + 7 if seed == 1 else real(seed)

    monkeypatch.setattr(collocations, "byte_values", poor)
    table = texts(60)
    got = collocations.mine(spark.createDataFrame([(lang, t) for lang, t in table], "lang string, text string"), 10)
    assert seeds == [1, 2] and sorted(map(tuple, got.collect())) == sorted(phrases(table, 10, 5, 2000))


def test_collocations_of_a_long_text(spark):
    table = [("en", "one two three " * 100_000)]
    got = collocations.mine(spark.createDataFrame(table, "lang string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(phrases(table, 100, 5, 2000))


def repaired(turns):
    """The cheapest edits by a plain program over (cost, audit)."""
    seen, marked = set(), []
    for role, text in turns:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    best = {0: (0, "")}  # by state: nothing, after s, after u, after a
    after = (2, 2, 3, 2)

    def grown(states):
        out = dict(states)
        for _ in range(3):
            for p, (c, x) in list(out.items()):
                way = (c + 3, x + "I")
                if after[p] not in out or way < out[after[p]]:
                    out[after[p]] = way
        return out

    for role, _, fault in marked:
        # All runs of inserts up to three, not only the best for a state: an audit may be less for a longer run.
        ways = []
        for p, (c, x) in best.items():
            for run in range(4):
                ways.append((p, c + 3 * run, x + "I" * run))
                p = after[p]
        new = {}
        for p, c, x in ways:
            more = 3 if fault == "truncated" else 0
            moves = [(p, c + 4, x + "D")]
            if fault not in ("blank", "duplicate"):
                moves.append((after[p], c + 3 + more, x + "R"))
                to = {"s": 1 if p == 0 else None, "u": 2 if p != 2 else None, "a": 3 if p == 2 else None}.get(role[:1])
                if to is not None:
                    moves.append((to, c + more, x + "K"))
            for q, *way in moves:
                if q not in new or tuple(way) < new[q]:
                    new[q] = tuple(way)
        best = new
    cost, audit = min(v for k, v in grown(best).items() if k in (0, 3))
    size, lines, at = sum(e != "D" for e in audit), [], 0
    rest = iter(marked)
    for e in audit:
        row = next(rest) if e != "I" else None
        if e == "D":
            continue
        role = row[0] if e == "K" else "user" if (at - size % 2) % 2 == 0 else "assistant"
        lines.append(f"{role}:{row[1] if row else ''}")
        at += 1
    initials = [r[:1] for r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    tally = Counter(f for *_, f in marked)
    return tally["blank"], tally["duplicate"], tally["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed=5):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "and then", "", " \n", "Fine. ", "Truncated here", "x."]
    out = []
    for c in range(60):
        for t in range(rng.randint(0, 12)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                out.append((c, t if rng.random() < 0.9 else rng.choice([None, t + 3, -5]), rng.choice(["user", "assistant", "system", "user", "tool", "", None]), rng.choice([*said, f"text {rng.randint(0, 9)}.", None])))
    out += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (70, 1 << 62, "user", "Far."), (70, -(1 << 62), "user", "Near."), out[3], out[3]]
    return out


def expected_repairs(table):
    shown = lambda x: " " if x is None else str(x)
    out = []
    for c in {r[0] for r in table}:
        held = []
        for _, turn, role, text in (r for r in table if r[0] == c):
            role, text, harm = shown(role), shown(text), zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            held += [(turn is not None, turn or 0, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        held.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = {r[1] for r in held if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *repaired([r[2:] for r in held])))
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_turn_repair(spark):
    table = conversations()
    frame = spark.createDataFrame([(*r, 1, "z", 4) for r in table], "conv_id long, turn long, role string, text string, pos int, kind string, c int").repartition(3)
    assert collected(turn_repair.digest(frame), *COLUMNS) == ordered(expected_repairs(table))
    assert turn_repair.digest(frame.where("false")).count() == 0


def test_turn_repair_in_blocks(spark):
    """A long conversation goes through many blocks and partitions."""
    rng = random.Random(1)
    table = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 500)}{rng.choice('.x')}") for t in range(900)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    summary, turns = turn_repair.repair(frame, block=16)
    found = summary.join(turn_repair.text_digests(turns), "c").first()
    assert tuple(found[x] for x in COLUMNS[2:]) == repaired([r[2:] for r in table])
    kept = turns.orderBy("pos", "k").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept)) and "".join(r["edit"] for r in kept) == found["audit"].replace("D", "")


def test_every_edit_sequence(spark):
    """The program against all audits, for every conversation of up to three rows out of some kinds."""
    repairs = turn_repair.Repairs()
    kinds = [("s", ""), ("u", ""), ("a", ""), ("u", "truncated"), ("a", "blank"), ("t", "")]
    cost_of = {"K": 0, "R": 3, "D": 4, "I": 3}
    for n in range(4):
        every = ["".join(x) for m in range(n, n + 5) for x in itertools.product("DIKR", repeat=m) if sum(e != "I" for e in x) == n]
        for rows_ in itertools.product(kinds, repeat=n):
            best = None
            for audit in every:
                rest, size, at, cost = iter(rows_), sum(e != "D" for e in audit), 0, 0
                for e in audit:
                    cls, fault = next(rest) if e != "I" else ("", "")
                    cost += cost_of[e] + (3 if e in "KR" and fault == "truncated" else 0)
                    if e == "D":
                        continue
                    want = "s" if size % 2 and not at else "ua"[(at - size % 2) % 2]
                    if e in "KR" and fault == "blank" or e == "K" and cls != want or e in "RI" and want == "s":
                        break
                    at += 1
                else:
                    if size != 1 and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            letters = bytes(65 + 4 * "suat".index(c) + turn_repair.FAULTS.index(f) for c, f in rows_)
            cost, ways, end = repairs.solve(letters)
            assert (cost, "".join(turn_repair.CODES[(x - 48) % 9] for x in ways) + "I" * (end % 3)) == best


def expected_mix(table, weights, cycle=(5, 2, 1), percent=150, most=2):
    """table: (doc_id, source, text). By repeated sharing, and one sort a source."""
    import math

    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5((t or "").encode()).hexdigest()) for i, s, t in table]
    names = sorted({s for _, s, *_ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r[2] for r in sized if r[1] == s) for s in names}
    w = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    left, open_, target = sum(size.values()) * percent / 100, set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if most * size[s] <= w[s] * level}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: float(most * size[s]) for s in full}
        left, open_ = left - sum(most * size[s] for s in full), open_ - full
    copies, out = Counter(), []
    by_source = {s: [] for s in names}
    for r in sized:
        copies[r] += 1
        tag = f"{' ' if r[0] is None else r[0]}:{copies[r]}:{r[3]}"
        u = (int(hashlib.md5(tag.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by_source[r[1]].append((-math.log(u) / weights.get(r[0], 0.5), tag, r[0], r[2]))
    for s, group in by_source.items():
        epochs = min(int(target[s] / size[s]), most) if size[s] else 0
        rest = math.floor(target[s] + 0.5) - epochs * size[s] if size[s] else 0
        for _, _, i, n in sorted(group):
            part = min(n, max(0, rest))
            rest -= part
            out.append((i, n, size[s], round(target[s], 6), epochs * n + part))
    return out


def test_source_mixing(spark):
    rng = random.Random(2)
    table = [(i, rng.choice(["b", "a", "ä", "z", "", None, "tiny"]), t) for i, t in rows()]
    table += [(900, "tiny", "one"), (901, "none", ""), (902, "none", None), *[(903, "z", "again and again")] * 9]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0, 3) for r in table], "doc_id long, source string, text string, size int, sha string, weight double, cell int").repartition(3)
    judged = spark.createDataFrame([(i, i % 2) for i in range(0, 80, 3)] + [(3, 0), (3, 1), (None, 1), (6, None)], "doc_id long, quality int")
    quality = source_mixing.label_weights(judged)
    weights = {r["doc_id"]: r["weight"] for r in quality.collect()}
    assert weights[3] == 0.25
    got = []
    for parts, cell in ((2, 4000), (5, 3)):
        out = source_mixing.mix(frame.repartition(parts), quality, cell_rows=cell).withColumn("target", F.round("target", 6))
        got.append(collected(out, "doc_id", "size", "source_size", "target", "taken"))
    assert got[0] == got[1] == ordered(expected_mix(table, weights))
    for s in {r[1] for r in table}:
        mine = source_mixing.mix(frame, quality).where(F.col("source").eqNullSafe(s)).agg(F.sum("taken"), F.max("target")).first()
        assert abs(mine[0] - mine[1]) < 1
    assert source_mixing.mix(frame.where("false"), quality).count() == 0
    assert source_mixing.mix(frame.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_mixing_prefers_better_documents(spark):
    table = [(i, "s" if i % 2 else "t", "word " * 10) for i in range(2000)]
    frame = spark.createDataFrame(table, "doc_id long, source string, text string")
    quality = frame.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    out = source_mixing.mix(frame, quality, weights=(1, 1), percent=50)
    better = out.groupBy((F.col("doc_id") % 4 < 2).alias("better")).agg(F.avg((F.col("taken") > 0).cast("int")).alias("share"))
    shares = {r["better"]: r["share"] for r in better.collect()}
    assert shares[True] > shares[False] + 0.25


def test_filter_never_misses():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    at = keys >> np.uint64(64 - 12)
    slots = np.unique(at >> np.uint64(6))
    bits = np.array([np.bitwise_or.reduce(np.uint64(1) << (at[at >> np.uint64(6) == s] & np.uint64(63))) for s in slots], dtype=np.uint64)
    assert Filter(12, slots.astype(np.int64), bits.view(np.int64)).has(keys).all()
