"""Every registered query of the library against its SQL on the small tables, and those without SQL against plain Python."""

import datetime
import math

import duckdb
import pytest

from vellum import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def table(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(([plain(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in found.description], found.fetchall())


def test_every_order_has_its_eligibility(spark, small):
    assert QUERIES["session_eligibility"](spark, small).count() == spark.read.parquet(f"{small}/orders.parquet").count()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_job_states(spark, small):
    from vellum.operators.control import TRANSITIONS

    moves = {"signup": "analyzing", "view": "building", "click": "eligible", "purchase": "uploading", "error": "local_pending"}
    expected: dict = {}
    for r in sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda r: (int(r["ts"].timestamp()), r["event_id"])):
        s = expected.setdefault(r["user_id"], ["local_pending", 0, 0])
        ok = moves[r["event_type"]] in TRANSITIONS[s[0]]
        s[0] = moves[r["event_type"]] if ok else s[0]
        s[1 if ok else 2] += 1
    assert {r["user_id"]: [r["state"], r["moved"], r["conflicts"]] for r in QUERIES["job_states"](spark, small).collect()} == expected


def test_word_error_rate(spark, small):
    from vellum.functions import text as T
    from vellum.plans.tables import _turn_pairs

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    from pyspark.sql import functions as F

    pairs = _turn_pairs(spark, small).select("role", T.spoken_words(F.col("reference")).alias("a"), T.spoken_words(F.col("hypothesis")).alias("b")).collect()
    expected: dict = {}
    for p in pairs:
        e = expected.setdefault(p["role"], [0, 0])
        e[0] += distance(p["a"], p["b"])
        e[1] += len(p["a"])
    assert {r["role"]: [r["edits"], r["n_reference"]] for r in QUERIES["word_error_rate"](spark, small).collect()} == expected


def test_classifier_windows_cover_every_word(spark, small):
    rows: dict = {}
    for r in QUERIES["classifier_windows"](spark, small).collect():
        rows.setdefault(r["session_id"], []).append((r["window_ix"], r["first_word"], r["stop_word"]))
    counts = {r["doc_id"]: r["n_words"] for r in QUERIES["transcript_words"](spark, small).collect()}
    assert rows.keys() == counts.keys()
    for i, windows in rows.items():
        at = 0
        for ix, (n, first, stop) in enumerate(sorted(windows)):
            assert n == ix and first <= at < stop <= first + 220
            at = stop
        assert at == counts[i]


def test_speech_runs(spark, small):
    from vellum.operators import vad
    from vellum.plans.tables import _samples

    frames: dict = {}
    for r in vad.levels(_samples(spark, small), 16).collect():
        frames.setdefault(r["session_id"], {})[r["frame_ix"]] = r["level"]
    expected = set()
    for i, levels in frames.items():
        own = [levels[k] for k in sorted(levels)]
        floor = sorted(own)[max(0, len(own) // 5 - 1)]
        on, run, since = False, 0, None
        for k, x in enumerate([*own, None]):
            before = on
            if x is not None:
                loud = x >= max(floor + 9, -55)
                run = (0 if loud else run + 1) if on else (run + 1 if loud else 0)
                if run >= (8 if on else 2):
                    on, run = not on, 0
            else:
                on = False
            if on and not before:
                since = k
            if before and not on:
                expected.add((i, since * 16, k * 16))
    assert {tuple(r) for r in QUERIES["speech_runs"](spark, small).select("session_id", "start", "end").collect()} == expected


def test_detector_hits_contain_the_single_ones(spark, small):
    """The whole catalogue and the parts of it that SQL states agree."""
    found = QUERIES["detector_hits"](spark, small).collect()
    whole = sorted((r["session_id"], r["start"], r["stop"], r["detector"]) for r in found)
    parts = sorted(tuple(r[c] for c in ("doc_id", "start", "stop", "detector")) for q in ("identifier_hits", "number_hits") for r in QUERIES[q](spark, small).collect())
    names = {p[3] for p in parts}
    assert [w for w in whole if w[3] in names] == parts


@pytest.mark.parametrize("name", ("interval_merge", "interval_pad_merge", "interval_complement", "interval_destinations", "interval_overlap"))
def test_intervals_of_broken_quantities(spark, tmp_path, name):
    """SQL rounds to the nearest whole number, and halves to the even one."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT k // 3 AS l_orderkey, k AS l_partkey, (k % 3)::INT AS l_linenumber, k / 4.0::DOUBLE AS l_quantity FROM range(240) r(k)")
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey FROM range(82) r(k)")
    for t in ("lineitem", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([c[0] for c in found.description], found.fetchall())
