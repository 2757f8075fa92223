"""Operators on pages and conversations against plain Python, on awkward and on small tables."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat_snapshots, host_reputation, language_fusion, queries, urls

URLS = [
    None, "", "no scheme/net/", "http://Example.NET/en/x", "https://a.example.net/en", "https://example.com/de/", "https://example.com/DE/", "https://fr.org/fr/x?y#z", "https://org/fr/", "x://y.net?q", "http://net/",
    "http://notexample.net/en/a", "http://example.net/en/#f", "http://a://b/c", "http:///only/path", "https://deep.sub.example.com/de/a",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = []
    for verdict, r in queries.RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fit.append((len(r), r, verdict))
    return max(fit)[1:] if fit else (None, None)


def pages(spark, table):
    return spark.createDataFrame([(i, u, h, "x", 1.0) for i, (u, h) in enumerate(table)], "page_id long, url string, html string, bound string, n double")


@pytest.mark.parametrize("kind", ["awkward", "small", "empty"])
def test_url_filters(spark, small, kind):
    if kind == "small":
        frame = spark.read.parquet(f"{small}/pages.parquet")
    else:
        frame = pages(spark, [(u, "<p>text</p>") for u in URLS] if kind == "awkward" else [])
    host = urls.host(F.col("url"))
    outcomes = frame.select(host.alias("host"), F.lit(True).alias("bad"))
    for limit in (200_000, 0):
        got = {r["page_id"]: r for r in host_reputation.judge(frame, outcomes, queries.RULES, broadcast_hosts=limit).collect()}
        assert len(got) == frame.count()
        for r in frame.select("page_id", "url").collect():
            h, p = parts(r["url"])
            x = got[r["page_id"]]
            assert (x["host"], x["path"], x["rule"]) == (h, p, rule(h, p)[0])
            if x["rule"]:
                assert x["verdict"] == rule(h, p)[1]


def test_few_bad_pages_do_not_block_a_host(spark):
    outcomes = [("good.example", False)] * 60 + [("bad.example", True)] * 60 + [("new.example", True)] + [("none.example", None)]
    bounds = {r["host"]: r["bound"] for r in host_reputation.reputations(spark.createDataFrame(outcomes, "host string, bad boolean")).collect()}
    assert bounds["bad.example"] > 0.5 > bounds["new.example"] > bounds["good.example"]
    assert "none.example" not in bounds


def expected_chats(turns):
    by: dict = {}
    for t in set(turns):
        by.setdefault(t[0], []).append(t[1:])
    low = lambda x: (x is not None, x if x is not None else 0)
    convs = {c: tuple((r, x) for _, r, x in sorted(ts, key=lambda t: tuple(map(low, t)))) for c, ts in by.items()}
    first: dict = {}
    for c in sorted(convs, key=low):
        if c is not None or convs[c] not in convs.values():
            first.setdefault(convs[c], c)
    for c, body in convs.items():
        first.setdefault(body, c)
    prefixes = {b[:k] for b in first for k in range(1, len(b))}
    blank = lambda x: x or ""
    return {(c, len(b), "".join(f"<|{blank(r)}|>\n{blank(x)}\n<|end|>\n" for r, x in b)) for b, c in first.items() if b not in prefixes}


def test_chat_snapshots(spark, small):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 3, "user", ""), (7, 3, "user", ""), (8, 0, "user", "x" * 5000), (9, None, "user", "y"),
    ]
    frame = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, n int, p string")
    assert {tuple(r) for r in chat_snapshots.render(frame).collect()} == expected_chats(turns)
    assert chat_snapshots.render(frame.where("false")).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op7_chat_snapshots(spark, small).collect()} == expected_chats(real)


def test_sql_states_the_same(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, small)
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


WORDS = {"en": "the quick brown fox jumps over the lazy dog and then the other one", "de": "der schnelle braune fuchs springt auch über den faulen hund und dann", "fr": "le renard brun rapide saute par dessus le chien paresseux et puis les autres"}


def test_language(spark, small):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(WORDS.items())] + [(9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string")
    table = [(f"https://{lang}{k}.example/{lang}", f"<html lang='{lang}'><p>{t}</p></html>") for lang, t in WORDS.items() for k in range(5)] + [(None, None), ("https://en0.example/", ""), ("x", "<html lang=qq>")]
    got = {r["page_id"]: r for r in language_fusion.identify(pages(spark, table), docs).collect()}
    assert len(got) == len(table)
    assert [got[i]["lang"] for i in range(15)] == [lang for lang in WORDS for _ in range(5)]
    assert got[16]["lang"] == "en"  # by its host alone
    assert all(0 < r["probability"] <= 1 for r in got.values())
    assert {r["lang"] for r in language_fusion.identify(pages(spark, table), docs.where("false")).collect()} == {None}
    assert language_fusion.identify(pages(spark, []), docs).count() == 0


def test_language_by_text_on_held_out_documents(spark, small):
    """Documents as pages, learned from the others: nearly all are told."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 200")
    own = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    out = language_fusion.identify(own.drop("lang"), docs.where("doc_id % 4 <> 0")).join(own.select("page_id", F.col("lang").alias("truth")), "page_id")
    share = out.select(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert share > 0.9


def test_more_languages_than_can_be_held_are_refused(spark):
    docs = spark.createDataFrame([(i, "text", f"lang{i}") for i in range(200)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_fusion.train(docs)


def test_language_posterior_by_hand(spark):
    """The whole posterior in plain Python, by either way of joining hosts, on repeated and awkward pages."""
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(WORDS.items())], "doc_id long, text string, lang string")
    texts = list(WORDS.values())
    table = [("https://a.example.org/", f"<html lang=en><p>{texts[0]}</p>"), ("https://a.example.org/x", f"<html lang=de>{texts[1]}"), ("https://b.example.org/", "the"), ("https://b.example.org/", "the"), (None, None), ("http://c.fr/", f"{texts[2]} " * 30), ("http://c.fr/y", "")]
    langs, logs = language_fusion.train(docs)
    power, strength, n = 0.2, 5.0, len(langs)
    soft = lambda v: (lambda e: e / e.sum())(np.exp(np.array(v) - max(v)))
    pages_ = []
    for url, html in table:
        host = re.match("[^/]*//([^/?#]*)", url).group(1) if url else ""
        lang = re.match("<html[^>]*lang=([a-z]+)", html or "")
        data = np.frombuffer(re.sub("<[^>]*>", " ", html or "").encode(), np.uint8)
        weights = power * np.array([float(row[language_fusion.buckets(data, np.array([0, len(data)]))].astype(np.float64).sum()) if len(data) else 0.0 for row in logs])
        pages_.append((host, lang.group(1) if lang else "none", weights, soft(weights)))
    whole = sum(p[3] for p in pages_)
    said = {x: np.log((sum((p[3] for p in pages_ if p[1] == x), np.zeros(n)) + 0.5) / (whole + 0.5 * (n + 2))) for x in [*langs, "none", "other"]}
    overall = (whole + 1) / (whole.sum() + n)
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: domain(h).split(".", 1)[-1]
    smooth = lambda own, above: (sum((p[3] for p in own), np.zeros(n)) + strength * above) / (len(own) + strength)
    expected = []
    for host, declared, weights, mine in pages_:
        above = smooth([p for p in pages_ if domain(p[0]) == domain(host)], smooth([p for p in pages_ if suffix(p[0]) == suffix(host)], overall))
        own = [p for p in pages_ if p[0] == host]
        rest = np.maximum(0, sum(p[3] for p in own) - mine)
        fused = soft(weights + said[declared] + np.log((rest + strength * above) / (len(own) - 1 + strength)))
        expected.append((langs[int(fused.argmax())], float(fused.max())))
    for hosts in (100_000, 0):
        got = {r["page_id"]: (r["lang"], r["probability"]) for r in language_fusion.identify(pages(spark, table), docs, broadcast_hosts=hosts).collect()}
        assert len(got) == len(table)
        for k, (lang, p) in enumerate(expected):
            assert got[k][0] == lang and abs(got[k][1] - p) < 1e-6
