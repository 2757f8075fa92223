"""Language identification of web pages by Bayesian evidence fusion.

Three sources meet in one posterior per page:

- the visible text: log likelihoods of hashed byte trigrams under each language, counted over all
  labelled documents, raised to a power below one as neighbouring trigrams are not independent;
- the declared language of the markup: how often pages of a language (by their text) declare what;
- the address: a host's language shares, smoothed towards its registered domain's, those towards its
  suffix's, those towards the overall shares. A page's own text doesn't count towards its host.

Sums run where the rows are before they are shuffled, so a hot host is one row per task. Only tables
bounded by the number of languages (at most ``MOST_LANGUAGES``, counted first; more are refused) reach the driver.

Defined cases: a null or empty page has no text evidence; a null address has an empty host. An unknown
or missing declaration is evidence of its own. Repeated pages each keep a row. Without labelled
documents the language is null. Of languages with equal posteriors the first by name is given. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .host_reputation import MARKUP, SALTS
from .storage import bounded_arrow, materialize
from .text import chunks

BUCKETS, MOST_LANGUAGES = 1 << 15, 128
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[:65] = FOLD[91:97] = FOLD[123:128] = 32
DECLARED = r"(?is)<html[^>]*\blang\s*=\s*[\"']?\s*([a-z]+)"


def buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; what is not a letter counts as a space, as does what lies before a text."""
    x = FOLD[data]
    two, one = (np.concatenate([np.full(k, 32, np.uint32), x])[: len(x)] for k in (2, 1))
    first = offsets[:-1][np.diff(offsets) > 0]
    two[first] = one[first] = 32
    two[first[first + 1 < len(x)] + 1] = 32
    key = two << np.uint32(16) | one << np.uint32(8) | x
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and log probabilities (language x bucket) over all labelled documents."""
    bounded_arrow(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch, data, offsets in chunks(batches):
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            found = buckets(data, offsets)
            each = np.repeat(np.arange(len(names)), np.diff(offsets))
            for lang in set(names):
                n = np.bincount(found[(names == lang)[each]], minlength=BUCKETS)
                held[lang] = held.get(lang, 0) + n
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.lower(lang_col).alias("lang"))
    # Before anything reaches the driver: a column that isn't one of languages is refused, not learned from.
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = labelled.mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toPandas()  # at most MOST_LANGUAGES x BUCKETS rows
    langs = sorted(table["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[table["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    return langs, np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def _soft(logs: Column) -> Column:
    """An array of logs as probabilities."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def identify(pages: DataFrame, docs: DataFrame, power: float = 0.2, strength: float = 5.0, broadcast_hosts: int = 100_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per page: its language and the posterior probability, the text's own choice and the declaration."""
    spark = pages.sparkSession
    langs, logs = train(docs, text_col, lang_col)
    if not langs:
        return pages.select(F.col(id_col).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), urls.host(F.col(url_col)).alias("host"))
    model = spark.sparkContext.broadcast(logs)
    many = range(len(langs))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch, data, offsets in chunks(batches, limit=1 << 20):
            found = buckets(data, offsets)
            out = np.empty((len(offsets) - 1, len(table)))
            for k, row in enumerate(table):
                total = np.concatenate([[0.0], np.cumsum(row[found], dtype=np.float64)])
                out[:, k] = power * (total[offsets[1:]] - total[offsets[:-1]])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("declared"), lists], ["page_id", "host", "declared", "logs"])

    head = F.regexp_extract(F.col(html_col), DECLARED, 1)
    visible = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), MARKUP, " ")
    rows = pages.select(F.col(id_col).alias("page_id"), urls.host(F.col(url_col)).alias("host"), F.lower(F.nullif(head, F.lit(""))).alias("declared"), visible.alias("text"))
    kind = dict(rows.dtypes)["page_id"]
    weighed = rows.mapInArrow(weigh, f"page_id {kind}, host string, declared string, logs array<double>")
    said = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNull(), "none").otherwise("other")
    weighed = materialize(weighed.withColumns({"said": said, "soft": _soft(F.col("logs"))}), "weighed")

    # How often pages of each language declare what: at most (languages + 2) x languages numbers.
    shares = {r["said"]: np.array([r[f"s{k}"] for k in many]) for r in weighed.groupBy("said").agg(*(F.sum(F.get("soft", F.lit(k))).alias(f"s{k}") for k in many)).collect()}
    whole = sum(shares.values(), np.zeros(len(langs)))
    declared = {x: np.log((shares.get(x, np.zeros(len(langs))) + 0.5) / (whole + 0.5 * (len(langs) + 2))) for x in [*langs, "none", "other"]}
    overall = (whole + 1) / (whole.sum() + len(langs))

    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in many]
    hosts = weighed.groupBy("host").agg(*(F.sum(F.get("soft", F.lit(k))).alias(f"s{k}") for k in many), F.count("*").cast("double").alias("n"))
    hosts = materialize(hosts.withColumn("domain", urls.domain(F.col("host"))).withColumn("suffix", urls.suffix(F.col("domain"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums, F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(*sums, F.sum("n").alias("n"))
    smooth = lambda above: F.array(*((F.col(f"s{k}") + strength * above(k)) / (F.col("n") + strength) for k in many))
    suffixes = suffixes.select("suffix", smooth(lambda k: F.lit(float(overall[k]))).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", smooth(lambda k: F.get("above", F.lit(k))).alias("above"))
    hosts = materialize(hosts.join(domains, "domain").select("host", "n", F.array(*(f"s{k}" for k in many)).alias("sums"), "above"), "priors")
    if hosts.count() <= broadcast_hosts:
        joined = weighed.join(F.broadcast(hosts), "host")
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = weighed.withColumn("salt", F.pmod(F.xxhash64("page_id", "logs"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    spoken = F.create_map(*(y for x, v in declared.items() for y in (F.lit(x), F.array(*(F.lit(float(z)) for z in v)))))
    others = lambda k: F.greatest(F.lit(0.0), F.get("sums", F.lit(k)) - F.get("soft", F.lit(k)))
    fused = F.array(*(F.get("logs", F.lit(k)) + F.get(spoken[F.col("said")], F.lit(k)) + F.log((others(k) + strength * F.get("above", F.lit(k))) / (F.col("n") - 1 + strength)) for k in many))
    best = lambda a: F.get(F.array(*map(F.lit, langs)), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return joined.withColumn("fused", _soft(fused)).select("page_id", best(F.col("fused")).alias("lang"), F.array_max("fused").alias("probability"), best(F.col("soft")).alias("text_lang"), "declared", "host")
