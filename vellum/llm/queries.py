"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_snapshots, collocations, decontaminate, host_reputation, language_fusion, line_dedup, ngram_join, pattern_packing, ppm, quality_rules, source_mixing, suffix_dedup, turn_repair, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"), words=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render(_read(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file of a public tokenizer; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


#: (verdict, host and path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: what a rule says of the page, else whether its visible text is poor."""
    pages = _read(spark, sf_dir, "pages")
    host = urls.host(F.col("url"))
    _, verdict = host_reputation.ruled(RULES, host, urls.path(F.col("url")))
    outcomes = pages.select(host.alias("host"), F.coalesce(verdict == "block", host_reputation.content_outcome(F.col("html"))).alias("bad"))
    return host_reputation.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_fusion.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(_read(spark, sf_dir, "conversations"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights: 1 for documents labelled good, 0.25 for bad ones, 0.5 for the others."""
    return source_mixing.mix(_read(spark, sf_dir, "documents"), source_mixing.label_weights(_read(spark, sf_dir, "labels"))).drop("source")


def _strength_sql(name: str, rows: str) -> str:
    """A CTE with one row v: how strong the prior is over rows of n, bad, pn, pbad (see ``host_reputation``)."""
    return f"""{name} AS (
  SELECT CASE WHEN coalesce(whole, 0) = 0 OR spread <= chance THEN 1000.0 ELSE least(1000.0, greatest(2.0, whole / (spread - chance) - 1)) END::DOUBLE AS v
  FROM (SELECT sum(n * (bad / n - m) * (bad / n - m)) AS spread, sum(m * (1 - m)) AS chance, sum(n * m * (1 - m)) AS whole FROM (SELECT n, bad, pbad / pn AS m FROM ({rows})))
)"""


def _posterior_sql(strength: str, above: str, spread: str) -> str:
    mean = f"(({strength} * {above} + bad) / ({strength} + n))"
    return f"{mean} AS m, {mean} * (1 - {mean}) / ({strength} + n + 1) + ({strength} / ({strength} + n)) ** 2 * {spread} AS v"


_TWO_LABELS = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
HOST_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM pages
),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) < 20 OR length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) * 10 > length(regexp_replace(t, '[\x20\x09-\x0D#*$%&|<>]+', '', 'g')) AS poor FROM p
),
o AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN true WHEN rule IS NOT NULL THEN false ELSE poor END AS bad FROM r),
h0 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad FROM o WHERE bad IS NOT NULL GROUP BY host),
h1 AS (
  SELECT *, CASE WHEN regexp_full_match(host, '[0-9.]+(:[0-9]+)?') THEN host WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_TWO_LABELS}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM h0
),
h AS (SELECT *, CASE WHEN regexp_full_match(domain, '[0-9.]+(:[0-9]+)?') OR NOT contains(domain, '.') THEN domain ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
a AS (SELECT sum(n) AS n, sum(bad) AS bad FROM s),
{_strength_sql("ks", "SELECT s.n, s.bad, a.n AS pn, a.bad AS pbad FROM s, a")},
{_strength_sql("kd", "SELECT d.n, d.bad, s.n AS pn, s.bad AS pbad FROM d JOIN s USING (suffix)")},
{_strength_sql("kh", "SELECT h.n, h.bad, d.n AS pn, d.bad AS pbad FROM h JOIN d USING (domain)")},
s2 AS (SELECT suffix, {_posterior_sql("k", "pm", "0.0")} FROM (SELECT s.*, ks.v AS k, a.bad / a.n AS pm FROM s, ks, a)),
d2 AS (SELECT domain, {_posterior_sql("k", "pm", "pv")} FROM (SELECT d.*, kd.v AS k, s2.m AS pm, s2.v AS pv FROM d JOIN s2 USING (suffix), kd)),
h2 AS (SELECT host, {_posterior_sql("k", "pm", "pv")} FROM (SELECT h.*, kh.v AS k, d2.m AS pm, d2.v AS pv FROM h JOIN d2 USING (domain), kh))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(m - 1.645 * sqrt(v), 0) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM o LEFT JOIN h2 USING (host)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_line_dedup, op4_decontaminate, op5_ppm, op6_suffix_dedup, op7_chat_snapshots, op8_pattern_packing, op9_host_reputation, op10_language_fusion, op11_collocations, op12_turn_repair, op13_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op4_decontaminate": decontaminate.ORACLE_SQL, "op7_chat_snapshots": chat_snapshots.ORACLE_SQL, "op9_host_reputation": HOST_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_turn_repair": turn_repair.ORACLE_SQL, "op13_source_mixing": source_mixing.ORACLE_SQL}
