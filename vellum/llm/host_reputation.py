"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

A short list of rules decides the addresses that it fits. For the rest, labelled page outcomes (bad or
not) are counted per host; a host's rate of bad pages gets a beta prior around its registered domain's
posterior mean, a domain's around its suffix's, a suffix's around the overall rate. How strong each
prior is, is estimated from how much the rates of that level differ beyond chance (method of moments).
The uncertainty of each level's mean goes down with it. A host is blocked when the lower bound of its
posterior exceeds ``most_bad``, so that a host is never blocked for a few bad pages.

Counts are added where the rows are before they are shuffled, so a host with a third of all pages
costs no more. Host rates are broadcast up to ``broadcast_hosts`` hosts and joined with salted keys
beyond.

Defined cases: an address that is null or without :// has an empty host and path and no rule; pages
with an empty host share one reputation. A null outcome counts for nothing. Repeated pages count as
often as they occur and each keep a row. Without outcomes nothing but the rules blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .storage import materialize

Rule = tuple[str, str]  # verdict; host and path, as in example.net/en/
MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
SALTS = 16


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two as long, the later in the alphabet; null if none."""
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[1]))
    pick = lambda k: reduce(lambda other, r: F.when(_fits(r[1], host, path), F.lit(r[k])).otherwise(other), ordered, F.lit(None).cast("string"))
    return pick(1), pick(0)


def content_outcome(html: Column) -> Column:
    """Whether a page's visible text is poor: under 20 words, or a symbol for every ten other characters."""
    text = F.regexp_replace(html, MARKUP, " ")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rest = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D#*$%&|<>]+", ""))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return (words < 20) | (symbols * 10 > rest)


def _strength(children: DataFrame, parent: str) -> float:
    """How many pages a prior is worth: mean (1 - mean) over the variance of the rates beyond chance, within 2 to 1000."""
    rate, mean = F.col("bad") / F.col("n"), F.col(f"{parent}_bad") / F.col(f"{parent}_n")
    row = children.agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col("n") * mean * (1 - mean)).alias("whole"), F.sum("n").alias("n")
    ).first()
    if not row["n"] or not row["whole"]:
        return 1000.0
    beyond = (row["spread"] - row["chance"]) / row["n"]
    return min(1000.0, max(2.0, row["whole"] / row["n"] / beyond - 1)) if beyond > 0 else 1000.0


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, bound) from rows of (host, bad): a host's posterior rate of bad pages and its lower bound."""
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    hosts = materialize(hosts.withColumn("domain", urls.domain(F.col("host"))).withColumn("suffix", urls.suffix(F.col("domain"))), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    all_ = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = all_["n"] or 0.0, all_["bad"] or 0.0
    overall = bad / n if n else 0.0
    over = lambda t, name, key: t.join({"suffix": suffixes, "domain": domains}[name].select(key, F.col("n").alias(f"{name}_n"), F.col("bad").alias(f"{name}_bad")), key)
    s = _strength(suffixes.withColumns({"all_n": F.lit(max(n, 1.0)), "all_bad": F.lit(bad)}), "all")
    d, h = _strength(over(domains, "suffix", "suffix"), "suffix"), _strength(over(hosts, "domain", "domain"), "domain")

    def posterior(strength: float, above: Column | float, spread: Column | float) -> tuple[Column, Column]:
        """Mean and variance of a rate under a prior whose mean is itself uncertain by ``spread``."""
        size = strength + F.col("n")
        mean = (strength * above + F.col("bad")) / size
        return mean, mean * (1 - mean) / (size + 1) + F.pow(strength / size, F.lit(2.0)) * spread

    of = lambda level, m, v: (m.alias(f"{level}_mean"), v.alias(f"{level}_var"))
    suffixes = suffixes.select("suffix", *of("suffix", *posterior(s, F.lit(overall), F.lit(0.0))))
    domains = domains.join(suffixes, "suffix").select("domain", *of("domain", *posterior(d, F.col("suffix_mean"), F.col("suffix_var"))))
    mean, var = posterior(h, F.col("domain_mean"), F.col("domain_var"))
    return hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(var)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], most_bad: float = 0.5, broadcast_hosts: int = 200_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: host, path, the rule that fits, the verdict, and the host's posterior bound."""
    known = materialize(reputations(outcomes).select("host", "bound"), "reputations")
    rows = pages.select(F.col(id_col).alias("page_id"), urls.host(F.col(url_col)).alias("host"), urls.path(F.col(url_col)).alias("path"))
    if known.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    own = F.when(F.coalesce("bound", F.lit(0.0)) > most_bad, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.coalesce("bound", F.lit(0.0)).alias("bound"))
