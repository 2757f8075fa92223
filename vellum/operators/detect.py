"""Deterministic detectors of identifiers, secrets and sensitive words, as columns over a transcript.

A transcript is one row: ``display`` and ``spoken``, arrays of words. Matches of a pattern in the
display text are found as word positions without offsets: the text is rewritten with a mark before
and after each match and split at its spaces again, so the marks tell the words. All detectors are
built-in functions on the row; nothing is shuffled and no Python runs. ``hits`` explodes at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import rules

OPEN, CLOSE = "\ue000", "\ue001"  # private characters


def transcripts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(session_id, display, spoken): the words of each text. Characters that mark matches are blanks here."""
    body = F.translate(F.col(text_col), OPEN + CLOSE, "  ")
    return docs.select(F.col(id_col).alias("session_id"), T.words(body).alias("display")).withColumn("spoken", F.transform("display", T.spoken))


def _count(word: Column, mark: str) -> Column:
    return F.length(word) - F.length(F.replace(word, F.lit(mark), F.lit("")))


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (first, last, match): the words of the first and last character of each match.

    ``guard`` is something cheap that holds wherever the pattern matches; texts without it are not searched.
    """
    worth = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    marked = F.split(F.regexp_replace(text, f"({pattern})" if "(?" not in pattern[:2] else f"{pattern[: pattern.index(')') + 1]}({pattern[pattern.index(')') + 1 :]})", f"{OPEN}$1{CLOSE}"), " ")
    where = lambda mark: F.flatten(F.transform(marked, lambda w, i: F.array_repeat(i, _count(w, mark).cast("int"))))
    found = F.arrays_zip(where(OPEN).alias("first"), where(CLOSE).alias("last"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(worth, F.transform(found, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["match"].alias("match")))).otherwise(F.array().cast("array<struct<first:int,last:int,match:string>>"))


def _hit(first: Column, last: Column, category: str, detector: str, source: str = "rules") -> Column:
    return F.struct(first.cast("long").alias("start"), (last + 1).cast("long").alias("stop"), F.lit(category).alias("category"), F.lit(detector).alias("detector"), F.lit(source).alias("source"))


def as_hits(found: Column, category: str, detector: str) -> Column:
    return F.transform(found, lambda m: _hit(m["first"], m["last"], category, detector))


def entropy_hits(text: Column, guard: Column | None = None) -> Column:
    """Long tokens with a letter and a digit that stand between other characters than letters and digits."""
    worth = text.rlike(rules.TOKEN) if guard is None else guard & text.rlike(rules.TOKEN)
    marked = F.split(F.regexp_replace(text, f"({rules.TOKEN})", f"{OPEN}$1{CLOSE}"), " ")

    def inside(word: Column, i: Column) -> Column:
        good = F.regexp_extract_all(word, F.lit(rf"(?U)(?<![\p{{IsAlphabetic}}\p{{N}}]){OPEN}([^{OPEN}{CLOSE}]+){CLOSE}(?![\p{{IsAlphabetic}}\p{{N}}])"), F.lit(1))
        tested = F.filter(good, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
        return F.transform(tested, lambda t: _hit(i, i, "credential_secret", "high_entropy_token"))

    return F.when(worth, F.flatten(F.transform(marked, inside))).otherwise(F.array())


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def guards(text: Column, lowered: Column, digit: Column) -> dict[str, Column]:
    """By detector, what every match of its pattern holds."""
    return {
        "email_pattern": text.contains("@"), "url_pattern": lowered.contains("://") | lowered.contains("www."), "secret_prefix_pattern": text.contains("-") | text.contains("_") | text.contains("AKIA") | text.contains("eyJ"),
        **dict.fromkeys(("ipv4_pattern", "us_ssn_pattern", "fi_hetu_pattern", "street_address_pattern", "postcode_pattern"), digit),
    }


def tokens_worth(display: Column, digit: Column) -> Column:
    """What holds wherever ``entropy_hits`` finds a token."""
    return digit & F.exists(display, lambda w: F.length(w) >= 20)


#: By pattern of ``rules.INJECTION``, in order: every match holds one of these.
_TOLD = (("ignore ",), ("disregard ",), ("you are ", "act as ", "pretend to be "), ("do not ", "don't "), ("mark ",), ("system prompt",), ("end of ",))


def card_hits(text: Column, digit: Column | None = None) -> Column:
    return as_hits(F.filter(matches(text, rules.CARD, digit), lambda m: T.luhn(T.digits(m["match"]))), "financial", "card_luhn_pattern")


def digit_run_hits(text: Column, digit: Column | None = None) -> Column:
    return as_hits(F.filter(matches(text, rules.DIGIT_RUN, digit), lambda m: F.length(T.digits(m["match"])) >= rules.MIN_DIGITS), "account_identifier", "digit_run_pattern")


def _upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _iban(upper: Column, digit: Column | None = None) -> Column:
    """Account numbers; groups are left off at the end until the check holds."""

    def groups(m: Column) -> Column:
        parts = F.split(m["match"], " ")
        return F.array_max(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: T.iban(F.array_join(F.slice(parts, 1, n), ""))))

    sized = F.transform(matches(upper, rules.IBAN, digit), lambda m: F.struct(m["first"].alias("first"), groups(m).alias("n")))
    return F.transform(F.filter(sized, lambda m: m["n"].isNotNull()), lambda m: _hit(m["first"], m["first"] + m["n"] - 1, "financial", "iban_pattern"))


def _phrase(spoken: Column, phrase: Sequence[str]) -> Column:
    """Positions at which the words of a phrase follow each other."""
    k = len(phrase)
    there = lambda i: F.slice(spoken, i + 1, k) == F.array(*map(F.lit, phrase))
    seen = F.array_contains(spoken, phrase[0])
    return F.when(seen & (F.size(spoken) >= k), F.filter(F.sequence(F.lit(0), F.size(spoken) - k), there)).otherwise(F.array().cast("array<int>"))


def _phrase_hits(spoken: Column, phrase: Sequence[str], category: str, detector: str, source: str, window: int = 0) -> Column:
    """From a phrase to ``window`` words after it."""
    last = F.size(spoken) - 1
    return F.transform(_phrase(spoken, phrase), lambda i: _hit(i, F.least(i + (len(phrase) - 1 + window), last), category, detector, source))


def _word_hits(spoken: Column, words: Sequence[str], category: str, detector: str) -> Column:
    at = F.filter(F.transform(spoken, lambda w, i: F.when(w.isin(*words), i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: _hit(i, i, category, detector))


def _triggers(spoken: Column) -> list[Column]:
    """All trigger phrases, one pass for each length of phrase."""
    entries = [x for phrase, c, n, d in rules.TRIGGERS for x in (F.lit(phrase), F.struct(F.lit(c).alias("category"), F.lit(n).alias("window"), F.lit(d).alias("detector")))]
    phrases = [phrase for phrase, *_ in rules.TRIGGERS]
    return [_looked_up(spoken, [p for p in phrases if p.count(" ") == k - 1], k, F.create_map(*entries)) for k in sorted({p.count(" ") + 1 for p in phrases})]


def _looked_up(spoken: Column, phrases: Sequence[str], k: int, rule: Column) -> Column:
    """Hits of phrases of ``k`` words, by the map from a phrase to its rule. Words hold no blank, so joined ones tell the phrase."""
    first = sorted({p.split(" ")[0] for p in phrases})
    starts = F.filter(F.transform(spoken, lambda w, i: F.when(w.isin(*first), i)), lambda i: i.isNotNull())
    there = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(spoken, i + 1, k), " ").alias("phrase")))
    found = F.transform(F.filter(there, lambda x: x["phrase"].isin(*phrases)), lambda x: F.struct(x["at"].alias("at"), F.element_at(rule, x["phrase"]).alias("rule")))
    stop = lambda x: F.least(x["at"] + (k - 1) + x["rule"]["window"], F.size(spoken) - 1) + 1
    return F.transform(found, lambda x: F.struct(x["at"].cast("long").alias("start"), stop(x).cast("long").alias("stop"), x["rule"]["category"].alias("category"), x["rule"]["detector"].alias("detector"), F.lit("rules").alias("source")))


def _digit_runs(spoken: Column, least: int = rules.MIN_DIGITS) -> Column:
    """Runs of spoken or written digits that add up to enough."""
    written = lambda w: w.rlike("^[0-9]+$")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("since"), F.lit(0).alias("n"), F.array().cast("array<struct<first:int,last:int>>").alias("runs"))

    def closed(s: Column) -> Column:
        return F.when(s["n"] >= least, F.array_append(s["runs"], F.struct(s["since"].alias("first"), (s["at"] - 1).alias("last")))).otherwise(s["runs"])

    def step(s: Column, w: Column) -> Column:
        digit = written(w) | w.isin(*rules.DIGIT_WORDS)
        weight = F.when(written(w), F.length(w)).otherwise(1)
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(digit & (s["n"] > 0), s["since"]).otherwise(s["at"]).alias("since"), F.when(digit, s["n"] + weight).otherwise(0).alias("n"), F.when(digit, s["runs"]).otherwise(closed(s)).alias("runs")
        )

    any_digit = F.exists(spoken, lambda w: written(w) | w.isin(*rules.DIGIT_WORDS))
    runs = F.when(any_digit, F.aggregate(spoken, start, step, closed)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    return F.transform(runs, lambda r: _hit(r["first"], r["last"], "account_identifier", "spoken_digit_run"))


def _spoken_contacts(spoken: Column) -> Column:
    """Around each "at": four words before to five after, if a "dot" is among them."""
    at = F.filter(F.transform(spoken, lambda w, i: F.when(w == "at", i)), lambda i: i.isNotNull())
    window = lambda i: F.struct(F.greatest(i - 4, F.lit(0)).alias("first"), F.least(i + 5, F.size(spoken) - 1).alias("last"))
    words = lambda r: F.slice(spoken, r["first"] + 1, r["last"] - r["first"] + 1)
    spelled = F.filter(F.transform(at, window), lambda r: F.array_contains(words(r), "dot"))
    return F.transform(spelled, lambda r: _hit(r["first"], r["last"], "contact", "spoken_contact_run"))


def injections(display: Column, text: Column | None = None, lowered: Column | None = None) -> Column:
    text = F.array_join(display, " ") if text is None else text
    lowered = F.lower(text) if lowered is None else lowered
    moved = F.octet_length(lowered) != F.octet_length(text)
    whole = F.struct(F.lit(0).alias("first"), (F.size(display) - 1).alias("last"))
    ends = lambda m: F.struct(F.when(moved, whole["first"]).otherwise(m["first"]).alias("first"), F.when(moved, whole["last"]).otherwise(m["last"]).alias("last"))
    told = [reduce(lambda a, b: a | b, (lowered.contains(x) for x in some)) for some in _TOLD]
    found = F.concat(*(F.transform(matches(lowered, p, g), ends) for p, g in zip(rules.INJECTION, told, strict=True)))
    return F.transform(found, lambda m: _hit(m["first"], m["last"], "customer_confidential", "injection_attempt"))


def detected(display: Column, spoken: Column, private_terms: Sequence[str] = (), text: Column | None = None, lowered: Column | None = None, upper: Column | None = None, digit: Column | None = None) -> Column:
    """All hits of a transcript, by (start, stop, detector). The joined words, they lowered and raised, and whether they hold a digit may come as columns, so that they are made once."""
    return F.array_sort(_detected(display, spoken, private_terms, text, lowered, upper, digit), lambda a, b: _order(a, b))


def _detected(display: Column, spoken: Column, private_terms: Sequence[str] = (), text: Column | None = None, lowered: Column | None = None, upper: Column | None = None, digit: Column | None = None) -> Column:
    """The same in no order."""
    text = F.array_join(display, " ") if text is None else text
    upper = _upper(text) if upper is None else upper
    digit = has_digit(text) if digit is None else digit
    worth = guards(text, F.lower(text) if lowered is None else lowered, digit)
    parts = [as_hits(matches(text, pattern, worth[detector]), category, detector) for detector, category, pattern in rules.PATTERNS]
    parts += [entropy_hits(text, tokens_worth(display, digit)), _iban(upper, digit)]
    parts += [card_hits(text, digit), digit_run_hits(text, digit)]
    parts += [_digit_runs(spoken), _spoken_contacts(spoken), *_triggers(spoken)]
    parts += [_word_hits(spoken, words, category, detector) for detector, category, words in rules.LEXICONS]
    for term in private_terms:
        words = _tokens(term)
        if words:
            parts.append(_phrase_hits(spoken, words, "user_defined", "user_private_term", "user_terms"))
    parts.append(injections(display, text, lowered))
    kind = "array<struct<start:bigint,stop:bigint,category:string,detector:string,source:string>>"
    return F.concat(*(p.cast(kind) for p in parts))


def _order(a: Column, b: Column) -> Column:
    by = lambda f: F.when(a[f] < b[f], -1).when(a[f] > b[f], 1)
    return F.coalesce(by("start"), by("stop"), by("detector"), F.lit(0))


def _tokens(term: str) -> list[str]:
    out, word = [], ""
    for c in term.lower() + " ":
        if c.isalnum() or c == "'":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def prepared(sessions: DataFrame) -> DataFrame:
    """Transcripts with what several detectors look at, so that it is made once."""
    return sessions.withColumn("__text", F.array_join("display", " ")).withColumns({"__lower": F.lower("__text"), "__upper": _upper(F.col("__text")), "__digit": has_digit(F.col("__text"))})


def found(rows: DataFrame, private_terms: Sequence[str] = ()) -> Column:
    """All hits of prepared transcripts as one array, in no order."""
    return _detected(rows["display"], rows["spoken"], private_terms, rows["__text"], rows["__lower"], rows["__upper"], rows["__digit"])


def hits(sessions: DataFrame, private_terms: Sequence[str] = ()) -> DataFrame:
    """(session_id, start, stop, category, detector, source): a row per hit."""
    rows = prepared(sessions)
    found = rows.select("session_id", F.explode(detected(F.col("display"), F.col("spoken"), private_terms, F.col("__text"), F.col("__lower"), F.col("__upper"), F.col("__digit"))).alias("h"))
    return found.select("session_id", "h.*")


def spans(found: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Hits and a model's spans together; a model can only add. Equal spans are one row."""
    columns = ["session_id", "start", "stop", "category", "action", "source"]
    own = found.withColumn("action", F.lit("drop_sentence")).select(*columns)
    return (own if model is None else own.unionByName(model.select(*columns))).dropDuplicates()


def mandatory(all_spans: DataFrame) -> DataFrame:
    return all_spans.where(F.col("source").isin("rules", "user_terms"))


def findings(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, detectors, clean): the names of the detectors that hit, once each and sorted; clean without any, attempts to instruct included."""
    names = found.groupBy("session_id").agg(F.array_sort(F.collect_set("detector")).alias("detectors"))
    rows = sessions.select("session_id").join(names, "session_id", "left").withColumn("detectors", F.coalesce("detectors", F.array().cast("array<string>")))
    return rows.withColumn("clean", F.size("detectors") == 0)
