"""Text functions of transcripts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class.
SPACES = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EDGES = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def words(text: Column) -> Column:
    """The runs of other characters than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def any_word(text: Column) -> Column:
    """Whether a text has words, without making them."""
    return F.coalesce(text, F.lit("")).rlike(f"[^{SPACES[1:-2]}]")


def spoken(token: Column) -> Column:
    """Without marks at both ends, in lower case."""
    return F.lower(F.regexp_replace(token, EDGES, ""))


def display(shown: Column, said: Column) -> Column:
    return F.coalesce(F.nullif(shown, F.lit("")), said)


def spoken_words(text: Column) -> Column:
    return F.filter(F.transform(words(text), spoken), lambda w: w != "")


def term_tokens(term: Column) -> Column:
    """A user's term cut at everything but letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(term), r"[^\p{IsAlphabetic}\p{N}']+"), lambda w: w != "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def joined(tokens: Column) -> Column:
    """Display text: no space before a mark that closes."""
    return F.regexp_replace(F.array_join(tokens, " "), r" ([,.!?;:])", "$1")


def word_distance(a: Column, b: Column, both: Column | None = None) -> Column:
    """Word-level edit distance of two arrays of words; ``both``, their distinct words, had better be a column, as each word looks at it.

    Each distinct word of the pair becomes one character; the built-in character distance does the
    rest. For a pair with more than a million distinct words, too many for characters, null.
    """
    both = F.array_distinct(F.concat(a, b)) if both is None else both
    place = lambda w: F.array_position(both, w) + 0x0FFF
    one = lambda w: F.when(place(w) < 0xD800, place(w)).otherwise(place(w) + 0x0800)  # noqa: E731  0xD800 to 0xDFFF are no characters
    coded = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(one(w)), 8, "0")), "")), "UTF-32")
    return F.when(F.size(both) <= 1_000_000, F.levenshtein(coded(a), coded(b)))


def luhn(number: Column) -> Column:
    """Whether at least 12 digits have a valid check digit."""
    return (F.length(number) >= 12) & F.call_function("luhn_check", number)


def iban(compact: Column) -> Column:
    """Whether an account number of 15 to 34 letters and digits has the remainder 1."""
    upper = F.upper(compact)
    turned = F.concat(F.substr(upper, F.lit(5)), F.substring(upper, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) >= 10, 100).otherwise(10) + value(c)) % 97)
    return F.when(upper.rlike(r"\A[A-Z]{2}[A-Z0-9]{13,32}\z"), rest == 1).otherwise(False)


#: \A and \z: the whole name. $ would also match before a last line feed.
SAFE_ENTRY = r"\A[A-Za-z0-9._-]{1,64}\z"
DIGEST = r"\A[0-9a-fA-F]{64}\z"
SAMPLE_ID = r"\Asample-([0-9a-fA-F]{16}|[0-9a-fA-F]{32})\z"
IDEMPOTENCY_KEY = r"\A[A-Za-z0-9_-]{8,128}\z"
METADATA = r"\A[a-z0-9_:.-]+\z"


def safe_entry(name: Column) -> Column:
    return name.rlike(SAFE_ENTRY) & ~name.contains("..")


def shown_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"\p{Cntrl}", ""), 1, 64)
