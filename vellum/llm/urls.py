"""Parts of web addresses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def domain(name: Column) -> Column:
    """The registered domain of a host; a number address or a single label is its own."""
    three = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(name.rlike(r"^[0-9.]+(:[0-9]+)?$"), name).when(three, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(registered: Column) -> Column:
    """What follows the first label of a registered domain."""
    plain = registered.rlike(r"^[0-9.]+(:[0-9]+)?$") | ~registered.contains(".")
    return F.when(plain, registered).otherwise(F.regexp_replace(registered, r"^[^.]*\.", ""))
