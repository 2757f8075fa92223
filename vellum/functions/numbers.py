"""Scalar rules on times, sample counts and rates, as columns. Divisions of counts are in integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
RATE = 16_000
Z95 = 1.959964


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer quotient, rounded down also for negative numbers."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def day(seconds: Column) -> Column:
    """Number of the UTC day of a unix time; times before 1970 count down."""
    return floor_div(seconds, DAY)


def next_midnight(seconds: Column) -> Column:
    return (day(seconds) + 1) * DAY


def retry_delay(attempts: Column, retriable: Column, most: int = 8, first: int = 30, longest: int = 6 * 3600) -> Column:
    """Seconds until attempt number ``attempts`` is repeated; null when the job gives up."""
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30)).cast("int")
    delay = F.least((F.lit(first) * F.pow(F.lit(2.0), exponent)).cast("long"), F.lit(longest).cast("long"))
    return F.when(retriable & (attempts < most), delay)


def samples(milliseconds: Column, rate: int = RATE) -> Column:
    """Half a sample rounds up."""
    return floor_div(milliseconds.cast("long") * rate + 500, 1000)


def milliseconds(n: Column, rate: int = RATE) -> Column:
    return n.cast("double") * 1000.0 / rate


def clip_milliseconds(n: Column, rate: int = RATE) -> Column:
    """Half a millisecond rounds up."""
    return floor_div(n.cast("long") * 1000 + rate // 2, rate)


def buffer_milliseconds(n: Column, rate: int = RATE) -> Column:
    """Rounded down."""
    return floor_div(n.cast("long") * 1000, rate)


def whole_seconds(ms: Column) -> Column:
    """Rounded up."""
    return floor_div(ms.cast("long") + 999, 1000)


def centiseconds_to_samples(cs: Column) -> Column:
    return F.greatest(cs.cast("long"), F.lit(0)) * 160


def removal_at(start: Column, end: Column, rate: int, canonical: int = RATE) -> tuple[Column, Column]:
    """A removed range at another rate, rounded outwards."""
    return floor_div(start * rate, canonical), floor_div(end * rate + (canonical - 1), canonical)


def retained_at(start: Column, end: Column, rate: int, canonical: int = RATE) -> tuple[Column, Column]:
    """A retained range at another rate, rounded inwards; never inverted."""
    low = floor_div(start * rate + (canonical - 1), canonical)
    return low, F.greatest(low, floor_div(end * rate, canonical))


def held_out_size(n: Column, fraction: float = 0.2, least: int = 30) -> Column:
    return F.greatest(F.ceil(n * F.lit(fraction).cast("double")), F.lit(least)).cast("long")


def wilson(hits: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """The interval of a proportion at 95 %; of nothing, all."""
    n, p, zz = total.cast("double"), hits / total, z * z
    center = (p + zz / (2.0 * n)) / (1.0 + zz / n)
    margin = z * F.sqrt((p * (1.0 - p) + zz / (4.0 * n)) / n) / (1.0 + zz / n)
    none = total == 0
    return F.when(none, 0.0).otherwise(F.greatest(center - margin, F.lit(0.0))), F.when(none, 1.0).otherwise(F.least(center + margin, F.lit(1.0)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate in single precision, as thresholds are; without weight 0."""
    total = F.sum(weight.cast("double"))
    return F.coalesce(F.when(total > 0, F.sum(value.cast("double") * weight.cast("double")) / total), F.lit(0.0)).cast("float")


def manifest_ratio(value: Column) -> Column:
    """A ratio as manifests hold it: four decimals, half away from zero."""
    return F.round(value.cast("double"), 4)
