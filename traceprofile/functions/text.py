"""Text and number formatting as Column expressions."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000.0

# Report file name and fallback trace name.
REPORT_FILE_PREFIX = "perfetto_analysis_report_"
FALLBACK_TRACE_PREFIX = "analysis_"
FILE_TIME_FORMAT = "yyyyMMdd_HHmmss"
DATE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TRACE_NAME_PATTERN = r"(?:^|[/=])([a-z]*trace_[A-Za-z0-9]+_[A-Za-z0-9]+)"
NATIVE_PREFIX = "native:0x"


def ns_to_ms(ns: Column) -> Column:
    return ns.cast("double") / F.lit(NS_PER_MS)


def _half_marks() -> list[float]:
    """Smallest doubles that round up to each next tenth: 0.05, 0.15 … 0.95, or the
    double after it where the stored mark lies below its true value."""
    marks = []
    for k in range(10):
        mark = (2 * k + 1) / 20
        low = Fraction(mark) < Fraction(2 * k + 1, 20)
        marks.append(math.nextafter(mark, 1.0) if low else mark)
    return marks


def to_fixed1(x: Column) -> Column:
    """One-decimal text of a double, rounded by its exact binary value, ties upward.

    The fraction of a double is exact, so the number of half-way marks it has reached
    is the rounded tenth.
    """
    size = F.abs(x)
    marks = F.array(*[F.lit(m) for m in _half_marks()])
    reached = F.size(F.filter(marks, lambda m: m <= size - F.floor(size)))
    tenths = F.floor(size) * 10 + reached
    text = (tenths.cast("decimal(20,0)") * F.lit(Decimal("0.1"))).cast("string")
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def short_name(name: Column) -> Column:
    """Method name up to the argument list."""
    return F.substring_index(name, "(", 1)


def hex_address(addr: Column) -> Column:
    """Unsigned lower-case hex with ``0x`` and no leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(addr)))


def native_name(addr: Column) -> Column:
    """Name of an address that no mapping covers."""
    return F.concat(F.lit(NATIVE_PREFIX), F.lower(F.hex(addr)))


def parse_hex_address(text: Column) -> Column:
    """Inverse of :func:`hex_address`; the high bit lands in the sign."""
    return F.conv(F.substring(text, 3, 16), 16, -10).cast("bigint")


def date_time_text(as_of: Column) -> Column:
    return F.date_format(as_of, DATE_TIME_FORMAT)


def report_filename(as_of: Column) -> Column:
    return F.concat(
        F.lit(REPORT_FILE_PREFIX), F.date_format(as_of, FILE_TIME_FORMAT), F.lit(".md")
    )


def trace_id_from_path(path: Column, as_of: Column) -> Column:
    """Trace name found in a path or URL, else a name made from the time."""
    found = F.regexp_extract(path, TRACE_NAME_PATTERN, 1)
    fallback = F.concat(F.lit(FALLBACK_TRACE_PREFIX), F.date_format(as_of, FILE_TIME_FORMAT))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)
