"""Column functions used across the operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_between(start: Col, end: Col) -> Column:
    """Second boundaries between two times (fractions are cut first on both sides)."""
    return F.unix_timestamp(_c(end).cast("timestamp")) - F.unix_timestamp(_c(start).cast("timestamp"))


def minutes_between(start: Col, end: Col) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def ratio(a: Col, b: Col) -> Column:
    """a / b as double; null for a zero or null denominator."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def iso_seconds(ts: Col) -> Column:
    """ISO 8601 in UTC to the second, with ``Z``."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(ts: Col) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_utc(text: Col) -> Column:
    """A timestamp from ISO 8601 text that names UTC; null for anything else."""
    text = _c(text)
    fine = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$")
    return F.when(fine, F.try_to_timestamp(text))


def cursor_slug(ts: Col, key: Col) -> Column:
    """File-name form of a keyset cursor."""
    return F.concat(F.date_format(_c(ts), "yyyyMMdd'T'HHmmss.SSSSSS'Z-'"), _c(key))


def padded(prefix: str, n: Col, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(_c(n).cast("string"), width, "0"))


def event_key(n: Col) -> Column:
    """``evt-`` and two six-digit groups of a running number."""
    n = _c(n)
    return F.concat(F.lit("evt-"), F.lpad((F.floor(n / 1_000_000)).cast("string"), 6, "0"), F.lit("-"), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def filled(text: Col) -> Column:
    """Whether a text holds anything but white space."""
    return F.coalesce(F.length(F.regexp_replace(_c(text), r"\s+", "")) > 0, F.lit(False))


def one_line(text: Col, most: int = 280) -> Column:
    """White space collapsed, trimmed and cut; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), 1, most), F.lit(""))


def base64_line(x: Col) -> Column:
    """Base64 without the line breaks of MIME."""
    return F.regexp_replace(F.base64(_c(x)), r"[\r\n]", "")


def unix_lines(text: Col) -> Column:
    return F.regexp_replace(_c(text), "\r\n", "\n")


def same_number(a: Col, b: Col, tolerance: float = 1e-12) -> Column:
    """Null-safe equality within a tolerance."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def round_half_even(x: Col, digits: int = 6) -> Column:
    return F.bround(_c(x), digits)


def canonical_json(*columns: Col) -> Column:
    """JSON of the columns, keys sorted, nulls kept."""
    named = sorted((_c(c) for c in columns), key=str) if not all(isinstance(c, str) for c in columns) else [F.col(c) for c in sorted(columns)]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(canonical_json(*columns), 256)


def _label(form: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(form, x)).otherwise("Unavailable")


def percent_label(x: Col) -> Column:
    return _label("%.1f%%", _c(x).cast("double") * 100)


def minutes_label(x: Col) -> Column:
    return _label("%.1f min", _c(x).cast("double"))


def count_label(x: Col) -> Column:
    return _label("%d", _c(x).cast("long"))


def duration_label(seconds: Col) -> Column:
    s = F.greatest(F.lit(0), _c(seconds)).cast("long")
    return F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60)
