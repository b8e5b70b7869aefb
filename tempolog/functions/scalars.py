"""Column expressions shared by the operators. All of them stay inside Spark's code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.schema import CLIP, GAP_EPSILON, MAD_SCALE


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column, whatever the session time zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def seconds(us: str | Column) -> Column:
    return col(us) / F.lit(1e6)


def log_gap(us: str | Column, epsilon: float = GAP_EPSILON) -> Column:
    return F.ln(seconds(us) + F.lit(epsilon))


def clip(value: str | Column, bound: float = CLIP) -> Column:
    return F.least(F.lit(bound), F.greatest(F.lit(-bound), col(value)))


def robust_score(x: str | Column, median: str | Column, mad: str | Column) -> Column:
    return (col(x) - col(median)) / (F.lit(MAD_SCALE) * col(mad))


def quartile_us(history: str | Column, which: int) -> Column:
    """First or third quartile of a short array of integers, in seconds, by linear interpolation.

    The position is ``which * (n - 1) / 4``, so four times the value is an integer and no rounding is needed.
    """
    ordered = F.array_sort(col(history))
    steps = (F.size(col(history)) - 1) * which
    at = F.floor(steps / 4).cast("int")
    part = steps % 4
    low = F.element_at(ordered, at + 1)
    high = F.element_at(ordered, F.least(at + 2, F.size(col(history))))
    return (low * 4 + part * (high - low)) / F.lit(4e6)


def draw(seed: int, kind: str, number: int, key: str | Column) -> Column:
    """A uniform number in [0, 1) that depends only on its arguments, so any partitioning draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(kind), F.lit(str(number)), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hmac_sha256(secret: bytes, message: str | Column) -> Column:
    """Hex HMAC-SHA256 of a text column; only the two padded key blocks are prepared on the driver."""
    block = 64
    key = hashlib.sha256(secret).digest() if len(secret) > block else secret
    key = key.ljust(block, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, col(message).cast("string").cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


# Text forms of a time. ISO 8601 date and time, optional fraction, optional zone.
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?"
ISO_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?(:?\d{2}(\.\d+)?)?)$"
UTC_ZONE = r"(Z|[+-]00(:?00)?)$"
DIGITS = r"^\d+$"
# Texts that :func:`extended_iso` leaves as they are, with a zone.
FULL_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
# The seconds at which the years 1 and 10000 begin.
FIRST_SECOND, END_SECOND = -62_135_596_800, 253_402_300_800


def parse_time(text: str | Column) -> Column:
    """Timestamp from epoch seconds, epoch milliseconds (more than ten digits), a float of seconds, or ISO 8601.

    ISO text must carry a zone; its basic form, hours alone and fractions of any length (cut to microseconds) are read
    too. Times outside the years 1 to 9999 and anything else become null. Full ISO text, the usual case, is read without
    rewriting it.
    """
    text = col(text)
    full = text.rlike(FULL_ISO) & text.substr(F.lit(1), F.lit(10)).try_cast("date").isNotNull()
    number = text.try_cast("double")
    within = lambda seconds: (seconds >= F.lit(FIRST_SECOND)) & (seconds < F.lit(END_SECOND))
    whole = text.try_cast("bigint")
    iso = extended_iso(text)
    return (
        F.when(full, F.try_to_timestamp(text))
        .when(text.rlike(DIGITS) & (F.length(text) > 10), F.when(within(whole / 1000), F.timestamp_micros(whole * 1000)))
        .when(text.rlike(DIGITS), F.timestamp_micros(whole * 1_000_000))
        .when(~F.isnan(number) & within(number), F.timestamp_micros(F.rint(number * 1e6).cast("bigint")))
        .when(is_iso(text) & has_zone(text), F.try_to_timestamp(iso))
    )


def extended_iso(text: Column) -> Column:
    """ISO text with separators, minutes, seconds, and at most six digits of a fraction."""
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(.{10}[T ]\d{2})(\d{2})(\d{2})?(?=[.,Z+-]|$)", "$1:$2:$3")
    text = F.regexp_replace(text, r":(?=[Z+-]|$)", "")
    text = F.regexp_replace(text, r"^(.{10}[T ]\d{2})(?=[Z+-]|$)", "$1:00")
    text = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(?=[Z+-]|$)", "$1:00")
    return F.regexp_replace(text, r"[.,](\d{1,6})\d*", ".$1")


def is_iso(text: Column) -> Column:
    text = extended_iso(text)
    return text.rlike(ISO_DATETIME) & text.substr(F.lit(1), F.lit(10)).try_cast("date").isNotNull()


def has_zone(text: Column) -> Column:
    return extended_iso(text).rlike(ISO_DATETIME + ISO_ZONE)


def is_utc(text: Column) -> Column:
    return extended_iso(text).rlike(ISO_DATETIME + UTC_ZONE)
