"""Scalar functions as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forms of text that are read as a time of day.
CLOCK_PATTERN = r"^(\d{1,2})\s*[Hh:]\s*(\d{0,2})$"
DIGITS_PATTERN = r"^\d+$"
# Fixed value: text that counts as number-like when a table is loaded.
NUMBER_LIKE_PATTERN = r"^[-+]?\d*\.?\d+$"
# Fixed value: text that counts as a link.
URL_PATTERN = r"(?i)(https?://|www\.)"

# Formats tried in turn when text is read as a timestamp.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def parse_time(value: Column) -> Column:
    """``06H00``, ``6h``, ``06:30``, ``6``, ``600``, ``1430`` -> ``HH:MM:SS``; other text unchanged."""
    text = F.trim(value.cast("string"))
    hour = F.regexp_extract(text, CLOCK_PATTERN, 1)
    minute = F.regexp_extract(text, CLOCK_PATTERN, 2)
    clock = F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":00"))
    number = text.try_cast("bigint")
    hundreds = F.floor(number / 100)
    digits = F.when(number <= 24, F.concat(_two(number), F.lit(":00:00"))).otherwise(
        F.concat(
            F.when(hundreds < 10, _two(hundreds)).otherwise(hundreds.cast("string")),
            F.lit(":"),
            _two(number % 100),
            F.lit(":00"),
        )
    )
    return (
        F.when(text.rlike(CLOCK_PATTERN), clock)
        .when(text.rlike(DIGITS_PATTERN) & number.isNotNull(), digits)
        .otherwise(text)
    )


def to_number(value: Column) -> Column:
    """Text to DOUBLE; anything that is not a finite-looking number becomes NULL."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_timestamp(value: Column, dtype: T.DataType | None = None) -> Column:
    """Text, date or timestamp to TIMESTAMP_NTZ; unreadable text becomes NULL."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp_ntz")
    text = F.trim(value.cast("string"))
    parsed = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS]
    return F.coalesce(text.try_cast("timestamp_ntz"), *parsed)


def combine_date_time(date: Column, time_text: Column) -> Column:
    """Date part of ``date`` plus a time text -> TIMESTAMP_NTZ; NULL when either part is unusable."""
    joined = F.concat(date.cast("date").cast("string"), F.lit(" "), time_text)
    return joined.try_cast("timestamp_ntz")


def contains_any(value: Column, pattern: str) -> Column:
    return value.cast("string").rlike("(?i)" + pattern)


def full_match(value: Column, pattern: str) -> Column:
    body = pattern.removeprefix("^").removesuffix("$")
    return value.cast("string").rlike(f"^(?:{body})$")


# Label format of each time unit.
TIME_LABELS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}


def time_label(ts: Column, unit: str) -> Column:
    """Truncate to hour, day, week (Monday) or month and format as a label."""
    return F.date_format(F.date_trunc(unit, ts), TIME_LABELS[unit])


def round_to(value: Column, digits: int) -> Column:
    """Round, with -0.0 folded into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(value: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    d = value.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def finite_or(value: Column, default: float) -> Column:
    return F.coalesce(finite(value), F.lit(float(default)))


def bool_to_int(value: Column) -> Column:
    return value.cast("int")


def epoch_seconds(value: Column) -> Column:
    """Wall-clock seconds since 1970 as DOUBLE, independent of the session zone for NTZ values."""
    day = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date"))
    return (
        day * F.lit(86400.0)
        + F.hour(value) * 3600
        + F.minute(value) * 60
        + F.date_part(F.lit("SECOND"), value).cast("double")
    )


def sort_code(value: Column, dtype: T.DataType, chunk: int = 0) -> Column:
    """A DOUBLE that never decreases as ``value`` increases; used to cut a sort key into ranges.

    The code of a text comes from six of its bytes: those of the given chunk, for texts that agree in all before.
    """
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(dtype, T.DateType):
        return F.datediff(value, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return epoch_seconds(value)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("double")
    # Text sorts by its UTF-8 bytes: six of them fit a DOUBLE exactly.
    head = F.hex(F.substring(F.encode(value.cast("string"), "utf-8"), 6 * chunk + 1, 6))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
