"""Scalar functions for ids, times, sizes and names that are written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A written time: date, T, time of day to nine digits, Z; second 60 is a leap second.
_TIME = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})\.([0-9]{9})Z$"
DAY = 86_400


def to_hex(value: str | Column) -> Column:
    """Lower-case hexadecimal digits of a binary value."""
    return F.lower(F.hex(value))


def id_of(text: str) -> Column:
    """The 32 bytes that 64 lower-case hexadecimal digits stand for; null for anything else."""
    return F.when(F.col(text).rlike("^[0-9a-f]{64}$"), F.unhex(text))


def time_of(text: str) -> Column:
    """struct(secs, leap, nanos) of a written time, which sorts as times do; null if it is none. A leap
    second counts as the second before it, and after all of that."""
    part = lambda k: F.regexp_extract(text, _TIME, k)
    day = F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3)), F.lit("yyyy-MM-dd"))
    number = lambda k: part(k).try_cast("long")
    secs = F.unix_timestamp(day) + number(4) * 3600 + number(5) * 60 + F.least(number(6), F.lit(59))
    good = F.col(text).rlike(_TIME) & day.isNotNull() & (number(4) < 24) & (number(5) < 60) & (number(6) <= 60)
    return F.when(good, F.struct(secs.alias("secs"), (number(6) == 60).alias("leap"), number(7).cast("int").alias("nanos")))


def stamp(secs: str, fraction: Column) -> Column:
    """A Unix time with these digits after its seconds, whatever they are."""
    return F.concat(F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), fraction, F.lit("Z"))


def written_time(secs: str, nanos: str) -> Column:
    """The written form of a Unix time; null where nanoseconds reach a second or the year is beyond 9999."""
    text = stamp(secs, F.lpad(F.col(nanos).cast("string"), 9, "0"))
    return F.when(F.col(nanos).between(0, 999_999_999) & F.col(secs).between(-62_167_219_200, 253_402_300_799), text)


def older_than(completed: str, nanos: str, now: int, days: int) -> Column:
    """Whether a time lies more than so many days back, to the nanosecond: one more than the limit is over it."""
    age = F.lit(now) - F.col(completed)
    return (age > days * DAY) | ((age == days * DAY) & (F.col(nanos) < 0))


def age_text(seconds: str) -> Column:
    return F.format_string("%d day(s)", F.expr(f"cast({seconds} div {DAY} as bigint)"))


def octal(field: str) -> Column:
    """The number in an octal field of a header, which blanks and zero bytes may end; null if it is none."""
    text = F.regexp_replace(F.col(field), "[ \\x00]+$", "")
    return F.when(text.rlike("^ *[0-7]{1,21}$"), F.conv(F.trim(text), 8, 10).try_cast("long"))


def shown(name: str) -> Column:
    """A name as it is printed: controls, backslashes and marks that change direction in escapes."""
    marks = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = F.col(name)
    for raw, escaped in marks.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rest = [*range(9), 11, 12, *range(14, 32), *range(127, 160), *range(0x202A, 0x202F), *range(0x2066, 0x206A)]
    for code in rest:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    return out


def typed(column: str, kind: str) -> Column:
    """A value for JSON in which binaries stay apart from text: struct(blob_hex) or struct(text)."""
    return F.struct(to_hex(column).alias("blob_hex")) if kind == "binary" else F.struct(F.col(column).cast("string").alias("text"))


def saturating(a: str, b: str) -> Column:
    """The sum, or the largest number where it overflows."""
    return F.coalesce(F.expr(f"try_add({a}, {b})"), F.lit((1 << 63) - 1))
